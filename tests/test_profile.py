"""Small repos with results written out by hand."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.operators import aggregate as agg
from repoatlas.operators import extract
from repoatlas.operators.classify import classify, select_analyzer, survey_files
from repoatlas.plans import contexts, job, profile, prompts, quality
from tests.helpers import make_files, matches

MAIN = "public static void main(String[] args) {}"
PLUGIN = "apply plugin: 'application'"
REPOS = {
    "shop": {
        "build.gradle": PLUGIN + "\nplugins { id 'java'\n id 'org.springframework.boot' }\n"
        "dependencies {\n implementation 'a:b:1'\n api(group: 'g', name: \"n\", version: '2')\n}\nmainClass",
        "sub/build.gradle": PLUGIN,
        "gradlew": "x",
        "src/main/java/App.java": "@SpringBootApplication " + MAIN,
        "src/main/java/Tool.java": MAIN,
        "src/main/java/OrderController.java": "@RestController @GetMapping",
        "README.md": "# Shop\n\nTODO",
        "docs/readme.md": "docs",
        "stop.sh": "s",
        "start.sh": "r",
        "scripts/run.sh": "n",
        "application.yml.example": "a: ${name}\nb: ${config_files}",
        "build/Out.java": "class Out",
        "sonar-project.properties": "s",
        ".gitlab-ci.yml": "ci",
        "target/config.yml.template": "t",
        "pom.xml": "<dependency><groupId> g </groupId><artifactId>a</artifactId><version>1</version></dependency>",
    },
    "tool": {"setup.py": "s", "pkg/a.py": "a", "pkg/b.py": "b", "conf.toml": "c", "x.toml": "", "run.sh": "r"},
    "site": {"package.json": "{}", "src/a.ts": "a", "logo.png": "p"},
    "bare": {"notes.txt": "n"},
}


@pytest.fixture(scope="module")
def files(spark):
    return make_files(spark, REPOS)


@pytest.fixture(scope="module")
def run(files):
    return job.start_run(files)


def test_analyzers(files):
    assert matches(select_analyzer(files), "repo", "analyzer") == {
        ("shop", "java"), ("tool", "python"), ("site", "javascript"), ("bare", "java"),
    }
    assert {r.analyzer for r in select_analyzer(files, "python").collect()} == {"python"}
    with pytest.raises(ValueError):
        select_analyzer(files, "cobol")


def test_directory_markers(spark):
    files = make_files(spark, {"j": {"src/main/java/A.java": ""}, "n": {"node_modules/x": ""}, "k": {"src/main/javax/A": ""}})
    assert matches(select_analyzer(files), "repo", "analyzer") == {("j", "java"), ("n", "javascript"), ("k", "java")}


def test_classification(files):
    rows = {r.path: r for r in classify(files).filter("repo = 'shop'").collect()}
    assert set(rows) == set(REPOS["shop"]) - {
        "gradlew", "build/Out.java", "sonar-project.properties", ".gitlab-ci.yml",
        "target/config.yml.template", "pom.xml",
    }
    entries = {p for p, r in rows.items() if r.is_entry_point}
    # the root build file is a key file, so it is no entry point
    assert entries == {"src/main/java/App.java", "src/main/java/Tool.java", "sub/build.gradle"}
    assert {p for p, r in rows.items() if r.is_config} == {
        "application.yml.example", "start.sh", "stop.sh", "scripts/run.sh",
    }
    strict = classify(files, readme_md=False)
    assert ("docs/readme.md",) not in matches(strict, "path")


def test_size_gate_keeps_listing(spark):
    big = "x" * 102401
    files = make_files(spark, {"r": {"A.java": big, "application.yml.example": big, "build.gradle": ""}})
    survey = survey_files(files, "java")
    assert matches(survey.filter("is_gathered"), "path") == {("build.gradle",)}
    assert matches(agg.config_union(survey), "path") == {("application.yml.example",)}


def test_profile(run):
    rows = {r.repo: r for r in run.profile.collect()}
    shop = rows["shop"]
    assert (shop.primary_language, shop.total_files, shop.has_spring_boot) == ("Java", 11, True)
    assert (shop.type, shop.has_wrapper, shop.n_run, shop.n_stop) == ("gradle", True, 1, 1)
    assert shop.key_project_files == ["README.md", "application.yml.example", "build.gradle"]
    assert shop.custom_tools == ["spring-boot"]
    assert [(x.language, x.n) for x in shop.language_stats] == [("Unknown", 6), ("Java", 3), ("Gradle", 2)]
    assert shop.top_files[0].path == "src/main/java/App.java"
    assert rows["tool"].primary_language == "Python" and rows["tool"].type == "unknown"
    bare = rows["bare"]
    assert (bare.total_files, bare.primary_language, bare.top_files) == (0, "Unknown", [])


def test_language_tie_goes_to_first_seen(spark):
    files = make_files(spark, {"r": {"setup.py": "", "a.toml": "", "b.toml": "", "c.py": ""}})
    stats = agg.language_stats(survey_files(files, "python"))
    assert matches(agg.primary_language(stats), "primary_language") == {("Python",)}


def test_lists(run):
    lists = run.corpus.chosen(agg.repo_lists(run.corpus.survey)).filter("repo = 'shop'")
    assert matches(lists.filter("list = 'example_config_files'"), "path") == {
        ("application.yml.example",), ("target/config.yml.template",),
    }
    assert matches(lists.filter("list = 'root_shell_scripts'"), "path") == {("start.sh",), ("stop.sh",)}


def test_dependencies(run):
    found = run.dependencies.orderBy("ord").collect()
    assert [r.text for r in found] == [
        "implementation 'a:b:1'", "api(group: 'g', name: 'n', version: '2')", "g:a:1",
    ]


def test_parenthesised_dependencies(spark):
    files = make_files(spark, {"r": {"x.gradle": 'dependencies { implementation("g:n:1") }'}})
    assert extract.gradle_dependencies(files).count() == 0
    assert matches(extract.gradle_dependencies(files, True), "text") == {("implementation 'g:n:1'",)}


def test_plugins(files):
    assert matches(extract.gradle_plugins(files), "plugin") == {("java",), ("org.springframework.boot",)}
    assert matches(extract.gradle_plugins(files, "last"), "plugin") == {("org.springframework.boot",)}


def test_commands(run):
    commands = extract.find_commands(run.corpus.survey)
    groups = run.corpus.chosen(agg.command_groups(run.profile, commands)).orderBy("repo", "ord").collect()
    assert [(r.repo, r.kind, r.command) for r in groups] == [
        ("bare", "gradle", "./gradlew build"),
        ("shop", "run", "./start.sh"), ("shop", "stop", "./stop.sh"),
        ("site", "gradle", "./gradlew build"), ("tool", "gradle", "./gradlew build"),
    ]


def test_command_kinds_follow_the_first_script(spark):
    files = make_files(spark, {"r": {"a-stop.sh": "", "b-run.sh": "", "c-stop.sh": "", "build.gradle": "mainClass"},
                               "s": {"build.gradle": "mainClass"}})
    survey = survey_files(files, "java")
    groups = agg.command_groups(agg.command_facts(survey), extract.find_commands(survey))
    assert [(r.repo, r.kind, r.command) for r in groups.orderBy("repo", "ord").collect()] == [
        ("r", "stop", "./a-stop.sh"), ("r", "stop", "./c-stop.sh"), ("r", "run", "./b-run.sh"),
        ("s", "gradle", "./gradlew build"), ("s", "run", "./gradlew run"),
    ]


def test_report(run):
    report = profile.profile_report(run.corpus, run.profile, run.dependencies)
    texts = {r.repo: r.text for r in report.collect()}
    assert texts["tool"] == (
        "# Repository Analysis for: tool\nPrimary Language: Python\nTotal Files: 6\n\n## Overview\n"
        "Python repository analysis not yet implemented.\n\n## File Breakdown\n"
        "- Python: 3 files\n- TOML: 2 files\n- Unknown: 1 files\n\n## Root Shell Scripts\n- run.sh"
    )
    assert texts["shop"].endswith(
        "## Entry Points\n- src/main/java/App.java\n- src/main/java/Tool.java\n- sub/build.gradle\n\n"
        "## Build Commands\n- run: `./start.sh`\n- stop: `./stop.sh`\n\n## Dependencies\n"
        "- implementation 'a:b:1'\n- api(group: 'g', name: 'n', version: '2')\n- g:a:1"
    )


def test_a_report_in_parts_is_the_same_text(run):
    whole = profile.profile_report(run.corpus, run.profile, run.dependencies).collect()
    parts = profile.profile_report(run.corpus, run.profile, run.dependencies, as_pieces=True).collect()
    assert len(parts) > len(whole)
    for row in whole:
        mine = sorted((p.part, p.text) for p in parts if p.repo == row.repo)
        assert "".join(text for _, text in mine) == row.text


@pytest.fixture(scope="module")
def slots(spark, run):
    outputs = spark.createDataFrame(
        [("shop", 1, " It sells. "), ("shop", 3, "```\n# Shop\n```"), ("tool", 2, "pip")],
        "repo string, step int, output string",
    )
    verdicts = spark.createDataFrame([("shop", "v" * 1001 + "\nYES")], "repo string, output string")
    contents = job.picked_contents(run)
    return (
        job.first_slots(run, contents)
        .unionByName(job.draft_slots(run, outputs))
        .unionByName(job.final_slots(run, contents, outputs, verdicts))
    )


def test_prompts(spark, slots):
    made = {
        (r.repo, r.step): r.prompt
        for r in job.prompt_batch(slots, prompts.default_steps(spark)).collect()
    }
    assert set(made) == {(r, s) for r in REPOS for s in (1, 2, 3, 4)}
    assert not [k for k, p in made.items() if re.search(r"\n{3}", p)]
    one = made["shop", 1]
    assert "Primary Language: Java\n        This is a Spring Boot application.\n" in one
    assert "## Key Components\n- README.md\n- application.yml.example\n- build.gradle\n" in one
    # a placeholder inside an inserted text is filled if its turn comes later
    assert "### application.yml.example\n```\na: ${name}\nb: \n```" in one
    two = made["shop", 2]
    assert "Build System: gradle" in two
    assert "### Build Commands\n- run: `./start.sh`\n- stop: `./stop.sh`\n" in two
    assert "## Shell Scripts\n- scripts/run.sh\n- start.sh\n- stop.sh\n" in two
    assert "It sells." in made["shop", 3] and "No usage instructions available." in made["shop", 3]
    assert "No project purpose identified." in made["tool", 3]
    four = made["shop", 4]
    # the file is 14 characters long, under the limit for a verdict
    assert "Recommendation: OVERWRITE" in four and "README is empty or minimal" in four
    assert "```markdown\n            # Shop\n            ```" in four
    assert "No original README found." in made["bare", 4]


def test_prompts_in_parts_join_to_the_same_text(spark, slots):
    steps = prompts.default_steps(spark)
    # the content with a placeholder of its own is only filled in prompts made as one value
    plain = slots.withColumn("text", F.replace("text", F.lit("${"), F.lit("$(")))
    whole = {(r.repo, r.step): r.prompt for r in prompts.build_prompts(plain, steps).collect()}
    parts = prompts.prompt_pieces(plain, steps).collect()
    assert len(parts) > len(whole)
    for key, prompt in whole.items():
        mine = sorted((p.part, p.text) for p in parts if (p.repo, p.step) == key)
        assert re.sub(r"\n{3,}", "\n\n", "".join(text for _, text in mine)) == prompt


def test_a_placeholder_may_stand_twice(spark):
    steps = spark.createDataFrame([(1, "${name}: ${key_files_content}; ${name}!")], "step int, template string")
    rows = [("r", 1, "name", "", "N")] + [("r", 1, "key_files_content", f"{i:03d}", f"<{i}>") for i in range(300)]
    slots = spark.createDataFrame(rows, "repo string, step int, slot string, ord string, text string").repartition(4)
    whole = prompts.build_prompts(slots, steps).first().prompt
    pieces = sorted((r.part, r.text) for r in prompts.prompt_pieces(slots, steps).collect())
    assert "".join(text for _, text in pieces) == whole == f"N: {''.join(f'<{i}>' for i in range(300))}; N!"


def test_contexts(run):
    facts = agg.command_facts(run.corpus.survey)
    rows = contexts.usage_context(run.corpus, facts).filter("repo = 'shop'")
    shown = rows.filter("field = 'key_files_content'").orderBy("ord").collect()
    assert [r.path for r in shown] == [
        "build.gradle", "src/main/java/App.java", "src/main/java/Tool.java", "sub/build.gradle",
        "src/main/java/OrderController.java",
    ]
    # examples outside the gathered files have no content
    assert matches(rows.filter("field = 'example_configs'"), "path") == {("application.yml.example",)}


def test_readme_quality(spark):
    pair = spark.createDataFrame(
        [("a", "long enough to be judged", "g"), ("b", "short", "g"), ("c", "long enough to be judged", "g"),
         ("d", "No original README found.", "g"), ("e", "long enough to be judged", "g")],
        "repo string, original_readme string, generated_readme string",
    )
    verdicts = spark.createDataFrame([("a", "x\nYES"), ("b", "NO"), ("e", "NO")], "repo string, output string")
    assert matches(quality.readme_quality(pair, verdicts), "repo", "recommendation", "reason") == {
        ("a", "OVERWRITE", "x\nYES"), ("b", "OVERWRITE", "README is empty or minimal"),
        ("c", "RESPECT_ORIGINAL", "Error during evaluation"),
        ("d", "OVERWRITE", "README is empty or minimal"), ("e", "RESPECT_ORIGINAL", "NO"),
    }
    asked = quality.evaluation_prompts(pair, ["sample {readme_content}"[:6]])
    assert matches(asked, "repo") == {("a",), ("c",), ("e",)}
    assert "    EXAMPLE 1:\n    ```\n    sample\n    ```\n" in asked.first().prompt


def test_plan_steps(spark):
    outputs = spark.createDataFrame(
        [("two", 1, "x"), ("two", 2, "x"), ("gap", 1, "x"), ("gap", 3, "x"), ("empty", 1, ""), ("all", 4, "x"), ("odd", 7, "x")],
        "repo string, step int, output string",
    )
    repos = outputs.select("repo").union(spark.createDataFrame([("none",)], "repo string")).distinct()
    made = {}
    for row in prompts.plan_steps(repos, outputs).collect():
        made.setdefault(row.repo, []).append(row.step)
    assert {k: sorted(v) for k, v in made.items()} == {
        "two": [3, 4], "gap": [4], "empty": [1, 2, 3, 4], "odd": [1, 2, 3, 4], "none": [1, 2, 3, 4],
    }
    assert {r.step for r in prompts.plan_steps(repos, outputs, 3).collect()} == {3, 4}
    assert {r.step for r in prompts.plan_steps(repos, outputs, 3, only=True).collect()} == {3}
    for arguments in ({"only": True}, {"start": 5}, {"start": 0, "only": True}):
        with pytest.raises(ValueError):
            prompts.plan_steps(repos, outputs, **arguments)


def test_completion_hook(spark):
    asked = spark.createDataFrame([("a", 1, "hello")], "repo string, step int, prompt string")

    def model(batches):
        for batch in batches:
            yield batch.assign(output=batch["prompt"].str.upper())[["repo", "step", "output"]]

    assert matches(prompts.run_completions(asked, model), "repo", "step", "output") == {("a", 1, "HELLO")}


def test_finalize(spark):
    outputs = spark.createDataFrame([("a", 4, "# T <!-- r -->"), ("a", 3, "d")], "repo string, step int, output string")
    row = prompts.finalize(outputs, "2024-01-31", "m").first()
    assert row.readme.startswith("# T\n\n######") and row.reasoning == "r"


def _pom(rng, n: int) -> str:
    parts = []
    for i in range(n):
        tags = [f"<groupId>g{i}</groupId>", f"<artifactId>a{i}</artifactId>", f"<version>{i}</version>"]
        kept = [t for t in tags if rng.random() < 0.8]
        rng.shuffle(kept)
        parts.append("<dependency>\n" + "\n".join(kept) + rng.choice(["</dependency>", "", "</dependency>"]))
    return "\n".join(parts)


def test_maven_pattern_takes_the_first_places(spark):
    rng = random.Random(5)
    poms = {f"d{i}/pom.xml": _pom(rng, 6) for i in range(60)}
    made = extract.maven_dependencies(make_files(spark, {"r": poms})).groupBy("path").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x.text).alias("t")
    )
    expected = {}
    for path, text in poms.items():
        found = [":".join(m) for m in re.findall(fv.MAVEN_DEPENDENCY, text)]
        if found:
            expected[path] = found
    assert {r.path: r.t for r in made.collect()} == expected


def test_dependencies_without_versions_are_quick(spark):
    entry = "<dependency><groupId>g</groupId><artifactId>a</artifactId></dependency>\n"
    files = make_files(spark, {"r": {"pom.xml": "<version>1</version>" + entry * 1200}})
    start = time.monotonic()
    assert extract.maven_dependencies(files).count() == 0
    assert time.monotonic() - start < 20


def test_quick_start_report(spark):
    files = make_files(
        spark,
        {
            "r": {
                **{f"src/main/java/M{i}.java": MAIN for i in range(5)},
                **{f"run{i}.sh": "" for i in range(5)},
                "build.gradle": "dependencies {" + "".join(f" api 'g:n{i:02d}:1'\n" for i in range(12)) + "}",
            }
        },
    )
    run = job.start_run(files, "java")
    report = profile.profile_report(run.corpus, run.profile, run.dependencies, form="quick_start")
    entries = "".join(f"- src/main/java/M{i}.java\n" for i in range(3))
    commands = "".join(f"- run: `./run{i}.sh`\n" for i in range(3))
    dependencies = "".join(f"- api 'g:n{i:02d}:1'\n" for i in range(10))
    assert report.first().text.endswith(
        "\n\n## Quick Start\n### Entry Points\n" + entries + "- ... and 2 more entry points\n\n"
        "### Build Commands\n" + commands + "  ... and 2 more run commands\n\n"
        "## Dependencies\n" + dependencies + "- ... and 2 more dependencies"
    )
    with pytest.raises(ValueError):
        profile.report_pieces(run.corpus, run.profile, run.dependencies, form="other")


def test_first_dependencies_are_those_of_the_files_with_the_highest_score(spark):
    def block(name):
        return "dependencies {" + "".join(f" api 'g:{name}{i:02d}:1'\n" for i in range(15)) + "}"

    repo = {
        "a/build.gradle": block("a"),  # score: gradle in the path
        "b/build.gradle": "id 'org.springframework.boot'\n" + block("b"),  # more: the boot plugin
        "src/A.java": "class A {}",
    }
    files = make_files(spark, {"r": repo})
    run = job.start_run(files, "java")
    first = [f"api 'g:b{i:02d}:1'" for i in range(15)] + [f"api 'g:a{i:02d}:1'" for i in range(15)]
    outputs = spark.createDataFrame([], "repo string, step int, output string")
    for n, want in ((20, first[:20]), (None, first), (3, first[:3])):
        made = contexts.draft_context(run.corpus, outputs, run.dependencies, n)
        found = made.filter("field = 'dependencies'").orderBy("ord").collect()
        assert [r.content for r in found] == want
    lines = profile.shown_dependencies(run.dependencies).orderBy("position").collect()
    assert [r.line for r in lines] == [*first[:20], "... and 10 more"]


def test_lists_tools_and_commands_are_in_the_order_of_the_score(spark):
    boot = "@SpringBootApplication class Z {}"
    files = make_files(spark, {"r": {
        "build.gradle": "", "src/Aaa.java": "", "src/ZController.java": "", "src/ZMain.java": boot,
        "a/readme.md": "x", "b/main-readme.md": "y", "a-stop.sh": "", "b-start.sh": "", "main-run.sh": "",
        "lombok.config": "", "docker-compose.yml": "",
    }})
    corpus = profile.survey_corpus(files, "java")
    rows = corpus.chosen(agg.repo_lists(corpus.survey)).collect()
    listed = lambda name: [r.path for r in sorted(rows, key=lambda r: r.ord) if r.list == name]
    assert listed("java_files") == ["src/ZMain.java", "src/ZController.java", "src/Aaa.java"]
    assert listed("readme_files") == ["b/main-readme.md", "a/readme.md"]
    assert listed("shell_scripts") == ["a-stop.sh", "b-start.sh", "main-run.sh"]
    commands = agg.command_groups(agg.command_facts(corpus.survey), extract.find_commands(corpus.survey)).orderBy("ord")
    assert [r.command for r in commands.collect()] == ["./main-run.sh", "./b-start.sh", "./a-stop.sh"]
    tools = extract.custom_tools(corpus.survey).orderBy("first_ord").collect()
    assert [r.tool for r in tools] == ["spring-boot", "docker"]
