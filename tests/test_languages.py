"""Languages that a caller adds, and prompts and completions in pieces."""

import pytest
from pyspark.sql import functions as F

from repoatlas.functions import paths as fp
from repoatlas.functions.languages import BUILT_IN, JAVA, PYTHON, LanguageRules, by_name
from repoatlas.operators import aggregate as agg
from repoatlas.operators.classify import classify, select_analyzer, survey_files
from repoatlas.plans import job, profile, prompts
from tests.helpers import make_files, matches

GO = LanguageRules(
    "go",
    markers=["go.mod", "cmd"],
    extensions=[".go", ".tmpl"],
    key_files=["go.mod", "main.go"],
    languages={".go": "Go", ".tmpl": "Template"},
    features={"has_go_main": lambda c: c.rlike(r"func\s+main\(\)"), "n_funcs": lambda c: F.regexp_count(c, F.lit("func "))},
    entry_point=lambda language: (language == "Go") & F.col("has_go_main"),
    score=lambda: F.col("n_funcs") * 7 + F.when(F.col("path").startswith("cmd/"), 11).otherwise(0),
    lists={"go_files": lambda: F.col("language") == "Go"},
    facts={"functions": lambda: F.sum("n_funcs"), "widest": lambda: F.max("size"), "none": lambda: F.max(F.lit(None).cast("int"))},
    overview="A Go module.",
)
MAIN = "package main\nfunc main() { }\nfunc other() { }\n"


@pytest.fixture(scope="module")
def files(spark):
    return make_files(
        spark,
        {
            "service": {
                "go.mod": "module x", "main.go": MAIN, "cmd/run/main.go": MAIN, "lib/a.go": "func a() {}",
                "vendor.txt": "x", "big.go": "func " + "y" * 200_000, "build/x.go": MAIN, "run.sh": "go run .",
            },
            "both": {"go.mod": "", "build.gradle": "", "src/App.java": "@SpringBootApplication class App {}"},
            "plain": {"a.txt": ""},
            "script": {"setup.py": "", "x.go": MAIN},
        },
    )


def test_a_language_is_chosen_by_its_place(files):
    first = {("service", "go"), ("both", "go"), ("plain", "java"), ("script", "python")}
    assert matches(select_analyzer(files, languages=(GO, *BUILT_IN)), "repo", "analyzer") == first
    last = {("service", "go"), ("both", "java"), ("plain", "java"), ("script", "python")}
    assert matches(select_analyzer(files, languages=(*BUILT_IN, GO)), "repo", "analyzer") == last
    alone = {(r, "go") for r in ("service", "both", "plain", "script")}
    assert matches(select_analyzer(files, languages=[GO]), "repo", "analyzer") == alone
    other = select_analyzer(files, languages=(GO, PYTHON), default="python")
    assert ("plain", "python") in matches(other, "repo", "analyzer")
    with pytest.raises(ValueError):
        select_analyzer(files, "go")
    with pytest.raises(ValueError):
        select_analyzer(files, languages=(GO, PYTHON), default="java")
    assert {r.analyzer for r in select_analyzer(files, "go", (GO,)).collect()} == {"go"}


def test_files_follow_the_rules_of_the_new_language(files):
    rows = {r.path: r for r in classify(files, languages=(*BUILT_IN, GO)).filter("repo = 'service'").collect()}
    assert set(rows) == {"go.mod", "main.go", "cmd/run/main.go", "lib/a.go", "run.sh"}
    assert [rows[p].language for p in ("main.go", "lib/a.go", "go.mod")] == ["Go", "Go", "Unknown"]
    assert [p for p in rows if rows[p].is_entry_point] == ["cmd/run/main.go"]  # main.go is a key file
    score = {p: rows[p].importance_score for p in rows}
    assert score == {"go.mod": 80, "main.go": 80 + 14, "cmd/run/main.go": 100 + 14 + 11, "lib/a.go": 7, "run.sh": 0}
    java = {r.path for r in classify(files, "java", languages=(*BUILT_IN, GO)).filter("repo = 'service'").collect()}
    assert java == {"run.sh"}


def test_built_in_results_stay_the_same_beside_a_new_language(files):
    built_in = files.filter("repo <> 'service'")
    columns = ["repo", "analyzer", "path", "language", "is_key_file", "is_entry_point", "is_config", "importance_score", "ord"]
    assert matches(classify(built_in, languages=(*BUILT_IN, GO)), *columns) == matches(classify(built_in), *columns)


def test_profile_lists_facts_and_report(files):
    run = job.start_run(files, languages=(*BUILT_IN, GO))
    row = run.profile.filter("repo = 'service'").first()
    assert (row.analyzer, row.primary_language, row.total_files, row.n_entry_points) == ("go", "Go", 5, 1)
    lists = run.corpus.chosen(agg.repo_lists(run.corpus.survey, run.corpus.languages))
    assert matches(lists.filter("list = 'go_files'"), "repo", "path") == {
        ("service", p) for p in ("main.go", "cmd/run/main.go", "lib/a.go")
    }
    assert matches(lists.filter("list = 'java_files'"), "repo", "path") == {("both", "src/App.java")}
    facts = run.corpus.chosen(agg.language_facts(run.corpus.survey, run.corpus.languages))
    assert matches(facts, "repo", "fact", "value") == {("service", "functions", "5"), ("service", "widest", str(len(MAIN)))}
    assert agg.language_facts(run.corpus.survey).count() == 0
    text = profile.profile_report(run.corpus, run.profile, run.dependencies).filter("repo = 'service'").first().text
    assert "## Overview\nA Go module." in text and "- cmd/run/main.go" in text
    picked = job.picked_contents(run).filter("repo = 'service' AND field = 'key_files_content'")
    assert "lib/a.go" in {r.path for r in picked.collect()}


def test_names_and_features_are_unique(files):
    for bad in ([], [GO, GO], [LanguageRules("auto")], [GO, LanguageRules("x", features=GO.features)],
                [LanguageRules("x", features={"has_boot": lambda c: c.contains("x")})]):
        with pytest.raises(ValueError):
            by_name(bad)
    assert by_name(BUILT_IN)["java"] is JAVA


def test_a_language_without_any_rule(files):
    bare = LanguageRules("bare")
    rows = matches(survey_files(files, "bare", languages=[bare]).filter("is_gathered AND repo = 'service'"), "path", "language")
    assert rows == {("run.sh", "Unknown")}


def test_path_functions_take_records(spark):
    df = spark.createDataFrame([("main.go",), ("x/main.go",), ("a.py",)], "path string")
    flags = df.select("path", fp.is_key_file(GO).alias("k"), fp.is_analyzable(GO).alias("a"), fp.detect_language(GO).alias("l"),
                      fp.is_candidate(languages=[GO]).alias("c"), fp.is_candidate().alias("b"))
    assert {tuple(r) for r in flags.collect()} == {
        ("main.go", True, True, "Go", True, False), ("x/main.go", False, True, "Go", True, False),
        ("a.py", False, False, "Unknown", False, True),
    }


# --- prompts in pieces -----------------------------------------------------------------------

def slots_of(spark):
    big = "line\n" * 50_000
    rows = [
        ("r", 1, "name", "", "r ${language} ${name}"), ("r", 1, "language", "", "J${formatted_analysis}\n\n"),
        ("r", 1, "formatted_analysis", "0", "\n\n\nreport $"), ("r", 1, "formatted_analysis", "1", "{key_files_content}"),
        ("r", 1, "formatted_analysis", "2", "${name} ${key_"), ("r", 1, "formatted_analysis", "3", "components}\n"),
        ("r", 1, "key_components", "", "\n\n\n\nK"), ("r", 1, "key_files_content", "b", "B${key_files_content}\n"),
        ("r", 1, "key_files_content", "a", None), ("r", 1, "key_files_content", "c", "\n" + big),
        ("r", 1, "entry_points", "", ""), ("r", 3, "project_purpose", "", ""), ("r", 3, "name", "", "${usage_instructions}"),
        ("r", 4, "original_readme", "", "é" * 3000 + "${generated_readme}${original_readme}"), ("r", 4, "generated_readme", "", "\n"),
        ("s", 2, "shell_scripts", "2", "\n\n"), ("s", 2, "shell_scripts", "1", "\n"), ("t", 7, "name", "", "no such step"),
        (None, 1, "name", "", "nameless"),
    ]
    return spark.createDataFrame(rows, "repo string, step int, slot string, ord string, text string")


@pytest.mark.parametrize("size", [1, 7, 5000])
def test_pieces_are_the_prompt(spark, size):
    slots, steps = slots_of(spark), prompts.default_steps(spark)
    if size == 1:
        slots = slots.filter("length(text) < 1000")
    want = {(r.repo, r.step): r.prompt for r in prompts.build_prompts(slots, steps).collect()}
    rows = prompts.streamed_prompts(slots, steps, size).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.repo or "", r.step, r.part)):
        got.setdefault((r.repo, r.step), []).append(r.text)
    assert {k: "".join(v) for k, v in got.items()} == want and len(want) == 5
    assert all(len(t) == size for v in got.values() for t in v[:-1]) and all(t for v in got.values() for t in v)


def test_values_beyond_memory_are_read_again(tmp_path):
    from repoatlas.functions.stream_text import PIECE, SlotValues

    values = SlotValues(in_memory=100)
    for i in range(30):
        values.add("a", f"é{i}" * 200)
        if i % 3 == 0:
            values.add("b", "x" * PIECE)
    for _ in range(2):
        assert "".join(values.pieces("a")) == "".join(f"é{i}" * 200 for i in range(30))
        assert "".join(values.pieces("b")) == "x" * PIECE * 10
    assert values.is_empty("c") and not values.is_empty("a") and list(values.pieces("c")) == []
    values.close()


def test_completions_over_pieces(spark):
    slots, steps = slots_of(spark), prompts.default_steps(spark)

    def first_words(repo, step, pieces):
        if repo == "s":
            return None
        text = next(pieces)
        return f"{repo} {step} {len(text)}"

    for pieces in (prompts.streamed_prompts(slots, steps, 10), prompts.prompt_pieces(slots, steps).repartition(7)):
        rows = prompts.run_completions(pieces, first_words).collect()
        assert {(r.repo, r.step) for r in rows} == {("r", 1), ("r", 3), ("r", 4), ("s", 2), (None, 1)} and len(rows) == 5
        assert {r.output for r in rows if r.repo == "s"} == {None}
    whole = prompts.run_completions(
        prompts.streamed_prompts(slots, steps, 10), lambda repo, step, pieces: str(sum(map(len, pieces))))
    built = prompts.build_prompts(slots, steps).selectExpr("repo", "step", "CAST(length(prompt) AS string) output")
    assert matches(whole, "repo", "step", "output") == matches(built, "repo", "step", "output")


def test_small_pieces_go_in_few_batches():
    import pyarrow as pa

    from repoatlas.functions.batches import CHARS, ROWS, batches_of, rows_of

    rows = [("r", i, i, "x" * 1000) for i in range(9000)] + [("r", 1, 1, "y" * 2 * CHARS), ("s", 1, 1, None)]
    made = list(batches_of(iter(rows), prompts._PIECES, 3))
    assert len(made) < 9 and max(b.num_rows * 1000 for b in made) <= CHARS + 1000
    assert [b.schema for b in made] == [prompts._PIECES] * len(made)
    assert list(rows_of(made, "repo", "step", "part", "text")) == rows

    class Once:  # a batch that tells which parts of it are asked for
        parts: list[int] = []

        def select(self, columns):
            return self

        num_rows = 150

        def slice(self, at, n):
            self.parts.append(n)
            return pa.RecordBatch.from_pydict({"a": [*range(at, min(at + n, 150))]})

    batch = Once()
    assert list(rows_of([batch], "a")) == [(i,) for i in range(150)] and set(batch.parts) == {ROWS}


def test_a_token_across_pieces_is_found():
    from repoatlas.functions.stream_text import replaced

    for text in ("a${b}c", "$${b}", "${${b}${b", "", "$", "x$${", "${b}${b}", "aa"):
        for n in range(1, 6):
            pieces = [text[i : i + n] for i in range(0, len(text), n)]
            assert "".join(replaced(pieces, "${b}", lambda: ["<", "${b}"])) == text.replace("${b}", "<${b}")
            twice = text.replace("$", "a").replace("{", "a")
            own = [twice[i : i + n] for i in range(0, len(twice), n)]
            assert "".join(replaced(own, "aab", lambda: ["-"])) == twice.replace("aab", "-")
