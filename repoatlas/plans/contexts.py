"""What each step of the documentation run is told about a repo.

A context is a set of rows ``repo, step, field, path, ord, content``, because some fields
hold as many files as a repo has entry points or controllers.  Files are picked from the
narrow survey first; the picks of several steps are looked up together, so each wanted
content is read and moved once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.functions import content as fc
from repoatlas.functions import paths as fp
from repoatlas.functions import text as ft
from repoatlas.operators import aggregate as agg
from repoatlas.operators import extract
from repoatlas.operators.classify import REPO
from repoatlas.operators.joins import content_lookup, key_paths, original_readme, readme_pair
from repoatlas.operators.rank import first_n
from repoatlas.plans.profile import Corpus
from repoatlas.plans.quality import readme_quality


def _rows(rows: DataFrame, step: int, field: str, path="path", content=None) -> DataFrame:
    text = F.lit(None).cast("string") if content is None else F.col(content)
    return rows.select(
        "repo", F.lit(step).alias("step"), F.lit(field).alias("field"),
        F.col(path).alias("path"), "ord", text.alias("content"),
    )


# -- picked files -----------------------------------------------------------

def _picks(corpus: Corpus, files: DataFrame, step: int, field: str) -> DataFrame:
    return corpus.chosen(files).select(
        "repo", F.lit(step).alias("step"), F.lit(field).alias("field"), "path", "ord"
    )


def _filled(corpus: Corpus) -> DataFrame:
    """Gathered files that have some content."""
    return corpus.survey.filter("is_gathered AND is_non_blank")


def purpose_picks(corpus: Corpus, n: int | None = fv.TOP_FILES_STEP_1) -> DataFrame:
    """Step 1: entry points, key files and the best ``n`` (None: all) files."""
    paths = key_paths(corpus.survey.filter("is_gathered"), n)
    return _picks(corpus, paths, 1, "key_files_content")


def usage_picks(corpus: Corpus, n_configs: int | None = fv.CONFIGS_IN_STEP_2) -> DataFrame:
    """Step 2: what runs, builds and serves the repo, and ``n_configs`` configuration files."""
    p = F.col("path")
    shown = F.col("is_entry_point") | p.isin("build.gradle", "docker-compose.yml")
    shown = shown | F.lower(p).contains("controller")
    priority = (
        F.when(p == "build.gradle", F.lit("0"))
        .when(F.col("is_entry_point"), F.lit("1"))
        .otherwise(F.lit("2"))
    )
    by_priority = _filled(corpus).filter(shown).withColumn("ord", F.concat(priority, "ord"))
    configs = corpus.survey.filter(agg.is_config_listed()).select(
        *REPO, "path", "is_gathered", agg.config_order().alias("ord")
    )
    first_configs = first_n(configs, n_configs, REPO).filter("is_gathered")
    examples = _filled(corpus).filter("is_example_config").withColumn("ord", p)
    return (
        _picks(corpus, by_priority, 2, "key_files_content")
        .unionByName(_picks(corpus, first_configs, 2, "config_files"))
        .unionByName(_picks(corpus, examples, 2, "example_configs"))
    )


def draft_picks(corpus: Corpus, n: int | None = fv.TOP_FILES_STEP_3) -> DataFrame:
    """Step 3: entry points, key files and the best ``n`` (None: all) files."""
    paths = key_paths(corpus.survey.filter("is_gathered"), n)
    return _picks(corpus, paths, 3, "key_files_content")


def original_picks(corpus: Corpus) -> DataFrame:
    """Step 4: the README a repo has already."""
    best = original_readme(corpus.survey.filter("is_gathered"))
    return _picks(corpus, best, 4, "original_readme")


def look_up(corpus: Corpus, picks: DataFrame) -> DataFrame:
    """Context rows of the picks, with their contents.

    Contents of files no analyzer gathers are left out by their path, before the join.
    """
    named = fp.is_candidate(languages=corpus.languages)
    wanted = corpus.files.filter(named & (F.col("size") <= corpus.max_size))
    return content_lookup(picks, wanted).select(
        "repo", "step", "field", "path", "ord", "content"
    )


# -- C7 ---------------------------------------------------------------------

def base_context(profile: DataFrame) -> DataFrame:
    """Columns all steps share."""
    return profile.select(
        "repo",
        "analyzer",
        F.col("repo").alias("name"),
        F.col("primary_language").alias("language"),
        F.col("has_spring_boot").alias("is_spring_boot"),
        F.col("type").alias("build_system"),
        "custom_tools",
        F.col("language_stats").alias("file_breakdown"),
        "n_entry_points",
        "n_shell_scripts",
        "n_root_shell_scripts",
    )


def base_rows(corpus: Corpus, profile: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """Context rows that all steps share, without a step: facts, lists, report, existing READMEs.

    ``repo, field, path, ord, content``. Facts are one row each, tools and languages one per
    item, paths one per file. Scripts at the root are listed a second time after all scripts.
    ``report`` are the rows of `profile.profile_report`.
    """

    def item(field: str, content, order=None):
        return F.struct(
            F.lit(field).alias("field"), F.lit("").alias("path"),
            (F.lit("") if order is None else F.lpad(order.cast("string"), 9, "0")).alias("ord"),
            content.cast("string").alias("content"),
        )

    base = base_context(profile)
    facts = [item(f, F.col(f)) for f in ("name", "language", "is_spring_boot", "build_system")]
    shown = F.concat(
        F.array(*facts),
        F.transform("custom_tools", lambda tool, i: item("custom_tools", tool, i)),
        F.transform(
            "file_breakdown",
            lambda x, i: item("file_breakdown", F.concat_ws(": ", x.language, x.n.cast("string")), i),
        ),
    )
    rows = base.select("repo", F.inline(shown))
    kinds = {"entry_points": ("entry_points", ""), "shell_scripts": ("shell_scripts", "0"),
             "root_shell_scripts": ("shell_scripts", "1")}
    field, lead = F, F
    for name, (of, order) in kinds.items():
        field = field.when(F.col("list") == name, F.lit(of))
        lead = lead.when(F.col("list") == name, F.lit(order))
    lists = corpus.chosen(agg.repo_lists(corpus.survey, corpus.languages).filter(F.col("list").isin([*kinds])))
    rows = rows.unionByName(lists.select(
        "repo", field.alias("field"), "path", F.concat(lead, "ord").alias("ord"),
        F.lit(None).cast("string").alias("content"),
    ))
    readable = corpus.files.filter(F.col("size") <= corpus.max_size)
    readmes = corpus.chosen(agg.readme_contents(readable, corpus.survey))
    rows = rows.unionByName(
        readmes.select("repo", F.lit("existing_readme").alias("field"), "path", "ord", "content")
    )
    if report is None:
        return rows
    return rows.unionByName(report.select(
        "repo", F.lit("formatted_analysis").alias("field"), F.lit("").alias("path"),
        F.col("part").alias("ord"), F.col("text").alias("content"),
    ))


def step_context(
    corpus: Corpus, profile: DataFrame, step: int | None = None, report: DataFrame | None = None,
    step_outputs: DataFrame | None = None, dependencies: DataFrame | None = None,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """``repo, step, field, path, ord, content``: all that a step is told, in one form.

    The rows of `base_rows` and those of the step itself. Step 3 needs ``step_outputs`` and
    ``dependencies``, step 4 ``step_outputs`` and ``verdicts``; with no step there are only the
    shared rows, under step 0. Where the shared rows and the step have the same list, as the
    scripts of step 2 and the report of step 1, it is there once.
    """
    columns = ["repo", "step", "field", "path", "ord", "content"]
    base = base_rows(corpus, profile, report)
    if step is None:
        return base.withColumn("step", F.lit(0)).select(*columns)
    if step == 1:
        own = purpose_context(corpus)
    elif step == 2:
        own = look_up(corpus, usage_picks(corpus)).unionByName(
            usage_lists(corpus, profile).filter("field = 'run_commands'")
        )
    elif step == 3:
        own = draft_context(corpus, step_outputs, dependencies)
    elif step == 4:
        final = optimize_context(corpus_readme_pair(corpus, step_outputs), verdicts)
        fields = [name for name in final.columns if name != "repo"]
        made = F.array(*[
            F.struct(
                F.lit(f).alias("field"), F.lit("").alias("path"), F.lit("").alias("ord"),
                F.col(f).cast("string").alias("content"),
            ) for f in fields
        ])
        own = final.select("repo", F.lit(4).alias("step"), F.inline(made))
    else:
        raise ValueError(f"step must be one of 1 to 4 or None, not {step!r}")
    return base.withColumn("step", F.lit(step)).select(*columns).unionByName(own.select(*columns))


# -- C3 ---------------------------------------------------------------------

def purpose_context(
    corpus: Corpus, report: DataFrame | None = None, n: int | None = fv.TOP_FILES_STEP_1
) -> DataFrame:
    """Step 1: the report, and the key paths with their contents."""
    files = look_up(corpus, purpose_picks(corpus, n))
    if report is None:
        return files
    analysis = report.select("repo", F.lit("").alias("path"), F.col("part").alias("ord"), "text")
    return files.unionByName(_rows(analysis, 1, "formatted_analysis", content="text"))


# -- C4 ---------------------------------------------------------------------

def usage_lists(corpus: Corpus, facts: DataFrame) -> DataFrame:
    """Step 2 without contents: commands and scripts.

    ``facts`` is the profile, or `aggregate.command_facts`.
    """
    commands = agg.command_groups(facts, extract.find_commands(corpus.survey))
    fields = F.array_compact(
        F.array(
            F.lit("shell_scripts"), F.when(F.col("is_root_shell"), F.lit("root_shell_scripts"))
        )
    )
    scripts = (
        corpus.chosen(corpus.survey.filter("is_gathered AND is_shell"))
        .select("repo", F.explode(fields).alias("field"), "path", "ord")
        .select(
            "repo", F.lit(2).alias("step"), "field", "path", "ord",
            F.lit(None).cast("string").alias("content"),
        )
    )
    return _rows(corpus.chosen(commands), 2, "run_commands", "kind", "command").unionByName(scripts)


def usage_context(corpus: Corpus, facts: DataFrame) -> DataFrame:
    """Step 2: everything about running and configuring a repo."""
    return look_up(corpus, usage_picks(corpus)).unionByName(usage_lists(corpus, facts))


# -- C5 ---------------------------------------------------------------------

def earlier_outputs(step_outputs: DataFrame) -> DataFrame:
    """Outputs of steps 1 and 2 as context rows of step 3."""
    field = F.when(F.col("step") == 1, F.lit("project_purpose")).otherwise(
        F.lit("usage_instructions")
    )
    return (
        step_outputs.filter(F.col("step").isin(1, 2))
        .select(
            "repo", F.lit(3).alias("step"), field.alias("field"), F.lit("").alias("path"),
            F.lit("").alias("ord"), fc.strip(F.col("output")).alias("content"),
        )
        .filter(F.col("content") != "")
    )


def draft_context(
    corpus: Corpus, step_outputs: DataFrame, dependencies: DataFrame,
    n: int | None = fv.DEPENDENCIES_SHOWN,
) -> DataFrame:
    """Step 3: outputs of steps 1 and 2, the first ``n`` (None: all) dependencies, entry
    points, key contents."""
    java = corpus.analyzers.filter(F.col("analyzer") == "java").select("repo")
    first = first_n(dependencies.select("repo", "text", "ord"), n, ["repo"])
    listed = (
        first.filter(fc.non_blank(F.col("text")))
        .join(java, "repo", "left_semi")
        .withColumn("path", F.lit(""))
    )
    entries = corpus.chosen(corpus.survey.filter("is_entry_point")).withColumn(
        "line", ft.bullet(F.col("path"))
    )
    return (
        earlier_outputs(step_outputs)
        .unionByName(_rows(listed, 3, "dependencies", content="text"))
        .unionByName(_rows(entries, 3, "entry_points_formatted", content="line"))
        .unionByName(look_up(corpus, draft_picks(corpus)))
    )


# -- C6 ---------------------------------------------------------------------

def optimize_context(pair: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Step 4: both READMEs of a repo, the evaluation and the recommendation."""
    return readme_quality(pair, verdicts, keep_texts=True).select(
        "repo", "original_readme", "generated_readme",
        F.col("reason").alias("readme_evaluation"),
        F.col("recommendation").alias("readme_recommendation"),
        "is_low_quality",
    )


def corpus_readme_pair(corpus: Corpus, step_outputs: DataFrame) -> DataFrame:
    """README pair of every repo of the corpus."""
    originals = look_up(corpus, original_picks(corpus))
    return readme_pair(corpus.analyzers, originals, step_outputs)
