"""One registered query per operator, each over whole input tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.catalog import stored, views
from repoatlas.functions import content as fc
from repoatlas.functions import paths as fp
from repoatlas.functions import score as fs
from repoatlas.functions import text as ft
from repoatlas.functions.languages import BUILT_IN, LanguageRules
from repoatlas.operators import aggregate as agg
from repoatlas.operators import extract, joins, rank
from repoatlas.operators.classify import (
    REPO, choose, classify, gathered, select_analyzer, survey_files,
)
from repoatlas.operators.gather import gather_text
from repoatlas.plans import contexts, job, profile, prompts, quality
from repoatlas.sources import scan, sinks
from repoatlas.sources.scratch import save_table, scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

MODEL = "model-a"
DATE = "2024-01-31"
SMALL = 16384
CRITERIA = {"main": 20, "acme": 7, "order": 11, "example": 5, ".yml": 3, "src": 2}
TYPE_SCORES = {".yml.example": 9, ".example": 8, ".java": 6, ".py": 5, ".js": 4, ".md": 3}
CONTENT_SCORES = {
    ".java": {r"@\w+": 4, r"public|class": 2},
    ".md": {r"TODO": 9, r"[A-Z]\w+": 1},
    "n.yml": {r"\w+:": 3},
}
WORDS = ["der", "the", "LICENSE", "copyright", "http", "password", "zzz"]
NAMED_PATTERNS = {
    "mail": r"[a-z.]+@[a-z.]+",
    "assigned": r"(\w+) ?= ?\w+",
    "lines": r"[.]\n.\w+",
}
#: A fourth language, as a caller would add it.
SCRIPTS = LanguageRules(
    "scripts",
    markers=["app.py", "ops"],
    extensions=[".sh", ".ts", ".md"],
    key_files=["app.py"],
    languages={".sh": "Shell", ".ts": "TypeScript", ".md": "Markdown", ".yml": "YAML"},
    features={
        "n_articles": lambda content: F.regexp_count(content, F.lit("the ")),
        "has_shebang": lambda content: content.startswith("#!"),
    },
    entry_point=lambda language: (
        ((language == "Shell") & F.col("has_shebang")) | F.col("path").startswith("scripts/")
    ),
    score=lambda: F.col("n_articles") * 2 + fs.points(F.col("path").contains("scripts"), 40),
    lists={"notes": lambda: (F.col("language") == "Markdown") & F.col("is_non_blank")},
    facts={"articles": lambda: F.sum("n_articles"), "largest": lambda: F.max("size")},
    overview="Scripts and their notes.",
)
FOUR_LANGUAGES = (SCRIPTS, *BUILT_IN)


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def _chosen_survey(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    files = views.files(spark, sf_dir)
    return survey_files(files), select_analyzer(files)


def _corpus(spark, sf_dir) -> profile.Corpus:
    return profile.survey_corpus(views.files(spark, sf_dir))


def _dependencies(corpus: profile.Corpus) -> DataFrame:
    return extract.find_dependencies(extract.readable_files(corpus.files))


def _digest(column: str = "content") -> Column:
    return F.md5(F.coalesce(F.col(column), F.lit(""))).alias("digest")


def _flags(spark, sf_dir, **flags: Column) -> DataFrame:
    return views.files(spark, sf_dir).select(
        "repo", "path", *[column.alias(name) for name, column in flags.items()]
    )


# -- scans and sinks --------------------------------------------------------

@query
def s1_scan_repos(spark, sf_dir):
    folder = scratch_folder(spark)
    views.files(spark, sf_dir).write.parquet(folder)
    return scan.scan_repos(spark, folder).select("repo", "path", "size", _digest())


@query
def s1_archive_members(spark, sf_dir):
    """An archive per source, plain or compressed; one holds a third of all files at times."""
    files = scan.scan_repos(spark, stored.corpus_archives(spark, sf_dir), "archive", max_size=None)
    return files.select("repo", "path", "size", _digest())


@query
def s1_hidden_names(spark, sf_dir):
    files = scan.scan_repos(spark, stored.corpus_folders(spark, sf_dir), "directory", max_size=None)
    return files.select("repo", "path", "size", _digest())


@query
def s1_truncated_archives(spark, sf_dir):
    """Archives that end in the middle: their members before that, and a row of the failure."""
    folder = stored.corpus_archives(spark, sf_dir, halves=True)
    files = scan.scan_repos(spark, folder, "archive", max_size=None, errors="rows")
    return files.select("repo", "path", "size", _digest(), F.col("error").isNotNull().alias("failed"))


@query
def s5_unreadable_files(spark, sf_dir):
    """Records of files in damaged archives; the size limit leaves larger files without content."""
    folder = stored.corpus_archives(spark, sf_dir, halves=True)
    files = scan.scan_repos(spark, folder, "archive", max_size=SMALL, errors="rows")
    return scan.file_info(files, SMALL).select(
        "repo", "path", F.coalesce("size", F.lit(-1)).alias("size"),
        F.coalesce("language", F.lit("")).alias("language"),
        F.col("content").isNotNull().alias("has_content"), _digest(),
        F.col("error").isNotNull().alias("failed"),
    )


@query
def s2_read_text(spark, sf_dir):
    raw = F.concat("content", F.lit("\r\nnext\rlast\n")).cast("binary")
    files = views.files(spark, sf_dir).withColumn("content", raw)
    return scan.read_text(files, SMALL).select("repo", "path", "size", _digest())


@query
def s3_find_by_extension(spark, sf_dir):
    files = views.files(spark, sf_dir)
    return scan.find_by_extension(files, [".java", ".yml", ".py", ".md"]).select("repo", "path")


@query
def s4_find_by_pattern(spark, sf_dir):
    return scan.find_by_pattern(views.files(spark, sf_dir), "er").select("repo", "path")


@query
def s5_file_info(spark, sf_dir):
    return scan.file_info(views.files(spark, sf_dir), SMALL).select(
        "repo", "path", "size", "is_key_file", "is_entry_point", "is_config", "language",
        F.col("content").isNotNull().alias("has_content"), _digest(),
        F.coalesce("error", F.lit("")).alias("error"),
    )


@query
def s6_scan_step_templates(spark, sf_dir):
    return scan.scan_step_templates(views.step_files(spark, sf_dir))


@query
def s7_scan_step_outputs(spark, sf_dir):
    return scan.scan_step_outputs(views.step_outputs(spark, sf_dir), 3)


@query
def k1_write_contexts(spark, sf_dir):
    folder = scratch_folder(spark)
    rows = contexts.purpose_context(_corpus(spark, sf_dir))
    sinks.write_contexts(rows, folder)
    return spark.read.schema(rows.schema).json(folder).select(
        "repo", "step", "field", "path", _digest()
    )


@query
def k2_write_profile(spark, sf_dir):
    folder = scratch_folder(spark)
    table = profile.profile_repos(_corpus(spark, sf_dir))
    sinks.write_profile(table, folder)
    return spark.read.schema(table.schema).json(folder).select(
        "repo", "analyzer", "primary_language", "total_files", "has_spring_boot",
        F.size("top_files").alias("n_top_files"),
    )


@query
def k2_saved_profile(spark, sf_dir):
    """Profile and path lists written together, read back and shown by value."""
    folder = scratch_folder(spark)
    corpus = _corpus(spark, sf_dir)
    lists = corpus.chosen(agg.repo_lists(corpus.survey, corpus.languages))
    sinks.write_saved_profile(profile.profile_repos(corpus), lists, folder)
    saved = sinks.read_tables(spark, folder)

    def item(name: str, position: Column, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), position.cast("int").alias("position"), value.cast("string").alias("value"))

    facts = ("analyzer", "primary_language", "total_files", "n_config_files", "type")
    shown = F.concat(
        F.array(*[item(f, F.lit(0), F.col(f)) for f in facts]),
        F.transform("top_files", lambda x, i: item("top_files", i + 1, F.concat_ws(":", x.path, x.language, x.score.cast("string")))),
        F.transform("custom_tools", lambda x, i: item("custom_tools", i + 1, x)),
    )
    placed = rank.first_n(saved["lists"], None, ["repo", "list"])
    return saved["profile"].select("repo", F.inline(shown)).unionByName(
        placed.select("repo", F.col("list").alias("name"), F.col("rank").alias("position"), F.col("path").alias("value"))
    )


@query
def k1_write_all_contexts(spark, sf_dir):
    """What all steps are told, written and read back."""
    folder = scratch_folder(spark)
    rows = _step_contexts(spark, sf_dir).filter("step > 0")
    sinks.write_contexts(rows, folder)
    return spark.read.schema(rows.schema).json(folder).select("repo", "step", "field", "path", _digest())


@query
def k3_write_all_prompts(spark, sf_dir):
    folder = scratch_folder(spark)
    made = job.prompt_batch(_all_slots(spark, sf_dir), prompts.default_steps(spark))
    sinks.write_prompts(made, folder)
    return spark.read.parquet(folder).select("repo", "step", "prompt")


@query
def k3_write_prompts(spark, sf_dir):
    folder = scratch_folder(spark)
    sinks.write_prompts(_step3_prompts(spark, sf_dir), folder)
    return spark.read.parquet(folder).select("repo", "step", "prompt")


def _page_outputs(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("repo"),
        (F.col("page_id") % 2 + 3).cast("int").alias("step"),
        F.col("html").alias("output"),
    )


@query
def k4_write_step_outputs(spark, sf_dir):
    folder = scratch_folder(spark)
    outputs = _page_outputs(spark, sf_dir)
    sinks.write_step_outputs(outputs, folder)
    # a second write of one step leaves the other one as it is
    sinks.write_step_outputs(outputs.filter("step = 4"), folder)
    return spark.read.parquet(folder).select(
        "repo", "step", _digest("output"), F.coalesce("reasoning", F.lit("-")).alias("reasoning")
    )


@query
def k5_write_readmes(spark, sf_dir):
    folder = scratch_folder(spark)
    final = _page_outputs(spark, sf_dir).select("repo", F.col("output").alias("readme"))
    sinks.write_readmes(final, folder, MODEL, DATE)
    return spark.read.parquet(folder).select("repo", _digest("readme"))


@query
def k6_artifact_name(spark, sf_dir):
    kinds = ["step", "output", "context", "prompt", "reasoning", "profile", "final",
             "final_reasoning"]
    return views.step_outputs(spark, sf_dir).select(
        "repo", "step",
        *[
            ft.artifact_name(kind, F.col("repo"), F.col("step"), MODEL).alias(kind + "_name")
            for kind in kinds
        ],
    )


# -- predicates -------------------------------------------------------------

@query
def p1_exclude_dirs(spark, sf_dir):
    return _flags(
        spark, sf_dir,
        by_segment=fp.in_excluded_dir(), by_substring=fp.in_excluded_dir(match="substring"),
        own_dirs=fp.in_excluded_dir(dirs=["com", "docs"]),
    )


@query
def p2_analyzable(spark, sf_dir):
    return _flags(
        spark, sf_dir,
        java=fp.is_analyzable("java"), python=fp.is_analyzable("python"),
        javascript=fp.is_analyzable("javascript"),
        java_strict=fp.is_analyzable("java", readme_md=False),
    )


@query
def p3_key_file(spark, sf_dir):
    return _flags(
        spark, sf_dir,
        java=fp.is_key_file("java"), python=fp.is_key_file("python"),
        javascript=fp.is_key_file("javascript"),
    )


@query
def p4_is_sonar(spark, sf_dir):
    return _flags(spark, sf_dir, flag=fp.is_sonar())


@query
def p5_is_ci_file(spark, sf_dir):
    p = F.when(F.col("path") == "README.md", F.lit(".gitlab-ci.yml")).otherwise(F.col("path"))
    return _flags(spark, sf_dir, flag=fp.is_ci_file(p))


@query
def p6_is_config(spark, sf_dir):
    return _flags(spark, sf_dir, flag=fp.is_config())


@query
def p7_is_config_lite(spark, sf_dir):
    return _flags(spark, sf_dir, flag=fp.is_config_lite())


@query
def p8_is_shell(spark, sf_dir):
    return _flags(spark, sf_dir, is_shell=fp.is_shell(), is_root_shell=fp.is_root_shell())


@query
def p9_is_example_config(spark, sf_dir):
    return _flags(
        spark, sf_dir, by_path=fp.is_example_config(), by_name=fp.is_example_config(on="name")
    )


@query
def p10_is_special_config(spark, sf_dir):
    return _flags(
        spark, sf_dir, special=fp.is_special_config(),
        config=fp.is_config() | fp.is_special_config(),
    )


@query
def p11_is_entry_point(spark, sf_dir):
    return classify(views.files(spark, sf_dir)).select("repo", "path", "is_entry_point")


@query
def p12_is_readme(spark, sf_dir):
    return _flags(spark, sf_dir, flag=fp.is_readme())


@query
def p13_is_original_readme(spark, sf_dir):
    return _flags(spark, sf_dir, flag=fp.is_original_readme())


@query
def p14_non_blank(spark, sf_dir):
    blanked = F.when(F.col("doc_id") % 5 == 0, F.lit(" \n\t ")).otherwise(F.col("text"))
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", fc.non_blank(F.col("text")).alias("text"), fc.non_blank(blanked).alias("blanked")
    )


@query
def p15_contains_any(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.array_join(fc.contains_any(WORDS, "text"), ",").alias("exact"),
        F.array_join(fc.contains_any(WORDS, "text", case_sensitive=False), ",").alias("any_case"),
    )


@query
def p16_has_framework(spark, sf_dir):
    return _flags(spark, sf_dir, flag=fc.has_framework(fp.detect_language("java")))


# -- joins ------------------------------------------------------------------

@query
def j1_merge_passes(spark, sf_dir):
    files = views.files(spark, sf_dir).select("repo", "path", "size")
    keys = files.filter(fp.is_key_file("java"))
    walked = files.filter(fp.is_analyzable("java") & ~fp.in_excluded_dir())
    return joins.merge_passes(keys, walked)


@query
def j2_content_lookup(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    best = choose(rank.top_n(gathered(survey), 5), analyzers).select("repo", "path", "rank")
    return joins.content_lookup(best, views.files(spark, sf_dir)).select(
        "repo", "path", "rank", _digest()
    )


@query
def j3_key_paths(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    return choose(joins.key_paths(gathered(survey), 3), analyzers).select("repo", "path")


@query
def j4_config_union(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    first = rank.first_n(agg.config_union(survey), 4, REPO)
    return choose(first, analyzers).select("repo", "path", "rank")


@query
def j5_split_key_files(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    keys = survey.filter("is_gathered AND is_key_file")
    return choose(keys, analyzers).select("repo", "path", fp.key_file_category().alias("category"))


@query
def j6_readme_pair(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    return contexts.corpus_readme_pair(corpus, views.corpus_outputs(spark, sf_dir))


def _completions(spark, sf_dir) -> DataFrame:
    """Every turn as the output of a step, but for those left open by a rule on the key."""
    turns = views.table(spark, sf_dir, "conversations").filter("(conv_id + turn + 1) % 3 <> 0")
    return turns.select(
        F.col("conv_id").cast("string").alias("repo"),
        (F.col("turn") + 1).cast("int").alias("step"),
        F.col("text").alias("output"),
    )


def _asked(spark, sf_dir) -> DataFrame:
    return views.step_outputs(spark, sf_dir).select(
        "repo", "step", F.col("output").alias("prompt")
    )


@query
def j7_attach_completions(spark, sf_dir):
    joined = joins.attach_completions(_asked(spark, sf_dir), _completions(spark, sf_dir))
    failed = joins.failed_steps(_asked(spark, sf_dir), _completions(spark, sf_dir))
    return joined.select(
        "repo", "step", F.md5("prompt").alias("asked"),
        F.coalesce("output", F.lit("")).alias("output"), F.lit(False).alias("failed"),
    ).unionByName(failed.select(
        "repo", "step", F.lit("").alias("asked"), F.lit("").alias("output"), F.lit(True).alias("failed")
    ))


@query
def j8_pending_repos(spark, sf_dir):
    outputs = views.step_outputs(spark, sf_dir)
    return joins.pending_steps(outputs.select("repo").distinct(), _completions(spark, sf_dir))


# -- aggregates -------------------------------------------------------------

@query
def a1_language_stats(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    return choose(agg.language_stats(survey), analyzers).select("repo", "language", "n")


@query
def a2_language_breakdown(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    stats = choose(agg.language_stats(survey), analyzers)
    return agg.language_breakdown(stats).select("repo", "analyzer", "language", "n")


@query
def a3_primary_language(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    table = agg.primary_language(agg.language_stats(survey))
    return choose(table, analyzers).select("repo", "primary_language")


@query
def a4_select_analyzer(spark, sf_dir):
    return select_analyzer(views.files(spark, sf_dir))


@query
def a5_repo_counts(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    return choose(agg.repo_counts(survey), analyzers)


@query
def a6_repo_lists(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    return choose(agg.repo_lists(survey), analyzers).select("repo", "list", "path")


@query
def a6_list_order(spark, sf_dir):
    """Every list with the places of its paths."""
    survey, analyzers = _chosen_survey(spark, sf_dir)
    placed = rank.first_n(agg.repo_lists(survey), None, [*REPO, "list"])
    return choose(placed, analyzers).select("repo", "list", "path", "rank")


@query
def a7_content_maps(spark, sf_dir):
    files = views.files(spark, sf_dir)
    readmes = choose(
        agg.readme_contents(files, survey_files(files)), select_analyzer(files)
    )
    return agg.content_maps(readmes).select(
        "repo", F.explode("contents").alias("path", "content")
    ).select("repo", "path", _digest())


@query
def a8_custom_tools(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    return choose(extract.custom_tools(survey), analyzers).select("repo", "tool")


@query
def a8_tool_order(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    placed = rank.first_n(extract.custom_tools(survey), None, REPO, "first_ord")
    return choose(placed, analyzers).select("repo", "tool", "rank")


@query
def a9_build_system(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    return choose(agg.build_system(survey), analyzers).drop("analyzer")


@query
def a10_last_completed_step(spark, sf_dir):
    return agg.last_completed_step(_completions(spark, sf_dir))


@query
def a11_combine_outputs(spark, sf_dir):
    return agg.combine_outputs(views.step_outputs(spark, sf_dir), 4)


@query
def a12_group_api(spark, sf_dir):
    return agg.group_api(views.api_patterns(spark, sf_dir)).select("repo", "type", "lines")


@query
def a13_mapping_annotations(spark, sf_dir):
    return _flags(
        spark, sf_dir, mappings=fc.mapping_annotations(), stereotypes=fc.stereotype_annotations()
    )


@query
def a14_command_groups(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    groups = agg.command_groups(agg.command_facts(survey), extract.find_commands(survey))
    return choose(groups, analyzers).select("repo", "kind", "command")


@query
def a14_command_order(spark, sf_dir):
    """Commands with their places in the repo; two scripts more make ties and two kinds."""
    files = views.files(spark, sf_dir)
    more = files.filter("path = 'start-local.sh'").select(
        "repo", F.explode(F.array(*[F.lit(p) for p in ("a-stop.sh", "main-run.sh", "start-config.sh")])).alias("path"),
        "size", "content",
    )
    files = files.unionByName(more)
    survey, analyzers = survey_files(files), select_analyzer(files)
    groups = agg.command_groups(agg.command_facts(survey), extract.find_commands(survey))
    placed = rank.first_n(groups, None, REPO)
    return choose(placed, analyzers).select("repo", "kind", "command", "rank")


# -- ranking ----------------------------------------------------------------

@query
def r1_score_base(spark, sf_dir):
    return classify(views.files(spark, sf_dir)).select(
        "repo", "path", fs.score_base().alias("score")
    )


@query
def r2_score_java(spark, sf_dir):
    return classify(views.files(spark, sf_dir), "java").select(
        "repo", "path", fs.score_java().alias("score")
    )


@query
def r3_score_understanding(spark, sf_dir):
    return classify(views.files(spark, sf_dir), "java").select(
        "repo", "path", fs.score_understanding().alias("score")
    )


@query
def r4_score_by_criteria(spark, sf_dir):
    return _flags(spark, sf_dir, score=fs.score_by_criteria(CRITERIA))


@query
def r5_score_by_type(spark, sf_dir):
    return _flags(spark, sf_dir, score=fs.score_by_type(TYPE_SCORES))


@query
def r6_score_by_content(spark, sf_dir):
    return _flags(spark, sf_dir, score=fs.score_by_content(CONTENT_SCORES))


@query
def r7_score_combined(spark, sf_dir):
    scorers = [lambda: fs.score_by_criteria(CRITERIA), fs.score_by_type(TYPE_SCORES)]
    return _flags(spark, sf_dir, score=fs.score_combined(scorers))


@query
def r8_sort_by_importance(spark, sf_dir):
    files = views.files(spark, sf_dir).withColumn(
        "ord", fp.discovery_order(fp.is_key_file("java"))
    )
    ranked = rank.sort_by_importance(files, fs.score_by_criteria(CRITERIA), ["repo"])
    return ranked.select("repo", "path", "importance_score")


@query
def r9_top_n(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    best = choose(rank.top_n(gathered(survey), 10), analyzers)
    return best.select("repo", "path", "importance_score", "rank")


def _categories() -> dict[str, Column]:
    p = F.lower(F.col("path"))
    return {
        "build": p.contains("gradle") | p.contains("pom"),
        "config": fp.is_config(),
        "docs": p.endswith(".md"),
        "code": fp.ends_with_one(p, [".java", ".py", ".js"]),
    }


@query
def r10_top_by_category(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    picks = rank.top_by_category(gathered(survey), _categories(), 2, 8)
    return choose(picks, analyzers).select("repo", "position", "path")


@query
def r11_cap_with_overflow(spark, sf_dir):
    dependencies = extract.find_dependencies(extract.readable_files(views.files(spark, sf_dir)))
    return profile.shown_dependencies(dependencies, 2)


@query
def r12_priority_order(spark, sf_dir):
    survey, analyzers = _chosen_survey(spark, sf_dir)
    chosen = choose(gathered(survey), analyzers)
    return rank.priority_order(chosen).select("repo", "path", "priority")


# -- scalar functions -------------------------------------------------------

@query
def f1_detect_language(spark, sf_dir):
    return _flags(
        spark, sf_dir, java=fp.detect_language("java"), python=fp.detect_language("python"),
        javascript=fp.detect_language("javascript"),
    )


@query
def f2_path_parts(spark, sf_dir):
    full = F.concat(F.lit("/data/"), "repo", F.lit("/"), "path")
    root = F.concat(F.lit("/data/"), "repo")
    return _flags(
        spark, sf_dir, name=fp.file_name(), dir=fp.directory(), suffix=fp.suffix(),
        relative=fp.relative_path(full, root),
    )


@query
def f3_extract_patterns(spark, sf_dir):
    found = fc.extract_patterns(NAMED_PATTERNS, "text")
    return (
        views.table(spark, sf_dir, "documents")
        .select("doc_id", found.alias("found"))
        .select(
            "doc_id",
            *[F.array_join(F.col("found")[name], "|").alias(name) for name in NAMED_PATTERNS],
        )
    )


@query
def f4_extract_reasoning(spark, sf_dir):
    return (
        views.table(spark, sf_dir, "pages")
        .select("page_id", fc.extract_reasoning(F.col("html")).alias("r"))
        .select("page_id", _digest("r.text"), "r.reasoning")
    )


@query
def f5_fold_newlines(spark, sf_dir):
    return _flags(spark, sf_dir, digest=F.md5(fc.fold_newlines(F.col("content"))))


@query
def f6_strip_fence(spark, sf_dir):
    return views.fenced_conversations(spark, sf_dir).select(
        "conv_id", "turn", fc.strip_fence(F.col("text")).alias("text")
    )


@query
def f7_truncate(spark, sf_dir):
    text = F.col("text")
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", fc.truncate(text, 1000, 997, "...").alias("evaluation"),
        fc.truncate(text, 500, 500, "\n... (see detailed analysis for more)").alias("usage"),
    )


@query
def f8_parse_verdict(spark, sf_dir):
    turn = F.col("turn")
    answer = (
        F.when(turn == 1, F.lit("\n yes \n"))
        .when(turn == 2, F.lit("\nNO"))
        .when(turn == 3, F.lit("\nYES or NO, it Should be replaced"))
        .otherwise(F.lit("\nunclear "))
    )
    return views.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", fc.parse_verdict(F.concat("text", answer)).alias("verdict")
    )


_DEPENDENCY = ["repo", "path", "config", "group_id", "artifact", "version", "text"]


@query
def f9_gradle_dependencies(spark, sf_dir):
    return extract.gradle_dependencies(views.files(spark, sf_dir), True).select(*_DEPENDENCY)


@query
def f10_maven_dependencies(spark, sf_dir):
    return extract.maven_dependencies(views.files(spark, sf_dir)).select(*_DEPENDENCY)


@query
def f11_gradle_plugins(spark, sf_dir):
    files = views.files(spark, sf_dir)
    every = extract.gradle_plugins(files).select("repo", "path", "plugin", F.lit("all").alias("mode"))
    last = extract.gradle_plugins(files, "last").select(
        "repo", "path", "plugin", F.lit("last").alias("mode")
    )
    return every.unionByName(last)


@query
def f12_script_command(spark, sf_dir):
    command = fp.script_command()
    return _flags(spark, sf_dir, c=command).filter("c IS NOT NULL").select("repo", "path", "c.*")


@query
def f13_watermark(spark, sf_dir):
    return views.table(spark, sf_dir, "pages").select(
        "page_id", F.md5(ft.watermark(F.col("html"), DATE, MODEL)).alias("digest")
    )


@query
def f14_bullet_lines(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select(
        "doc_id",
        ft.bullet_lines(fc.contains_any(WORDS, "text"), "None found").alias("lines"),
    )


@query
def f15_fenced_block(spark, sf_dir):
    block = ft.fenced_block(F.col("path"), F.col("content"))
    return _flags(spark, sf_dir, digest=F.md5(block))


@query
def f16_render_template(spark, sf_dir):
    template = "# ${name}\n${size} bytes at ${path}${missing}\n${body}"
    slots = {
        "body": F.concat(F.lit("${name}: "), "content"), "name": F.col("repo"),
        "path": F.col("path"), "size": F.col("size").cast("string"),
        "missing": F.lit(None).cast("string"),
    }
    return _flags(spark, sf_dir, digest=F.md5(ft.render_template(template, slots)))


@query
def f17_flag_sentence(spark, sf_dir):
    return _flags(spark, sf_dir, sentence=ft.flag_sentence(fp.is_config(), "It configures."))


# -- jobs -------------------------------------------------------------------

@query
def c1_profile_repos(spark, sf_dir):
    def joined(array: str, element: Callable[[Column], Column]) -> Column:
        return F.array_join(F.transform(array, element), "|").alias(array)

    return profile.profile_repos(_corpus(spark, sf_dir)).select(
        "repo", "analyzer", "primary_language", "total_files", "has_spring_boot",
        "n_entry_points", "n_config_files", "n_key_files", "n_shell_scripts",
        "n_root_shell_scripts", "n_readmes", "n_example_configs", "type", "has_wrapper",
        "n_gradle_files", "n_root_scripts", "n_run", "n_stop",
        F.array_join("key_project_files", "|").alias("key_project_files"),
        F.array_join("custom_tools", "|").alias("custom_tools"),
        joined("language_stats", lambda x: F.concat_ws(":", x.language, x.n.cast("string"))),
        joined(
            "top_files", lambda x: F.concat_ws(":", x.path, x.language, x.score.cast("string"))
        ),
    )


@query
def c2_profile_report(spark, sf_dir):
    run = job.start_run(views.files(spark, sf_dir))
    report = profile.profile_report(
        run.corpus, run.profile, run.dependencies, views.api_patterns(spark, sf_dir)
    )
    return report.select("repo", "text")


@query
def c2_quick_start_report(spark, sf_dir):
    run = job.start_run(views.files(spark, sf_dir))
    report = profile.profile_report(
        run.corpus, run.profile, run.dependencies, views.api_patterns(spark, sf_dir),
        form="quick_start",
    )
    return report.select("repo", "text")


@query
def c3_purpose_context(spark, sf_dir):
    run = job.start_run(views.files(spark, sf_dir))
    report = profile.profile_report(run.corpus, run.profile, run.dependencies)
    return contexts.purpose_context(run.corpus, report).select(
        "repo", "step", "field", "path", _digest()
    )


@query
def c3_purpose_context_all(spark, sf_dir):
    """Every gathered file of any size, without the limits of the step."""
    corpus = profile.survey_corpus(views.files(spark, sf_dir), max_size=None)
    return contexts.purpose_context(corpus, n=None).select("repo", "step", "field", "path", _digest())


@query
def c4_usage_context(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    return contexts.usage_context(corpus, agg.command_facts(corpus.survey)).select(
        "repo", "step", "field", "path", _digest()
    )


@query
def c5_draft_context(spark, sf_dir):
    corpus = _corpus(spark, sf_dir)
    rows = contexts.draft_context(
        corpus, views.corpus_outputs(spark, sf_dir), _dependencies(corpus)
    )
    return rows.select("repo", "step", "field", "path", _digest())


@query
def c6_optimize_context(spark, sf_dir):
    pair = contexts.corpus_readme_pair(
        _corpus(spark, sf_dir), views.corpus_outputs(spark, sf_dir)
    )
    return contexts.optimize_context(pair, views.verdicts(spark, sf_dir))


@query
def c7_base_context(spark, sf_dir):
    base = contexts.base_context(profile.profile_repos(_corpus(spark, sf_dir)))
    return base.select(
        "repo", "name", "language", "is_spring_boot", "build_system",
        F.array_join("custom_tools", ",").alias("custom_tools"),
        F.array_join(
            F.transform("file_breakdown", lambda x: F.concat_ws(":", x.language, x.n.cast("string"))),
            ",",
        ).alias("file_breakdown"),
    )


def _step_contexts(spark, sf_dir) -> DataFrame:
    """The context rows of every step, and under 0 those without a step."""
    run = job.start_run(views.files(spark, sf_dir))
    report = save_table(profile.profile_report(run.corpus, run.profile, run.dependencies))
    outputs, answers = views.corpus_outputs(spark, sf_dir), views.verdicts(spark, sf_dir)
    steps = [
        contexts.step_context(run.corpus, run.profile, step, report, outputs, run.dependencies, answers)
        for step in (None, 1, 2, 3, 4)
    ]
    return reduce(DataFrame.unionByName, steps)


@query
def c7_step_contexts(spark, sf_dir):
    return _step_contexts(spark, sf_dir).select("repo", "step", "field", "path", _digest())


def _every_readme(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every original README, nested ones too, as a pair of its own, and the verdicts on them."""
    files = views.files_with_id(spark, sf_dir).filter(fp.is_original_readme())
    named = files.withColumn("repo", F.concat_ws("/", "repo", "path"))
    original = F.when(F.col("doc_id") % 7 == 0, F.lit("  # tiny\n")).otherwise(F.col("content"))
    pairs = named.select(
        "repo", original.alias("original_readme"), F.concat(F.lit("# "), "repo").alias("generated_readme")
    )
    answer = F.when(F.col("quality") == 1, F.lit("Good.\nNO")).otherwise(F.lit("Poor.\nYES"))
    labels = views.table(spark, sf_dir, "labels")
    return pairs, named.join(labels, "doc_id").select("repo", answer.alias("output"))


@query
def c8_every_readme_quality(spark, sf_dir):
    return quality.readme_quality(*_every_readme(spark, sf_dir))


@query
def c11_every_evaluation_prompt(spark, sf_dir):
    return quality.evaluation_prompts(_every_readme(spark, sf_dir)[0])


def _readme_files_pair(spark, sf_dir) -> DataFrame:
    """The README at the root of every repo as a pair of its own, some of them emptied."""
    files = views.files_with_id(spark, sf_dir).filter(F.col("path") == "README.md")
    original = F.when(F.col("doc_id") % 7 == 0, F.lit("  # tiny\n")).otherwise(F.col("content"))
    return files.select(
        "repo", original.alias("original_readme"),
        F.concat(F.lit("# "), "repo").alias("generated_readme"),
    )


@query
def c8_readme_quality(spark, sf_dir):
    return quality.readme_quality(
        _readme_files_pair(spark, sf_dir), views.verdicts(spark, sf_dir)
    )


@query
def c9_readme_quality_rules(spark, sf_dir):
    readmes = views.files(spark, sf_dir).filter(fp.is_readme()).select("repo", "path", "content")
    return quality.readme_quality_rules(readmes)


def _step3_prompts(spark, sf_dir) -> DataFrame:
    run = job.start_run(views.files(spark, sf_dir))
    slots = prompts.profile_slots(run.profile).filter("step = 3")
    slots = slots.unionByName(job.draft_slots(run, views.corpus_outputs(spark, sf_dir)))
    return job.prompt_batch(slots, prompts.default_steps(spark))


def _all_slots(spark, sf_dir) -> DataFrame:
    run = job.start_run(views.files(spark, sf_dir))
    outputs = views.corpus_outputs(spark, sf_dir)
    contents = job.picked_contents(run)
    return (
        job.first_slots(run, contents)
        .unionByName(job.draft_slots(run, outputs))
        .unionByName(job.final_slots(run, contents, outputs, views.verdicts(spark, sf_dir)))
    )


@query
def c10_build_prompts(spark, sf_dir):
    return job.prompt_batch(_all_slots(spark, sf_dir), prompts.default_steps(spark)).select(
        "repo", "step", "prompt"
    )


@query
def c10_streamed_prompts(spark, sf_dir):
    """The prompts put together from pieces of 1,000 characters."""
    pieces = prompts.streamed_prompts(_all_slots(spark, sf_dir), prompts.default_steps(spark), 1000)
    joined = gather_text(pieces.withColumnRenamed("part", "ord"), ["repo", "step"])
    return joined.select("repo", "step", F.col("text").alias("prompt"))


def _digest_of_pieces(repo, step, pieces):
    """Stands for a model: answers with a digest of the prompt it was given."""
    digest = hashlib.md5(usedforsecurity=False)
    for text in pieces:
        digest.update(text.encode())
    return f"{repo}/{step}: {digest.hexdigest()}"


@query
def u4_streamed_completions(spark, sf_dir):
    pieces = prompts.streamed_prompts(_all_slots(spark, sf_dir), prompts.default_steps(spark))
    return prompts.run_completions(pieces, _digest_of_pieces)


@query
def c11_evaluation_prompts(spark, sf_dir):
    return quality.evaluation_prompts(_readme_files_pair(spark, sf_dir))


@query
def c12_plan_steps(spark, sf_dir):
    outputs = _completions(spark, sf_dir)
    repos = views.step_outputs(spark, sf_dir).select("repo").distinct()
    runs = {
        "resume": prompts.plan_steps(repos, outputs),
        "from": prompts.plan_steps(repos, outputs, 3),
        "only": prompts.plan_steps(repos, outputs, 2, only=True),
    }
    rows = [df.select("repo", "step", F.lit(name).alias("run")) for name, df in runs.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def c13_finalize(spark, sf_dir):
    return prompts.finalize(_page_outputs(spark, sf_dir), DATE, MODEL).select(
        "repo", _digest("readme"), "reasoning"
    )


# -- plug-ins ---------------------------------------------------------------

@query
def u1_language_plugin(spark, sf_dir):
    return classify(views.files(spark, sf_dir), languages=FOUR_LANGUAGES).select(
        "repo", "analyzer", "path", "language", "is_key_file", "is_entry_point", "is_config",
        "importance_score",
    )


@query
def u1_plugin_profile(spark, sf_dir):
    """Profile, own list and own facts of every repo, where one of four languages is new."""
    files = views.files(spark, sf_dir)
    corpus = profile.survey_corpus(files, languages=FOUR_LANGUAGES)
    repos = profile.profile_repos(corpus).select(
        "repo", "analyzer", "primary_language", "total_files", "n_entry_points",
        F.get("top_files", F.lit(0))["path"].alias("best_file"),
    )
    notes = corpus.chosen(agg.repo_lists(corpus.survey, corpus.languages))
    notes = notes.filter("list = 'notes'").groupBy("repo").agg(F.count("path").alias("n_notes"))
    facts = corpus.chosen(agg.language_facts(corpus.survey, corpus.languages))
    facts = facts.groupBy("repo").agg(
        *[F.max(F.when(F.col("fact") == f, F.col("value"))).alias(f) for f in SCRIPTS.facts]
    )
    return repos.join(notes, "repo", "left").join(facts, "repo", "left").fillna(
        {"n_notes": 0} | {f: "" for f in SCRIPTS.facts}
    )
