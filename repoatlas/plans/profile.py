"""The profile of each repo, and a text report of it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.functions import paths as fp
from repoatlas.functions import text as ft
from repoatlas.functions.languages import BUILT_IN, LanguageRules
from repoatlas.operators import aggregate as agg
from repoatlas.operators import extract
from repoatlas.operators.classify import REPO, choose, select_analyzer, survey_files
from repoatlas.operators.gather import gather_text
from repoatlas.operators.rank import cap_rows, top_n
from repoatlas.sources.scratch import save_table


@dataclass(frozen=True)
class Corpus:
    """The tables a job works on: file contents, the narrow survey, and the analyzers."""

    files: DataFrame
    survey: DataFrame
    analyzers: DataFrame
    max_size: int = fv.MAX_FILE_BYTES
    languages: Sequence[LanguageRules] = BUILT_IN

    def chosen(self, rows: DataFrame) -> DataFrame:
        return choose(rows, self.analyzers)


def survey_corpus(
    files: DataFrame, language: str = "auto", save: bool = True, readme_md: bool = True,
    max_size: int | None = fv.MAX_FILE_BYTES, languages: Sequence[LanguageRules] = BUILT_IN,
    folder: str | None = None,
) -> Corpus:
    """Scan the contents once and keep what the later passes need.

    ``save`` writes the narrow survey and the analyzer of each repo to the shared scratch
    folder; without it every pass scans the contents again.  The analyzers need a scan of
    `repo` and `path` only.  Larger files than ``max_size`` (None: no limit) take no part.
    ``languages`` are the analyzers to choose from. ``folder`` is where the tables are written.
    """
    limit = fv.NO_LIMIT if max_size is None else max_size
    survey = survey_files(files, language, readme_md, limit, languages).filter(
        F.col("is_gathered") | F.col("is_example_config") | agg.is_wrapper()
    )
    analyzers = select_analyzer(files, language, languages)
    if save:
        survey = save_table(survey, folder and f"{folder}/survey")
        analyzers = save_table(analyzers, folder and f"{folder}/analyzers")
    return Corpus(files, survey, analyzers, limit, tuple(languages))


# -- C1 ---------------------------------------------------------------------

def profile_repos(corpus: Corpus) -> DataFrame:
    """One row per repo.

    The columns are of bounded size: numbers, flags, languages, tools, key files (a fixed
    set of names) and the best 50 files.  The other path lists are the rows of
    `aggregate.repo_lists`.
    """
    gathered = F.col("is_gathered")
    facts = corpus.survey.groupBy(*REPO).agg(*agg.count_aggregates(), *agg.build_aggregates())
    # names and first places are strings, which hash aggregates cannot keep: only the few
    # files that show something take part
    is_key = gathered & F.col("is_key_file")
    keys = F.array_sort(F.collect_list(F.when(is_key, F.struct("ord", "path"))))
    signs = (
        corpus.survey.filter(is_key | extract.has_tool_sign() | agg.is_command_sign())
        .groupBy(*REPO)
        .agg(
            *agg.command_aggregates(),
            F.transform(keys, lambda x: x.path).alias("key_project_files"),
            F.transform(
                extract.tools_in_order(extract.tool_aggregates()), lambda t: t.tool
            ).alias("custom_tools"),
        )
    )
    stats = agg.language_stats(corpus.survey)
    counts = F.array_sort(
        F.collect_list(F.struct((-F.col("n")).alias("less"), "first_ord", "language", "n"))
    )
    languages = stats.groupBy(*REPO).agg(
        F.transform(
            counts, lambda x: F.struct(x.language.alias("language"), x.n.alias("n"))
        ).alias("language_stats")
    )
    best = top_n(corpus.survey.filter(gathered), fv.TOP_FILES_IN_PROFILE)
    ranked = F.array_sort(F.collect_list(F.struct("rank", "path", "language", "importance_score")))
    top = best.groupBy(*REPO).agg(
        F.transform(
            ranked,
            lambda x: F.struct(
                x.path.alias("path"), x.language.alias("language"),
                x.importance_score.alias("score"),
            ),
        ).alias("top_files")
    )
    rows = (
        corpus.analyzers.join(facts, REPO, "left")
        .join(signs, REPO, "left")
        .join(languages, REPO, "left")
        .join(agg.primary_language(stats), REPO, "left")
        .join(top, REPO, "left")
    )
    # a repo without any file of interest has a row too
    missing = {"primary_language": fv.UNKNOWN_LANGUAGE, "type": "unknown"}
    missing |= {name: 0 for name, kind in rows.dtypes if kind == "bigint"}
    missing |= {name: False for name, kind in rows.dtypes if kind == "boolean"}
    arrays = [name for name, kind in rows.dtypes if kind.startswith("array")]
    return rows.fillna(missing).withColumns({a: F.coalesce(a, F.array()) for a in arrays})


# -- C2 ---------------------------------------------------------------------

def shown_dependencies(dependencies: DataFrame, n: int = fv.DEPENDENCIES_SHOWN) -> DataFrame:
    """``repo, position, line``: the first ``n`` dependencies and a line for the rest."""
    lines = dependencies.select("repo", F.col("text").alias("line"), "ord")
    return cap_rows(lines, n, "... and %d more", ["repo"])


def _dependency_block(dependencies: DataFrame) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("position", "line")))
    return shown_dependencies(dependencies).groupBy("repo").agg(
        F.array_join(F.transform(items, lambda x: ft.bullet(x.line)), "\n").alias("dependencies")
    )


def _section(title: str, present: Column) -> Column:
    return F.when(present, F.lit("\n\n" + title)).otherwise(F.lit(""))


def _quick_start(
    corpus: Corpus, profile: DataFrame, dependencies: DataFrame, api_patterns: DataFrame | None
) -> DataFrame:
    """``repo, quick``: the short lists of the quick start form, all of bounded length."""

    def section(number: int, rows: DataFrame, n: int, fmt: str, by: list[str], line: Column):
        return cap_rows(rows, n, fmt, by).select(
            "repo", F.lit(number).alias("section"),
            (F.col("lead") if "lead" in by else F.lit("")).alias("lead"), "position",
            line.alias("line"),
        )

    entries = corpus.chosen(corpus.survey.filter("is_entry_point")).select(
        "repo", F.col("path").alias("line"), "ord"
    )
    scripts = corpus.chosen(
        agg.script_commands(profile, extract.find_commands(corpus.survey))
    ).select(
        "repo", "kind", F.substring("ord", 1, 1).alias("lead"), "ord",
        F.concat("kind", F.lit(": `"), "command", F.lit("`")).alias("line"),
    )
    shown = F.col("position") <= fv.QUICK_START_COMMANDS
    bullet = ft.bullet(F.col("line"))
    lines = (
        section(1, entries, fv.QUICK_START_ENTRY_POINTS, "... and %d more entry points",
                ["repo"], bullet)
        .unionByName(
            section(
                2, scripts, fv.QUICK_START_COMMANDS, "  ... and %d more ",
                ["repo", "kind", "lead"],
                F.when(shown, bullet).otherwise(F.concat("line", "kind", F.lit(" commands"))),
            )
        )
        .unionByName(
            section(3, dependencies.select("repo", F.col("text").alias("line"), "ord"),
                    fv.QUICK_START_DEPENDENCIES, "... and %d more dependencies", ["repo"], bullet)
        )
    )
    if api_patterns is not None:
        endpoint = F.concat("method", F.lit(" "), "endpoint")
        named = F.concat(F.lit("Controller: "), "name")
        repository = F.concat(F.lit("Repository: "), "repository")
        patterns = api_patterns.select(
            "repo", F.coalesce(endpoint, named, repository).alias("line"), "ord"
        )
        lines = lines.unionByName(
            section(4, patterns, fv.QUICK_START_API, "... and %d more endpoints/controllers",
                    ["repo"], bullet)
        )
    items = F.col("items")

    def block(number: int, title: str) -> Column:
        own = F.transform(F.filter(items, lambda x: x.section == number), lambda x: x.line)
        return F.when(F.size(own) > 0, F.concat(F.lit(title), F.array_join(own, "\n"))).otherwise(
            F.lit("")
        )

    text = F.concat(
        block(1, "\n### Entry Points\n"), block(2, "\n\n### Build Commands\n"),
        block(3, "\n\n## Dependencies\n"), block(4, "\n\n## API Endpoints\n"),
    )
    order = F.struct("section", "lead", "position", "line")
    return (
        lines.groupBy("repo")
        .agg(F.array_sort(F.collect_list(order)).alias("items"))
        .select("repo", text.alias("quick"))
    )


def report_pieces(
    corpus: Corpus, profile: DataFrame, dependencies: DataFrame,
    api_patterns: DataFrame | None = None, form: str = "full",
) -> DataFrame:
    """``repo, ord, text``: the report as pieces, which joined in order are the report.

    Fixed parts come from the profile row of the repo, list items from rows: no list is
    put into one value here.  ``form='quick_start'`` ends the report of a Java repo with
    short lists under a quick start heading instead of the full ones.
    """
    if form not in ("full", "quick_start"):
        raise ValueError(f"form must be 'full' or 'quick_start', not {form!r}")
    quick = form == "quick_start"
    java = F.col("analyzer") == "java"
    has_commands = java & F.col("has_scripts")
    has_roots, has_entries = F.col("n_root_shell_scripts") > 0, F.col("n_entry_points") > 0
    system = F.concat(
        F.initcap("type"), F.when(F.col("has_wrapper"), F.lit(" with wrapper")).otherwise("")
    )
    keys = F.col("key_project_files")

    def key_lines(category: str) -> Column:
        chosen = F.filter(keys, lambda k: fp.key_file_category(k) == category)
        return ft.bullet_lines(chosen, "None found")

    languages = F.array_join(
        F.transform(
            "language_stats",
            lambda s: F.concat(F.lit("- "), s.language, F.lit(": "), s.n, F.lit(" files")),
        ),
        "\n",
    )
    tools = F.when(F.size("custom_tools") > 0, F.array_join("custom_tools", ", ")).otherwise(
        F.lit("None detected")
    )
    boot = F.when(
        F.col("has_spring_boot"), F.lit("\n" + fv.SPRING_BOOT_SENTENCE)
    ).otherwise(F.lit(""))
    head = F.concat(
        F.lit("# Repository Analysis for: "), "repo",
        F.lit("\nPrimary Language: "), "primary_language",
        F.lit("\nTotal Files: "), F.col("total_files").cast("string"),
        F.lit("\n\n## Overview\n"),
    )
    other = F.lit(fv.NO_ANALYSIS)
    for rules in corpus.languages:
        other = F.when(F.col("analyzer") == rules.name, F.lit(rules.overview)).otherwise(other)
    start = F.concat(
        head,
        F.lit("## Java/Gradle Repository Analysis\n\n    This Java repository uses "), system,
        F.lit(" build system."), boot,
        F.lit("\n    ### Key Components:\n    "), key_lines("other"),
        F.lit("\n\n    ### Entry Points:\n    "),
        F.when(has_entries, F.lit("")).otherwise(F.lit("None found\n")),
    )
    middle = F.concat(
        F.lit("\n    ### Configuration Files:\n    "), key_lines("config"),
        F.lit("\n\n    ### Example Configuration Files:\n    "), key_lines("example"),
        F.lit("\n\n    ### File Distribution:\n    "), languages,
        F.lit("\n\n    ### Build System:\n    - Type: "), system,
        F.lit("\n    - Commands:"),
        F.when(has_commands, F.lit("\n\nBuild System Commands:")).otherwise(F.lit("")),
    )
    late = F.concat(
        F.when(has_commands, F.lit("\n")).otherwise(F.lit("")),
        F.lit("\n\n    ### Tools and Technologies:\n    "), tools,
        F.when(has_roots, F.lit("\n    \n\nRoot Shell Scripts:")).otherwise(F.lit("")),
    )
    breakdown = F.concat(
        F.lit("\n\n## File Breakdown"),
        F.when(F.size("language_stats") > 0, F.lit("\n")).otherwise(F.lit("")), languages,
        _section("## Entry Points", has_entries & ~java if quick else has_entries),
    )
    listed = F.coalesce("dependencies", F.lit(""))
    end = F.concat(F.lit("\n\n## Quick Start"), F.coalesce("quick", F.lit("")))
    end = F.when(java, end).otherwise(F.lit("")) if quick else F.concat(
        _section("## Dependencies\n", java & (listed != "")),
        F.when(java, listed).otherwise(F.lit("")),
    )

    def piece(order: str, text: Column, when: Column | None = None) -> Column:
        made = F.struct(F.lit(order).alias("ord"), text.alias("text"))
        return made if when is None else F.when(when, made)

    fixed = F.array_compact(
        F.array(
            piece("00", F.when(java, start).otherwise(F.concat(head, other))),
            piece("02", middle, java),
            piece("04", late, java),
            piece("10", breakdown),
            piece("12", _section("## Build Commands", has_commands), java & F.lit(not quick)),
            piece("14", _section("## Root Shell Scripts", has_roots), ~java),
            piece("20", end),
        )
    )
    lists = (
        _quick_start(corpus, profile, dependencies, api_patterns)
        if quick else _dependency_block(dependencies)
    )
    pieces = (
        profile.join(lists, "repo", "left")
        .select("repo", F.explode(fixed).alias("p"))
        .select("repo", "p.ord", "p.text")
    )

    def items(rows: DataFrame, *columns: Column) -> DataFrame:
        """Item pieces: each column gives a struct of order and text, or null."""
        return (
            corpus.chosen(rows)
            .select("repo", F.explode(F.array_compact(F.array(*columns))).alias("p"))
            .select("repo", "p.ord", "p.text")
        )

    def item(order: str, text: Column, when: Column) -> Column:
        made = F.struct(F.concat(F.lit(order), "ord").alias("ord"), text.alias("text"))
        return F.when(when, made)

    entry, line = F.col("is_entry_point"), ft.bullet(F.col("path"))
    root = F.col("is_gathered") & F.col("is_root_shell")
    listed_files = items(
        corpus.survey.filter(entry | root),
        item("01", F.concat(line, F.lit("\n")), java & entry),
        item("11", F.concat(F.lit("\n"), line), entry & ~java if quick else entry),
        item("05", F.concat(F.lit("\n"), line), java & root),
        item("15", F.concat(F.lit("\n"), line), ~java & root),
    )
    command_line = F.concat(F.lit("\n- "), "kind", F.lit(": `"), "command", F.lit("`"))
    commands = items(
        agg.script_commands(profile, extract.find_commands(corpus.survey)),
        item("03", command_line, java),
        item("13", command_line, java & F.lit(not quick)),
    )
    out = pieces.unionByName(listed_files).unionByName(commands)
    return out if api_patterns is None else out.unionByName(_api_pieces(profile, api_patterns))


def _api_pieces(profile: DataFrame, api_patterns: DataFrame) -> DataFrame:
    """Pieces of the API part, between the root scripts and the file breakdown."""
    lines = agg.api_lines(api_patterns)
    types = lines.groupBy("repo", "type").agg(F.min("ord").alias("first"))
    shown = profile.filter(F.col("analyzer") == "java").select("repo", "n_root_shell_scripts")
    gap = F.when(F.col("n_root_shell_scripts") > 0, F.lit("\n\n    \n\n### API Endpoints:"))
    title = (
        types.select("repo").distinct().join(shown, "repo")
        .select("repo", F.lit("06").alias("ord"),
                gap.otherwise(F.lit("\n    \n    \n\n### API Endpoints:")).alias("text"))
    )
    heads = types.join(shown, "repo", "left_semi").select(
        "repo", F.concat(F.lit("07"), "first", F.lit("\x010")).alias("ord"),
        F.concat(F.lit("\n\n**"), "type", F.lit("**:")).alias("text"),
    )
    body = (
        lines.join(types, ["repo", "type"]).join(shown, "repo", "left_semi")
        .select("repo", F.concat(F.lit("07"), "first", F.lit("\x011"), "ord").alias("ord"),
                F.concat(F.lit("\n"), "line").alias("text"))
    )
    return title.unionByName(heads).unionByName(body)


def profile_report(
    corpus: Corpus, profile: DataFrame, dependencies: DataFrame,
    api_patterns: DataFrame | None = None, form: str = "full", as_pieces: bool = False,
) -> DataFrame:
    """``repo, part, text``: the report of each repo as one text, or in its pieces."""
    pieces = save_table(report_pieces(corpus, profile, dependencies, api_patterns, form))
    return gather_text(pieces, ["repo"], pieces=as_pieces)
