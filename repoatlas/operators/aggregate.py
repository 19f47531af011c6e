"""Aggregates per repo.

Counts and flags are partial-then-final aggregates, so a large repo is reduced before it
is shuffled.  Lists of paths stay rows; `repoatlas.operators.gather` makes arrays or texts
of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.functions import paths as fp
from repoatlas.functions.languages import BUILT_IN, LanguageRules
from repoatlas.operators.classify import REPO
from repoatlas.operators.gather import gather_text, with_part


# -- A1 .. A3 ---------------------------------------------------------------

def language_stats(survey: DataFrame) -> DataFrame:
    """``repo, analyzer, language, n, first_ord``; `Unknown` counts as a language."""
    return (
        survey.filter("is_gathered")
        .groupBy(*REPO, "language")
        .agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
    )


def language_breakdown(stats: DataFrame) -> DataFrame:
    """Languages of each repo, most files first, ties by first file."""
    return stats.orderBy(*REPO, F.desc("n"), "first_ord")


def primary_language(stats: DataFrame) -> DataFrame:
    """Java if there is any Java file, else the most frequent language, ties by first file."""
    most = F.min_by("language", F.struct(-F.col("n"), F.col("first_ord")))
    return stats.groupBy(*REPO).agg(
        F.when(F.bool_or(F.col("language") == "Java"), F.lit("Java"))
        .otherwise(most)
        .alias("primary_language")
    )


# -- A5 ---------------------------------------------------------------------

def count_aggregates() -> list[Column]:
    g = F.col("is_gathered")
    return [
        F.count_if(g).alias("total_files"),
        F.bool_or(g & F.col("has_framework")).alias("has_spring_boot"),
        F.count_if("is_entry_point").alias("n_entry_points"),
        F.count_if(is_config_listed()).alias("n_config_files"),
        F.count_if(g & F.col("is_key_file")).alias("n_key_files"),
        F.count_if(g & F.col("is_shell")).alias("n_shell_scripts"),
        F.count_if(g & F.col("is_root_shell")).alias("n_root_shell_scripts"),
        F.count_if(g & F.col("is_readme")).alias("n_readmes"),
        F.count_if("is_example_config").alias("n_example_configs"),
    ]


def repo_counts(survey: DataFrame) -> DataFrame:
    """Numbers and flags per repo, in one aggregate."""
    return survey.groupBy(*REPO).agg(*count_aggregates())


# -- A6, J4 -----------------------------------------------------------------

def is_config_listed() -> Column:
    """Gathered configuration, or an example configuration anywhere in the listing."""
    return F.col("is_config") | F.col("is_example_config")


def config_order() -> Column:
    """Order of the configuration list: gathered ones first, then found examples."""
    return F.concat(
        F.when(F.col("is_config"), F.lit("0")).otherwise(F.lit("1")),
        F.when(F.col("is_config"), F.col("ord")).otherwise(F.col("path")),
    )


def config_union(survey: DataFrame) -> DataFrame:
    """Configuration files, shell scripts, special and example files, each once."""
    return survey.filter(is_config_listed()).select(*REPO, "path", config_order().alias("ord"))


def repo_lists(survey: DataFrame, languages: Sequence[LanguageRules] = BUILT_IN) -> DataFrame:
    """``repo, analyzer, list, path, ord``: every path list of a repo, as rows.

    READMEs and the lists of a language are in the order of the score of their files, the
    others as the files are found.
    """
    g, p = F.col("is_gathered"), F.col("path")
    by_score = fp.score_order(F.col("importance_score"), F.col("ord"))
    lists = {
        "entry_points": F.col("is_entry_point"),
        "key_project_files": g & F.col("is_key_file"),
        "shell_scripts": g & F.col("is_shell"),
        "root_shell_scripts": g & F.col("is_root_shell"),
    }
    scored = [("readme_files", g & F.col("is_readme"))]
    scored += [
        (name, g & (F.col("analyzer") == rules.name) & make())
        for rules in languages for name, make in rules.lists.items()
    ]
    placed = [(name, c, F.col("ord")) for name, c in lists.items()]
    placed += [(name, c, by_score) for name, c in scored]
    member = [
        F.when(condition, F.struct(F.lit(name).alias("list"), order.alias("ord")))
        for name, condition, order in placed
    ]
    member.append(
        F.when(
            is_config_listed(),
            F.struct(F.lit("config_files").alias("list"), config_order().alias("ord")),
        )
    )
    member.append(
        F.when(
            F.col("is_example_config"),
            F.struct(F.lit("example_config_files").alias("list"), p.alias("ord")),
        )
    )
    return survey.select(
        *REPO, "path", F.explode(F.array_compact(F.array(*member))).alias("m")
    ).select(*REPO, "m.list", "path", "m.ord")


# -- U1 ---------------------------------------------------------------------

def language_facts(survey: DataFrame, languages: Sequence[LanguageRules] = BUILT_IN) -> DataFrame:
    """``repo, analyzer, fact, value``: the facts the languages ask for, null ones left out.

    One aggregate over the gathered files of all repos; a value is shown as a string.
    """
    made = {
        f"{rules.name}.{name}": F.when(F.col("analyzer") == rules.name, make().cast("string"))
        for rules in languages for name, make in rules.facts.items()
    }
    rows = survey.filter("is_gathered")
    if not made:
        return rows.select(*REPO, F.lit("").alias("fact"), F.lit("").alias("value")).limit(0)
    facts = F.array(*[
        F.struct(F.lit(key.split(".", 1)[1]).alias("fact"), F.col(f"`{key}`").alias("value"))
        for key in made
    ])
    found = rows.groupBy(*REPO).agg(*[column.alias(key) for key, column in made.items()])
    return found.select(*REPO, F.inline(facts)).filter("value IS NOT NULL")


# -- A7 ---------------------------------------------------------------------

def readme_contents(files: DataFrame, survey: DataFrame) -> DataFrame:
    """``repo, analyzer, path, content`` of the READMEs, by their path in both tables.

    READMEs are picked by name before the join, so only their content moves.
    """
    readmes = survey.filter("is_gathered AND is_readme").select(*REPO, "path", "ord")
    texts = files.filter(fp.is_readme()).select("repo", "path", "content")
    return readmes.join(texts, ["repo", "path"]).select(*REPO, "path", "content", "ord")


def content_maps(contents: DataFrame, pieces: bool = False) -> DataFrame:
    """``path -> content`` maps: one per repo, or with ``pieces`` one per file."""
    return (
        with_part(contents, "ord", pieces)
        .groupBy(*REPO, "part")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("path", "content"))).alias("contents")
        )
    )


# -- A9 ---------------------------------------------------------------------

def is_wrapper() -> Column:
    """The build wrapper, which only has to exist."""
    return (F.col("path") == "gradlew") | F.col("path").startswith("gradlew/")


def build_aggregates() -> list[Column]:
    g = F.col("is_gathered") & (F.col("analyzer") == "java")
    p, kind = F.col("path"), fp.script_command()["kind"]
    gradle = g & p.endswith(".gradle")
    return [
        F.when(F.bool_or(gradle), F.lit("gradle")).otherwise(F.lit("unknown")).alias("type"),
        F.bool_or((F.col("analyzer") == "java") & is_wrapper()).alias("has_wrapper"),
        F.count_if(gradle).alias("n_gradle_files"),
        F.count_if(g & F.col("is_root_shell")).alias("n_root_scripts"),
        F.count_if(g & (kind == "run")).alias("n_run"),
        F.count_if(g & (kind == "stop")).alias("n_stop"),
    ]


def build_system(survey: DataFrame) -> DataFrame:
    """Build system facts per repo; its files, plugins and commands are rows elsewhere."""
    return survey.filter(F.col("analyzer") == "java").groupBy(*REPO).agg(*build_aggregates())


# -- A10, A11 ---------------------------------------------------------------

def last_completed_step(step_outputs: DataFrame) -> DataFrame:
    """``repo, step``: highest step with a non-empty output, else 0."""
    done = F.when(F.length("output") > 0, F.col("step"))
    return step_outputs.groupBy("repo").agg(F.coalesce(F.max(done), F.lit(0)).alias("step"))


def combine_outputs(step_outputs: DataFrame, step: int) -> DataFrame:
    """``repo, text``: the non-empty outputs before ``step``, in order, a blank line between.

    Step numbers are unique in a repo, so at most ``step - 1`` texts meet.
    """
    items = F.array_sort(F.collect_list(F.struct("step", "output")))
    return (
        step_outputs.filter((F.col("step") < step) & (F.col("step") >= 1))
        .filter(F.length("output") > 0)
        .groupBy("repo")
        .agg(F.array_join(F.transform(items, lambda x: x.output), "\n\n").alias("text"))
    )


# -- A12 --------------------------------------------------------------------

def api_lines(api_patterns: DataFrame) -> DataFrame:
    """``repo, type, line, ord``: one line per API pattern that has something to show."""
    c = F.col
    line = (
        F.when(
            c("endpoint").isNotNull() & c("method").isNotNull(),
            F.concat(F.lit("- "), "method", F.lit(" "), "endpoint"),
        )
        .when(c("name").isNotNull(), F.concat(F.lit("- "), "name"))
        .when(c("repository").isNotNull(), F.concat(F.lit("- Repository: "), "repository"))
    )
    return api_patterns.select(
        "repo", F.coalesce("type", F.lit("Other")).alias("type"), line.alias("line"), "ord"
    ).filter(c("line").isNotNull())


def group_api(api_patterns: DataFrame, pieces: bool = False) -> DataFrame:
    """``repo, type, part, lines``: the lines of each API type, in order, or one by one."""
    grouped = gather_text(
        api_lines(api_patterns), ["repo", "type"], "line", sep="\n", pieces=pieces
    )
    return grouped.withColumnRenamed("line", "lines")


# -- A14 --------------------------------------------------------------------

def is_command_sign() -> Column:
    """Scripts that are commands, and the build file that may name a main class."""
    script = fp.script_command().isNotNull() & (F.col("analyzer") == "java")
    return F.col("is_gathered") & (script | (F.col("path") == "build.gradle"))


def command_aggregates() -> list[Column]:
    """To be taken over the files with `is_command_sign`, or any more of the same repos."""
    g = F.col("is_gathered")
    kind = F.when(g & (F.col("analyzer") == "java"), fp.script_command()["kind"])
    place = fp.score_order(F.col("importance_score"), F.col("ord"))
    run, stop = (F.min(F.when(kind == k, place)) for k in ("run", "stop"))
    main = g & (F.col("path") == "build.gradle") & F.col("has_main_class")
    return [
        F.bool_or(kind.isNotNull()).alias("has_scripts"),
        F.coalesce(stop < run, F.lit(False)).alias("stop_first"),
        F.bool_or(main).alias("has_main_class"),
    ]


def command_facts(survey: DataFrame) -> DataFrame:
    """``repo, analyzer, has_scripts, stop_first, has_main_class``; the profile has them too."""
    return survey.groupBy(*REPO).agg(*command_aggregates())


def script_commands(facts: DataFrame, commands: DataFrame) -> DataFrame:
    """Script commands with an order key: kinds by their first script, then scripts."""
    stop_first = facts.filter("stop_first").select(*REPO, "stop_first")
    leads = (F.col("kind") == "stop") == F.coalesce("stop_first", F.lit(False))
    return commands.join(stop_first, REPO, "left").select(
        *REPO, "kind", "command",
        F.concat(F.when(leads, F.lit("0")).otherwise(F.lit("1")), "ord").alias("ord"),
    )


def standard_commands(facts: DataFrame) -> DataFrame:
    """Commands of repos without scripts: a Gradle build, and a run if there is a main class."""

    def standard(kind: str, command: str, order: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(command).alias("command"), F.lit(order).alias("ord")
        )

    both = F.array(
        standard("gradle", "./gradlew build", "0"),
        F.when(F.col("has_main_class"), standard("run", "./gradlew run", "1")),
    )
    return (
        facts.filter(~F.col("has_scripts"))
        .select(*REPO, F.explode(F.array_compact(both)).alias("s"))
        .select(*REPO, "s.*")
    )


def command_groups(facts: DataFrame, commands: DataFrame) -> DataFrame:
    """``repo, analyzer, kind, command, ord``: script commands, or the standard ones."""
    return script_commands(facts, commands).unionByName(standard_commands(facts))
