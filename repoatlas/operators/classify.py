"""Classification of files.

The scan turns the content into a few flags and counts and drops it.  With
``language='auto'`` a file is then classified once for every analyzer, and the choice of
the analyzer of its repo is applied to the *results*: so neither content nor file rows are
shuffled to learn a property of their repo, and a repo that holds a large part of the
corpus makes no hot partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.functions import paths as fp
from repoatlas.functions import score as fs
from repoatlas.functions.languages import BUILT_IN, LanguageRules, by_name

REPO = ["repo", "analyzer"]


def candidates(language: str, languages: Sequence[LanguageRules]) -> list[LanguageRules]:
    """The languages a file is classified for: all of them, or the forced one."""
    known = by_name(languages)
    if language != "auto" and language not in known:
        raise ValueError(f"language must be one of {['auto', *known]}, not {language!r}")
    return list(languages) if language == "auto" else [known[language]]


# -- A4 ---------------------------------------------------------------------

def select_analyzer(
    files: DataFrame, language: str = "auto", languages: Sequence[LanguageRules] = BUILT_IN,
    default: str | None = None,
) -> DataFrame:
    """``repo, analyzer``: the forced language, or the first one with a marker at the root.

    A repo without any marker gets ``default``: Java where it is among the ``languages``, else
    the first of them.
    """
    candidates(language, languages)
    names = list(by_name(languages))
    if default is None:
        default = fv.DEFAULT_ANALYZER if fv.DEFAULT_ANALYZER in names else names[0]
    elif default not in names:
        raise ValueError(f"default must be one of {names}, not {default!r}")
    if language != "auto":
        return files.select("repo").distinct().withColumn("analyzer", F.lit(language))
    p = F.col("path")
    rank = F.when(F.lit(False), F.lit(0))
    for position, rules in enumerate(languages):
        markers = list(rules.markers)
        if markers:
            found = p.isin(markers) | fp.any_of(p.startswith(m + "/") for m in markers)
            rank = rank.when(found, F.lit(position))
    best = F.min("_rank")
    return (
        files.select("repo", rank.alias("_rank"))
        .groupBy("repo")
        .agg(
            F.when(best.isNull(), F.lit(default))
            .otherwise(F.get(F.array(*[F.lit(n) for n in names]), best))
            .alias("analyzer")
        )
    )


def choose(rows: DataFrame, analyzers: DataFrame) -> DataFrame:
    """Rows of the analyzer that was chosen for their repo."""
    return rows.join(analyzers, REPO, "left_semi")


# -- features of one file ---------------------------------------------------

def scan_features(
    files: DataFrame, max_size: int = fv.MAX_FILE_BYTES,
    languages: Sequence[LanguageRules] = BUILT_IN,
) -> DataFrame:
    """One narrow row per file: all that does not depend on the repo, without the content.

    ``_points_<language>`` are the points of the languages that have a score of their own.
    """
    readable = F.col("size") <= max_size
    content = F.when(readable, F.col("content"))
    text = F.coalesce(content, F.lit(""))
    own = {name: make(text) for rules in languages for name, make in rules.features.items()}
    scanned = files.select(
        "repo", "path", "size",
        fp.suffix().alias("suffix"),
        (
            readable & ~fp.in_excluded_dir() & ~fp.is_ci_file() & ~fp.is_sonar()
        ).alias("is_walked"),
        fp.is_shell().alias("is_shell"),
        fp.is_root_shell().alias("is_root_shell"),
        fp.is_readme().alias("is_readme"),
        fp.is_example_config().alias("is_example_path"),
        fp.is_example_config(on="name").alias("is_example_config"),
        (fp.is_config() | fp.is_special_config()).alias("is_config_path"),
        *[c.alias(name) for name, c in (fs.content_features(content) | own).items()],
    )
    points = {f"_points_{rules.name}": rules.score() for rules in languages if rules.score}
    return scanned.withColumns(points) if points else scanned


def _rules(rules: LanguageRules, readme_md: bool):
    """The analyzer's view of a file, as one struct."""
    is_key = fp.is_key_file(rules)
    wanted = is_key | F.col("is_shell") | F.col("is_example_path")
    wanted = wanted | fp.ends_with_one(F.col("path"), rules.extensions)
    if readme_md:
        wanted = wanted | F.col("is_readme")
    return F.struct(
        F.lit(rules.name).alias("analyzer"),
        fp.language_of_suffix(rules, F.col("suffix")).alias("language"),
        is_key.alias("is_key_file"),
        (F.col("is_walked") & wanted).alias("is_gathered"),
    )


def _of_analyzer(values, other):
    """The value of the row's analyzer, of ``(name, Column)`` pairs."""
    out = F
    for name, value in values:
        out = out.when(F.col("analyzer") == name, value)
    return other if out is F else out.otherwise(other)


def survey_files(
    files: DataFrame, language: str = "auto", readme_md: bool = True,
    max_size: int = fv.MAX_FILE_BYTES, languages: Sequence[LanguageRules] = BUILT_IN,
) -> DataFrame:
    """All files with all flags, once per candidate analyzer.

    `is_gathered` marks the files that take part in the analysis; the others are only
    looked at by name (wrapper, example configuration). ``languages`` are the analyzers to
    choose from: the built-in ones, or any other records in their place or beside them.
    """
    tried = candidates(language, languages)
    rules = F.explode(F.array(*[_rules(r, readme_md) for r in tried])).alias("rules")
    scanned = scan_features(files, max_size, tried)
    rows = scanned.select("*", rules).select("*", "rules.*").drop("rules")

    lang = F.col("language")
    entry = _of_analyzer(
        [(r.name, F.coalesce(r.entry_point(lang), F.lit(False))) for r in tried if r.entry_point],
        F.lit(False),
    )
    is_key, is_gathered = F.col("is_key_file"), F.col("is_gathered")
    forced = ~is_key & (F.col("is_shell") | F.col("is_example_path"))
    rows = rows.select(
        "*",
        (is_gathered & ~is_key & entry).alias("is_entry_point"),
        (is_gathered & (F.col("is_config_path") | forced)).alias("is_config"),
        ((lang == "Java") & F.col("has_boot")).alias("has_framework"),
        fp.discovery_order(is_key).alias("ord"),
    )
    own = [(r.name, F.col(f"_points_{r.name}")) for r in tried if r.score]
    score = (fs.score_base() + _of_analyzer(own, F.lit(0))).cast("int")
    return rows.withColumn("importance_score", score).drop(
        "suffix", "is_walked", "is_config_path", "is_example_path",
        *[f"_points_{name}" for name, _ in own],
    )


def gathered(survey: DataFrame) -> DataFrame:
    """The files that take part in the analysis."""
    return survey.filter("is_gathered")


def classify(
    files: DataFrame, language: str = "auto", readme_md: bool = True,
    languages: Sequence[LanguageRules] = BUILT_IN,
) -> DataFrame:
    """Gathered files of every repo under the analyzer of that repo."""
    rows = gathered(survey_files(files, language, readme_md, languages=languages))
    if language != "auto":
        return rows
    return choose(rows, select_analyzer(files, languages=languages))
