"""Importance scores, as Columns of integers.

A scorer is a function without arguments to the row: it returns a Column over the
columns of a classified file.  Rules are plain lists and dictionaries, compiled into one
expression, so scoring is a projection of the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.functions import content as fc
from repoatlas.functions.paths import contains_one, ends_with_one


def points(condition: Column, weight: int) -> Column:
    """``weight`` where the condition holds, else 0."""
    return F.when(condition, F.lit(weight)).otherwise(F.lit(0))


def first_of(rules: Iterable[tuple[Column, int]]) -> Column:
    """Weight of the first condition that holds, else 0."""
    out = F
    for condition, weight in rules:
        out = out.when(condition, F.lit(weight))
    return out.otherwise(F.lit(0))


# -- content features -------------------------------------------------------

def content_features(content: Column | None = None) -> dict[str, Column]:
    """Everything the analyzers and scores need to know about the content of `path`.

    The features depend on no rule of a language or repo, so a scan can take them first and
    drop the content before anything is shuffled.  Each test runs only on the kind of file
    that uses its answer; on other files it is false or 0 without looking at the content.
    """
    c = F.coalesce(F.col("content") if content is None else content, F.lit(""))
    p = F.lower(F.col("path"))
    java, gradle = p.endswith(".java"), p.endswith(".gradle")

    def number(kind: Column, regex: str) -> Column:
        return F.when(kind, F.regexp_count(c, F.lit(regex))).otherwise(F.lit(0))

    return {
        "has_boot": c.contains(fv.BOOT_ANNOTATION),
        "has_java_entry": java & fc.has_java_entry(c),
        "has_gradle_entry": p.contains("gradle") & fc.has_gradle_entry(c),
        "has_main": java & c.rlike(fv.MAIN_SIGNATURE),
        "n_stereotypes": number(java, fv.STEREOTYPES),
        "n_mappings": number(java, fv.MAPPINGS),
        "has_boot_plugin": gradle & c.contains(fv.GRADLE_BOOT_PLUGIN),
        "has_application_word": gradle & c.rlike(fv.GRADLE_APPLICATION_WORD),
        "n_tasks": number(gradle, fv.GRADLE_TASK),
        "has_lombok": gradle & c.contains("lombok"),
        "has_main_class": gradle & c.contains("mainClass"),
        "is_non_blank": fc.non_blank(c),
    }


# -- R1 .. R3 ---------------------------------------------------------------

def score_base() -> Column:
    return points(F.col("is_entry_point"), fv.ENTRY_POINT_WEIGHT) + points(
        F.col("is_key_file"), fv.KEY_FILE_WEIGHT
    )


def _code_points(features: dict[str, Column]) -> Column:
    p = F.lower(F.col("path"))
    example = ends_with_one(p, fv.EXAMPLE_MARKERS)
    application = p.contains("application")
    configuration = ends_with_one(p, [".properties", ".yml"])
    java, gradle = p.endswith(".java"), p.endswith(".gradle")
    code = features["n_stereotypes"] * fv.STEREOTYPE_WEIGHT
    code = code + points(features["has_main"], fv.MAIN_WEIGHT)
    code = code + features["n_mappings"] * fv.MAPPING_WEIGHT
    build = points(features["has_boot_plugin"], fv.GRADLE_BOOT_WEIGHT)
    build = build + points(features["has_application_word"], fv.GRADLE_APPLICATION_WEIGHT)
    build = build + features["n_tasks"] * fv.GRADLE_TASK_WEIGHT
    return (
        points(features["has_boot"], fv.BOOT_WEIGHT)
        + first_of((contains_one(p, words), weight) for words, weight in fv.PATH_CHAIN)
        + points(application & example, fv.APPLICATION_EXAMPLE_WEIGHT)
        + points(p.contains("gradle"), fv.GRADLE_WEIGHT)
        + points(configuration & application, fv.APPLICATION_CONFIG_WEIGHT)
        + points(
            configuration & application & contains_one(p, ["local", "dev"]),
            fv.LOCAL_CONFIG_WEIGHT,
        )
        + F.when(java, code).when(gradle, build).otherwise(F.lit(0))
    )


def _features(from_content: bool) -> dict[str, Column]:
    made = content_features()
    return made if from_content else {name: F.col(name) for name in made}


def understanding_points(from_content: bool = False) -> Column:
    """Part of the score that depends on path and content only."""
    return _code_points(_features(from_content))


def java_points(from_content: bool = False) -> Column:
    """Like `understanding_points`, with the shell script and container file parts."""
    p = F.lower(F.col("path"))
    return (
        understanding_points(from_content)
        + points(p.endswith(".sh"), fv.SHELL_WEIGHT)
        + first_of(
            [
                (p.contains("dockerfile"), fv.DOCKERFILE_WEIGHT),
                (p.contains("docker-compose.yml"), fv.COMPOSE_WEIGHT),
            ]
        )
    )


def score_java(from_content: bool = False) -> Column:
    """Score of a file in a Java repo.

    Reads the columns of `content_features`, or the content itself with
    ``from_content=True``.
    """
    return score_base() + java_points(from_content)


def score_understanding(from_content: bool = False) -> Column:
    """Like `score_java`, without the shell script and container file parts."""
    return score_base() + understanding_points(from_content)


# -- R4 .. R7 ---------------------------------------------------------------

def score_by_criteria(criteria: dict[str, int], path: Column | None = None) -> Column:
    """Sum of the weights of every substring found in the lower-case path."""
    p = F.lower(F.col("path") if path is None else path)
    return reduce(add, [points(p.contains(w), v) for w, v in criteria.items()], F.lit(0))


def score_by_type(type_scores: dict[str, int], path: Column | None = None) -> Column:
    """Weight of the first extension the lower-case path ends with."""
    p = F.lower(F.col("path") if path is None else path)
    return first_of((p.endswith(ext), v) for ext, v in type_scores.items())


def score_by_content(
    patterns: dict[str, dict[str, int]],
    path: Column | None = None,
    content: Column | None = None,
) -> Column:
    """Matches times weight over the rule set of the first matching extension."""
    p = F.lower(F.col("path") if path is None else path)
    c = F.coalesce(F.col("content") if content is None else content, F.lit(""))
    out = F
    for ext, rules in patterns.items():
        total = reduce(
            add,
            [F.regexp_count(c, F.lit(regex)) * weight for regex, weight in rules.items()],
            F.lit(0),
        )
        out = out.when(p.endswith(ext), total)
    return F.when(c == "", F.lit(0)).otherwise(
        out.otherwise(F.lit(0)) if patterns else F.lit(0)
    )


def score_combined(scorers: Iterable[Column | Callable[[], Column]]) -> Column:
    """Sum of several scorers."""
    return reduce(add, [s if isinstance(s, Column) else s() for s in scorers], F.lit(0))
