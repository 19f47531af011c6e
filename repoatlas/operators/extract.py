"""Facts extracted from file content, as rows. All of it is narrow: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.functions import content as fc
from repoatlas.functions import paths as fp
from repoatlas.functions import score as fs
from repoatlas.operators.classify import REPO

DEPENDENCY_COLUMNS = [
    "repo", "path", "tool", "config", "group_id", "artifact", "version", "text", "ord",
]


def readable_files(files: DataFrame, max_size: int = fv.MAX_FILE_BYTES) -> DataFrame:
    """Files within the size gate and outside the excluded directories."""
    return files.filter((F.col("size") <= max_size) & ~fp.in_excluded_dir())


def _score() -> Column:
    """Score of a build file in a Java repo, from its path and content."""
    is_key = fp.is_key_file("java")
    entry = ~is_key & fs.content_features()["has_gradle_entry"]
    base = fs.points(entry, fv.ENTRY_POINT_WEIGHT) + fs.points(is_key, fv.KEY_FILE_WEIGHT)
    return base + fs.java_points(from_content=True)


def _position(*columns: str):
    """Order key of a match: falling `score` and discovery order of its file, its positions."""
    return F.concat(
        fp.score_order(F.col("score"), fp.discovery_order(fp.is_key_file("java"))), F.lit("\x01"),
        *[F.lpad(F.col(c).cast("string"), 8, "0") for c in columns],
    )


def by_score() -> Column:
    """Order key of a surveyed file: by falling score, then as it is found."""
    return fp.score_order(F.col("importance_score"), F.col("ord"))


# -- F9 ---------------------------------------------------------------------

def gradle_dependencies(files: DataFrame, parenthesised: bool = False) -> DataFrame:
    """Dependencies of the ``dependencies { }`` blocks of Gradle files, one row each.

    ``parenthesised`` also takes ``config("g:n:v")``.
    """
    blocks = files.filter(F.col("path").endswith(".gradle")).select(
        "repo", "path", _score().alias("score"),
        F.posexplode(
            F.regexp_extract_all("content", F.lit(fv.GRADLE_DEPENDENCY_BLOCK), F.lit(1))
        ).alias("block", "body"),
    )
    notations = {"0": fv.GRADLE_DEPENDENCY, "1": fv.GRADLE_DEPENDENCY_MAP}
    if parenthesised:
        notations["2"] = fv.GRADLE_DEPENDENCY_PAREN

    def matches(kind: str, regex: str) -> Column:
        found = F.regexp_extract_all(F.col("body"), F.lit(regex), F.lit(0))
        return F.transform(
            found,
            lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("position"), m.alias("m")),
        )

    def group(number: int) -> Column:
        out = F
        for kind, regex in notations.items():
            out = out.when(F.col("kind") == kind, F.regexp_extract("m", regex, number))
        return out

    rows = (
        blocks.select(
            "repo", "path", "score", "block",
            F.explode(F.concat(*[matches(k, r) for k, r in notations.items()])).alias("found"),
        )
        .select("repo", "path", "score", "block", "found.*")
        .withColumns(
            {
                name: group(number)
                for number, name in enumerate(["config", "group_id", "artifact", "version"], 1)
            }
        )
    )
    short = F.concat(
        "config", F.lit(" '"), "group_id", F.lit(":"), "artifact", F.lit(":"), "version", F.lit("'")
    )
    named = F.concat(
        "config", F.lit("(group: '"), "group_id", F.lit("', name: '"), "artifact",
        F.lit("', version: '"), "version", F.lit("')"),
    )
    return rows.select(
        "repo", "path", F.lit("gradle").alias("tool"),
        "config", "group_id", "artifact", "version",
        F.when(F.col("kind") == "1", named).otherwise(short).alias("text"),
        _position("block", "kind", "position").alias("ord"),
    )


# -- F10 --------------------------------------------------------------------

def maven_dependencies(files: DataFrame) -> DataFrame:
    """Dependencies with a version of ``pom.xml`` files, one row each."""
    matches = files.filter(F.col("path").endswith("pom.xml")).select(
        "repo", "path", _score().alias("score"),
        F.posexplode(
            F.regexp_extract_all("content", F.lit(fv.MAVEN_DEPENDENCY_ONCE), F.lit(0))
        ).alias("position", "m"),
    )
    group = [fc.strip(F.regexp_extract("m", fv.MAVEN_DEPENDENCY_ONCE, g)) for g in (1, 2, 3)]
    return matches.select(
        "repo", "path", F.lit("maven").alias("tool"),
        F.lit("").alias("config"),
        group[0].alias("group_id"), group[1].alias("artifact"), group[2].alias("version"),
        F.concat_ws(":", *group).alias("text"),
        _position("position").alias("ord"),
    )


def find_dependencies(files: DataFrame, parenthesised: bool = False) -> DataFrame:
    """Gradle and Maven dependencies; `ord` is by score of the file, then as they are found."""
    return gradle_dependencies(files, parenthesised).unionByName(maven_dependencies(files))


# -- F11 --------------------------------------------------------------------

def gradle_plugins(files: DataFrame, mode: str = "all") -> DataFrame:
    """Plugin ids of ``plugins { }`` blocks: all of them, or the last one of each block."""
    if mode == "all":
        blocks = F.regexp_extract_all("content", F.lit(fv.PLUGIN_BLOCK), F.lit(0))
        ids = F.flatten(
            F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit(fv.PLUGIN_ID), F.lit(1)))
        )
    elif mode == "last":
        ids = F.regexp_extract_all("content", F.lit(fv.PLUGIN_LAST_ID), F.lit(1))
    else:
        raise ValueError(f"mode must be 'all' or 'last', not {mode!r}")
    return (
        files.filter(F.col("path").endswith(".gradle"))
        .select("repo", "path", _score().alias("score"), F.posexplode(ids).alias("position", "plugin"))
        .select("repo", "path", "plugin", _position("position").alias("ord"))
    )


# -- F12 as rows ------------------------------------------------------------

def find_commands(survey: DataFrame) -> DataFrame:
    """Commands made of the root scripts of repos with a build system, one row each.

    `ord` is by falling score of the script, then as it is found.
    """
    command = fp.script_command()
    return (
        survey.filter(F.col("is_gathered") & (F.col("analyzer") == "java"))
        .select(*REPO, "path", by_score().alias("ord"), command.alias("c"))
        .filter(F.col("c").isNotNull())
        .select(*REPO, "c.kind", "c.command", "path", "ord")
    )


# -- A8 ---------------------------------------------------------------------

def _tool_signs() -> dict[str, list[tuple[Column, str]]]:
    """Per tool, the signs on one file, with a digit for the order they are looked for."""
    p = F.col("path")
    gradle = p.endswith(".gradle")
    boot = (p.endswith(".java") & F.col("has_boot")) | (gradle & F.col("has_boot_plugin"))
    named = {tool: fp.contains_one(p, names) for tool, names in fv.TOOL_NAMES.items()}
    return {
        "docker": [(named["docker"], "0")],
        "spring-boot": [(named["spring-boot"], "1"), (boot, "3")],
        "lombok": [(named["lombok"], "2"), (gradle & F.col("has_lombok"), "4")],
    }


def has_tool_sign() -> Column:
    """Files that show a tool, in repos whose tools are looked for."""
    signs = [condition for signs in _tool_signs().values() for condition, _ in signs]
    return F.col("is_gathered") & (F.col("analyzer") == "java") & fp.any_of(signs)


def tool_aggregates() -> dict[str, Column]:
    """Per tool, an aggregate with the place in the repo where it is first seen, by score.

    To be taken over the files with `has_tool_sign`, or any more of the same repos.
    """

    def first_seen(signs) -> Column:
        out = F
        for condition, digit in signs:
            out = out.when(condition, F.concat(by_score(), F.lit("\x01" + digit)))
        return F.min(F.when(has_tool_sign(), out))

    return {tool: first_seen(signs) for tool, signs in _tool_signs().items()}


def tools_in_order(first_seen: dict[str, Column]) -> Column:
    """``array<struct<first_ord, tool>>`` of the tools seen, in order."""
    return F.array_sort(
        F.array_compact(
            F.array(
                *[
                    F.when(
                        place.isNotNull(),
                        F.struct(place.alias("first_ord"), F.lit(tool).alias("tool")),
                    )
                    for tool, place in first_seen.items()
                ]
            )
        )
    )


def custom_tools(survey: DataFrame) -> DataFrame:
    """``repo, analyzer, tool, first_ord``: tools in use, by name or content of a file.

    One row per repo and tool, from one aggregate; `first_ord` orders a repo's tools.
    """
    seen = (
        survey.filter(has_tool_sign())
        .groupBy(*REPO)
        .agg(tools_in_order(tool_aggregates()).alias("tools"))
    )
    return seen.select(*REPO, F.explode("tools").alias("t")).select(
        *REPO, "t.tool", "t.first_ord"
    )
