"""Ranking inside repos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.operators.classify import REPO


# -- R8 ---------------------------------------------------------------------

def sort_by_importance(
    files: DataFrame, scorer: Column | None = None, by: list[str] = REPO
) -> DataFrame:
    """Files of each repo, highest score first, ties in discovery order.

    A range-partitioned sort on keys that are all different: a large repo spreads over
    many partitions.
    """
    if scorer is not None:
        files = files.withColumn("importance_score", scorer)
    return files.orderBy(*by, F.desc("importance_score"), "ord")


# -- R9 ---------------------------------------------------------------------

def top_n(files: DataFrame, n: int, by: list[str] = REPO, rank: str = "rank") -> DataFrame:
    """Best ``n`` files of each repo with their rank.

    Spark pushes the group limit below the shuffle, so a task sends at most ``n`` rows of
    a repo, however many it holds.
    """
    best = Window.partitionBy(*by).orderBy(F.desc("importance_score"), F.asc("ord"))
    return files.withColumn(rank, F.row_number().over(best)).filter(F.col(rank) <= n)


def first_n(
    rows: DataFrame, n: int | None, by: list[str], order: str = "ord", rank: str = "rank"
) -> DataFrame:
    """First ``n`` (None: all) rows of each group in the given order, with their position."""
    first = Window.partitionBy(*by).orderBy(F.asc(order))
    ranked = rows.withColumn(rank, F.row_number().over(first))
    return ranked if n is None else ranked.filter(F.col(rank) <= n)


# -- R10 --------------------------------------------------------------------

def top_by_category(
    files: DataFrame,
    categories: dict[str, Column],
    per_category: int = fv.PER_CATEGORY,
    total: int = fv.CATEGORY_TOTAL,
    by: list[str] = REPO,
) -> DataFrame:
    """``by, position, path``: per category the best files not taken yet, then the best rest.

    Before category *i* at most ``k*(i-1)`` files are taken, so its picks are among its own
    best ``k*i``; the filling files are among the best ``2*total`` of all.  The state of a
    repo is therefore a few arrays of bounded length.
    """
    if per_category < 0 or total < 1:
        raise ValueError("total must be at least 1 and per_category not negative")
    count = len(categories)
    marks = [F.when(c, F.lit(i)) for i, c in enumerate(categories.values())]
    # the last number stands for "any file"
    numbers = F.array_compact(F.array(*marks, F.lit(count)))
    limit = max(per_category * count, 2 * total)
    best = Window.partitionBy(*by, "category").orderBy(F.desc("importance_score"), F.asc("ord"))
    pruned = (
        files.select(*by, "path", "ord", "importance_score", F.explode(numbers).alias("category"))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= limit)
        .filter(
            (F.col("category") == count)
            | (F.col("rank") <= per_category * (F.col("category") + 1))
        )
    )
    none = F.array().cast("array<string>")

    def of_category(ranked: Column, number: int) -> Column:
        return F.transform(F.filter(ranked, lambda x: x.category == number), lambda x: x.path)

    ranked = F.col("ranked")
    in_turn = F.array(*[of_category(ranked, i) for i in range(count)]) if count else F.array(none)
    taken = F.aggregate(
        in_turn,
        none,
        lambda acc, c: F.concat(acc, F.slice(F.array_except(c, acc), 1, per_category)),
    )
    rest = F.slice(
        F.array_except(F.col("rest"), F.col("taken")),
        F.lit(1),
        F.lit(total) - F.size("taken"),
    )
    return (
        pruned.groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("category", "rank", "path"))).alias("ranked"))
        .select(
            *by,
            F.slice(taken, 1, total).alias("taken"),
            of_category(ranked, count).alias("rest"),
        )
        .select(*by, F.posexplode(F.concat("taken", rest)).alias("position", "path"))
        .withColumn("position", F.col("position") + 1)
    )


# -- R11 as rows ------------------------------------------------------------

def cap_rows(
    rows: DataFrame,
    n: int,
    fmt: str,
    by: list[str],
    line: str = "line",
    order: str = "ord",
) -> DataFrame:
    """``by, position, line``: first ``n`` lines of a group and, for more, an overflow line."""
    first = first_n(rows.select(*by, line, order), n, by, order, "position")
    total = rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > n)
    more = total.select(
        *by,
        F.format_string(fmt, F.col("_n") - F.lit(n)).alias(line),
        F.lit(n + 1).alias("position"),
    )
    return first.select(*by, line, "position").unionByName(more)


# -- R12 --------------------------------------------------------------------

def priority_order(files: DataFrame, first: str = "build.gradle", by: list[str] = REPO):
    """Files in the order they are shown: a fixed path, then entry points, then the rest."""
    priority = (
        F.when(F.col("path") == first, F.lit(0))
        .when(F.col("is_entry_point"), F.lit(1))
        .otherwise(F.lit(2))
    )
    return files.withColumn("priority", priority).orderBy(*by, "priority", "ord")
