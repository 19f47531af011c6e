"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.sources.scratch import drop_folder, scratch_folder


def _saved(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` of all nodes in ``edges`` (columns ``a``, ``b``); the root is the smallest.

    Large and small stars by turns: first all larger neighbours of a node, then all smaller
    ones, are tied to the smallest node around it, until nothing changes. Each round is
    written to the shared folder. A node with very many neighbours only ever takes part in a
    minimum and in a join whose large partitions are split.
    """
    spark = edges.sparkSession
    base = scratch_folder(spark)
    turn = 0

    def save(df: DataFrame) -> tuple[DataFrame, str]:
        nonlocal turn
        turn += 1
        return _saved(df, f"{base}/{turn}"), f"{base}/{turn}"

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    larger = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, folder = save(larger.distinct())
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_at = save(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large, large_at = save(
            both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        small_least, small_at = save(large.groupBy("a").agg(F.min("b").alias("m")))
        tied = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = tied.filter("a <> b").unionByName(small_least.select("a", F.col("m").alias("b")))
        following, following_at = save(star.distinct())
        after = state(following)
        for old in (folder, least_at, large_at, small_at):
            drop_folder(spark, old)
        now, folder = following, following_at
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
