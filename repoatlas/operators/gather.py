"""Ordered collection of rows into one value per group, or into the pieces of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_part(rows: DataFrame, order: str, pieces: bool) -> DataFrame:
    """Add `part`: empty, or with ``pieces`` the row's order key.

    Grouping by the keys and `part` makes one value of each group, or leaves every row a
    piece of its own. The caller chooses; the size of a group changes nothing. Pieces are the
    form for groups beyond what one value should hold.
    """
    return rows.withColumn("part", F.col(order) if pieces else F.lit(""))


def ordered(value: str, order: str) -> Column:
    """Aggregate: array of the values of the group, by their order key."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value))))
    return F.transform(items, lambda x: x[value])


def gather_array(
    rows: DataFrame, keys: list[str], value: str, order: str = "ord", pieces: bool = False
) -> DataFrame:
    """One ordered array per group, as ``keys, part, value``.

    With ``pieces`` a group is as many rows as it has items: ordered by `part`, their arrays
    make up the group.
    """
    return (
        with_part(rows, order, pieces)
        .groupBy(*keys, "part")
        .agg(ordered(value, order).alias(value))
    )


def gather_text(
    rows: DataFrame,
    keys: list[str],
    text: str = "text",
    order: str = "ord",
    sep: str = "",
    pieces: bool = False,
) -> DataFrame:
    """Like `gather_array`, with the ordered texts of each row joined by ``sep``."""
    return gather_array(rows, keys, text, order, pieces).withColumn(
        text, F.array_join(F.col(text), sep)
    )
