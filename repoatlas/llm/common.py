"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from repoatlas.functions.batches import give_back, kept  # noqa: F401 - for the operators

#: A word: a run of characters other than ASCII white space. ``bytes.split()`` of the UTF-8
#: text cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"
#: Every group is dealt out over this many chunks, however large it is.
CHUNKS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches: Iterable[pa.RecordBatch], text: str, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column ``text`` of one holds about ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = batch.column(text).cast(pa.large_binary())
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(lengths), 0))
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.nonzero(np.diff(part))[0] + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(int(a), int(b - a))


def texts_of(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, nulls as empty."""
    column = batch.column(name).cast(pa.large_binary())
    for value in column:
        yield value.as_py() or b""


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores before them as long as one is among those taken."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = f"_{name}"
        out.append(name)
    return out


def id_slot(name: str, bits: int) -> Column:
    """A number of ``bits`` bits made of an id by folding it; see `id_slots`."""
    fold = " ^ ".join([name, *(f"shiftrightunsigned({name}, {n})" for n in range(bits, 64, bits))])
    return F.expr(f"CAST(({fold}) & {(1 << bits) - 1} AS int)")


def id_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    """The same numbers of an array of ids."""
    ids = ids.astype(np.int64).view(np.uint64)
    fold = ids.copy()
    for n in range(bits, 64, bits):
        fold ^= ids >> np.uint64(n)
    return (fold & np.uint64((1 << bits) - 1)).astype(np.int64)


def bit_field(ids: DataFrame, name: str, bits: int) -> np.ndarray:
    """Flags (one byte for eight) of the slots of the ids in a column; ``2**bits / 64`` rows come here."""
    slots = ids.select(id_slot(name, bits).alias("slot"))
    words = slots.groupBy(F.expr("slot div 64").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, slot % 64)")).alias("bits")
    )
    field = np.zeros(1 << (bits - 6), "<i8")
    for at, own in words.collect():
        field[at] = own
    return field.view(np.uint8)


def flagged(field: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (field[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)


def chunk_of(*order: str) -> Column:
    return F.pmod(F.xxhash64(*order), F.lit(CHUNKS)).cast("int")


def running_start(df: DataFrame, key: str, order: list[str], size: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``size`` over the rows before this one in its group.

    Rows of a group come by hashed chunk, then by ``order``; the key is not null. A group
    that holds a third of all rows is summed chunk by chunk, so no task gets it whole, and
    only one sum per group and chunk meets its like. ``df`` is read twice: save it first.
    """
    df = df.withColumn("_chunk", chunk_of(*order))
    sums = df.groupBy(key, "_chunk").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = (
        Window.partitionBy(key, "_chunk").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        df.withColumn("_own", F.coalesce(F.sum(size).over(within), F.lit(0)))
        .join(sums, [key, "_chunk"])
        .withColumn(out, (F.col("_base") + F.col("_own")).cast("long"))
        .drop("_chunk", "_own", "_base")
    )
