"""Vectors as rows of bytes, and blocks of them as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTORS = "vec_id long, v binary, same binary"
MOST_LENGTHS = 1000


def as_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a binary column of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    data = b"".join(x.as_py() for x in column)
    return np.frombuffer(data, "<f8").reshape(len(column), dim)


def as_binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in np.ascontiguousarray(matrix, "<f8")], pa.binary())


def dimensions(df: DataFrame, vec_col: str) -> dict[int, float]:
    """The lengths of the vectors, and the largest component of each length's vectors.

    Vectors are compared with those of their own length only. One row per length comes to the
    driver, and each length is a job of its own; more than ``MOST_LENGTHS`` are refused.
    """
    e = F.col("e")
    whole = F.forall("e", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    largest = F.when(whole, F.array_max(F.transform(e, F.abs)))
    rows = df.select(F.col(vec_col).cast("array<double>").alias("e")).filter(F.size("e") > 0)
    found = rows.groupBy(F.size("e").alias("dim")).agg(F.max(largest).alias("most"))
    found = found.filter("most > 0").limit(MOST_LENGTHS + 1).collect()
    if len(found) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    return {r.dim: r.most for r in sorted(found)}


def safe_scale(most: float) -> float:
    """A power of two that keeps squares of such components within a double; 1 for most tables."""
    exponent = int(np.frexp(most)[1])
    return 1.0 if abs(exponent) < 300 else float(np.ldexp(1.0, -exponent))


def unit_rows(x: np.ndarray) -> np.ndarray:
    """The rows, finite and not zero, with length 1, whatever the size of their components."""
    # by a power of two first, which is exact, so that no square is lost
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def load_vectors(
    df: DataFrame, id_col: str, vec_col: str, dim: int, scale: float = 1.0,
) -> DataFrame:
    """``vec_id``, ``v`` (doubles as bytes) and ``same`` (hash of the vector), of length ``dim``.

    Left out are rows with a null id and vectors that are null, zero, or hold null or
    non-finite components. They are multiplied by ``scale``; the hash is of the vector as it came.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            most = np.abs(x).max(axis=1)
            good = np.isfinite(x).all(axis=1) & (most > 0)
            ids, x = batch.column("vec_id").filter(pa.array(good)), x[good] + 0.0
            same = [xxhash.xxh3_128_digest(row.tobytes()) for row in x]
            if scale != 1.0:
                x = x * scale
            yield pa.RecordBatch.from_arrays([ids, as_binary(x), pa.array(same, pa.binary())], names=["vec_id", "v", "same"])

    return rows.filter((F.col("vec_id").isNotNull()) & (F.size("e") == dim)).mapInArrow(run, VECTORS)


def sample_matrix(vectors: DataFrame, dim: int, most: int) -> np.ndarray:
    """The first ``most`` vectors in the order of their hashed ids."""
    few = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "same").limit(most).select("v").collect()
    return np.frombuffer(b"".join(r.v for r in few), "<f8").reshape(len(few), dim)
