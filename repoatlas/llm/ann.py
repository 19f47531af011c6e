"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of several tables cuts the space by a few Gaussian projections into slots. A query visits,
in every table, the buckets around its own in the order of the probability that a neighbour at
the usual distance lies there, until these probabilities add up to a given share. What the
visited buckets hold is ranked by the exact distance, and the tables' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import erf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoatlas.llm.vectors import as_matrix, dimensions, load_vectors, safe_scale, sample_matrix
from repoatlas.sources.scratch import save_table

#: Tables, slot width in usual neighbour distances, and the probability to visit per table.
TABLES, WIDTH, SUCCESS = 4, 1.5, 0.6
#: Bounds of the sample that tells the usual distance of a neighbour.
SAMPLE, SAMPLE_QUERIES = 5000, 200
#: Vectors of a group that one task compares; queries of an exact pass over all vectors.
GROUP, EXACT_BLOCK = 16_384, 512
#: Queries that one task compares with a group, about; a group with more of them is read by several.
ASKS = 2048
#: A bucket of more than this share of the index is split; there are at most as many of those.
HEAVY = 65_536
_ERF = np.vectorize(erf, otypes=[float])


@dataclass(frozen=True)
class Tables:
    """``a``: table x dimension x projection; ``b``: table x projection, in slots."""

    a: np.ndarray
    b: np.ndarray
    width: float
    distance: float
    success: float

    def slots(self, x: np.ndarray, t: int) -> np.ndarray:
        return x @ self.a[t] / self.width + self.b[t]

    def key(self, slots: np.ndarray, t: int) -> np.ndarray:
        """64-bit key of the bucket with these slot numbers."""
        out = np.full(len(slots), t + 1, np.uint64)
        for column in slots.T.astype(np.int64).astype(np.uint64):
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def index_keys(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.key(np.floor(self.slots(x, t)), t) for t in range(len(self.a))], axis=1)

    def probes(self, x: np.ndarray) -> list[np.ndarray]:
        """For each row, the keys of the buckets to visit."""
        m = self.a.shape[2]
        steps = np.stack(np.unravel_index(np.arange(3**m), (3,) * m), axis=1) - 1
        scale = self.width / self.distance if self.distance else np.inf
        out: list[list[np.ndarray]] = [[] for _ in range(len(x))]
        for t in range(len(self.a)):
            at = self.slots(x, t)
            home = np.floor(at)
            low = (np.array([-1, 0, 1])[None, None] - (at - home)[..., None]) * scale
            share = (_ERF((low + scale) / 2**0.5) - _ERF(low / 2**0.5)) / 2
            for i in range(len(x)):
                total = share[i, 0]
                for j in range(1, m):
                    total = (total[:, None] * share[i, j]).ravel()
                order = np.argsort(-total, kind="stable")
                n = int(np.searchsorted(np.cumsum(total[order]), self.success)) + 1
                out[i].append(self.key(home[i] + steps[order[:n]], t))
        return [np.unique(np.concatenate(k)) for k in out]


def fit_tables(sample: np.ndarray, count: int, k: int, tables: int, width: float, success: float, seed: int) -> Tables:
    """Projections for ``count`` vectors; the slot width follows the sample's ``k``-th distance."""
    few = sample[:SAMPLE_QUERIES]
    square = (few**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * few @ sample.T
    distance = float(np.sqrt(np.median(np.maximum(0, np.sort(square, axis=1)[:, min(k, len(sample) - 1)]))))
    if distance == 0:
        distance = float(np.sqrt(max(square.max(), 0))) or 1.0
    rng = np.random.default_rng(seed)
    m = int(np.clip(round(np.log2(max(2, count)) / 2.5), 2, 8))
    dim = sample.shape[1]
    return Tables(rng.normal(size=(tables, dim, m)), rng.uniform(size=(tables, m)), width * distance, distance, success)


def best_of(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vector number, distance) of the ``k`` nearest rows of ``x`` for each query.

    A matrix product narrows the choice; the distances that decide are exact differences.
    ``open_`` says which pairs are candidates; a query is no candidate of its own.
    """
    out_q, out_x, out_d = [], [], []
    own = (x**2).sum(axis=1)
    for a in range(0, len(q), 64):
        part = q[a : a + 64]
        square = own[None] - 2 * part @ x.T + (part**2).sum(axis=1)[:, None]
        allowed = q_id[a : a + 64, None] != x_id[None]
        if open_ is not None:
            allowed &= open_[a : a + 64]
        square[~allowed] = np.inf
        if x.shape[0] > k:
            limit = np.partition(square, k - 1, axis=1)[:, k - 1]
            limit = limit + 1e-9 * (own.max() + (part**2).sum(axis=1))
        else:
            limit = np.full(len(part), np.inf)
        i, j = np.nonzero((square <= limit[:, None]) & allowed)
        exact = np.sqrt(((part[i] - x[j]) ** 2).sum(axis=1))
        order = np.lexsort((x_id[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        best = place < k
        out_q.append(i[best] + a)
        out_x.append(j[best])
        out_d.append(exact[best])
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_d)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _dealt(placed: DataFrame, asks: DataFrame, most: int) -> DataFrame:
    """Index rows and queries by group ``g`` and ``lot``.

    The queries of a group are dealt over lots of about ``most``; its index rows are repeated
    for every lot. Groups without queries are left out.
    """
    lots = save_table(asks.groupBy("g").agg(F.ceil(F.count("*") / most).cast("int").alias("_n")))
    each = placed.join(lots, "g").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    some = asks.join(lots, "g").withColumn("lot", F.pmod(F.xxhash64("vec_id"), F.col("_n")).cast("int"))
    return each.drop("_n").unionByName(some.drop("_n"))


FOUND = "query_id long, vec_id long, score double"


def _result(q_id, x_id, i, j, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q_id[i]), pa.array(x_id[j]), pa.array(d)], names=["query_id", "vec_id", "score"])


def nearest_neighbours(
    df: DataFrame, is_query, k: int = 10, tables: int = TABLES, width: float = WIDTH, success: float = SUCCESS,
    id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each query, nearest first.

    Queries are the rows where ``is_query`` (a condition on ``vec_id``) holds; candidates are
    all rows with another id and a vector of the same length. The score is the Euclidean
    distance in double precision, ties go to the smaller id; very large or small components
    are scaled by a power of two meanwhile, so that no square overflows (beside components
    2**500 times as large, small ones then count as zero). Vectors
    ``load_vectors`` leaves out take no part. Of equal vectors only
    the ``k + 1`` smallest ids can be results, so no more are kept. A query whose buckets hold
    fewer than ``k`` candidates is compared with all vectors. Of rows with the same id one
    counts, other columns are ignored, and an empty table gives no rows.
    """
    spark = df.sparkSession
    scales = {dim: safe_scale(most) for dim, most in dimensions(df, vec_col).items()}
    loaded = [load_vectors(df, id_col, vec_col, dim, scale=scale) for dim, scale in scales.items()]
    if not loaded:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    once = reduce(DataFrame.unionByName, loaded).groupBy("vec_id").agg(F.min(F.struct("same", "v")).alias("_x"))
    vectors = save_table(once.select("vec_id", "_x.v", "_x.same"))
    parts = []
    for dim, scale in scales.items():
        own = vectors.filter(F.octet_length("v") == 8 * dim)
        found = _nearest(own, dim, is_query, k, tables, width, success, seed)
        parts.append(found if scale == 1.0 else found.withColumn("score", F.col("score") / F.lit(scale)))
    return reduce(DataFrame.unionByName, parts)


def _nearest(
    vectors: DataFrame, dim: int, is_query, k: int, tables: int, width: float, success: float, seed: int,
) -> DataFrame:
    """The nearest among vectors of one length."""
    spark = vectors.sparkSession
    copy = Window.partitionBy("same").orderBy("vec_id")
    index = save_table(vectors.withColumn("_n", F.row_number().over(copy)).filter(F.col("_n") <= k + 1).drop("_n"))
    queries = vectors.filter(is_query)
    count = index.count()
    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    fitted = fit_tables(sample_matrix(index, dim, SAMPLE), count, k, tables, width, success, seed)
    shared = spark.sparkContext.broadcast(fitted)
    groups = max(1, -(-count * tables // GROUP))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = shared.value.index_keys(as_matrix(batch.column("v"), dim))
            for t in range(keys.shape[1]):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), pa.array(keys[:, t])], names=["vec_id", "v", "key"])

    placed = index.select("vec_id", "v").mapInArrow(keyed, "vec_id long, v binary, key long")
    most = max(GROUP // 4, -(-count * tables // HEAVY))
    heavy = {r.key: -(-r["count"] // most) for r in placed.groupBy("key").count().filter(F.col("count") > most).collect()}
    lots = spark.sparkContext.broadcast(heavy)  # at most HEAVY buckets

    def group_of(key: np.ndarray, lot: np.ndarray) -> np.ndarray:
        mixed = (key.view(np.uint64) + lot.astype(np.uint64) * np.uint64(0x632BE5AB)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            ids = batch.column("vec_id").to_numpy()
            n = np.array([lots.value.get(x, 1) for x in key.tolist()], np.uint64)
            lot = (ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)) % n
            yield pa.RecordBatch.from_arrays(
                [pa.array(group_of(key, lot)), batch.column("vec_id"), batch.column("v"),
                 pa.array([[x] for x in key.tolist()], pa.list_(pa.int64())), pa.array(np.zeros(len(key), bool))],
                names=["g", "vec_id", "v", "keys", "asks"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                rows: list[tuple] = []
                for q, v, keys in zip(part.column("vec_id").to_pylist(), part.column("v").to_pylist(),
                                      shared.value.probes(as_matrix(part.column("v"), dim))):
                    n = np.array([lots.value.get(x, 1) for x in keys.tolist()], np.int64)
                    key = np.repeat(keys, n)
                    lot = np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n)
                    g = group_of(key, lot)
                    order = np.argsort(g, kind="stable")
                    some, first = np.unique(g[order], return_index=True)
                    rows += [(h, q, v, own, True) for h, own in zip(some.tolist(), np.split(key[order], first[1:]))]
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                                 names=["g", "vec_id", "v", "keys", "asks"])

    shape = "g long, vec_id long, v binary, keys array<long>, asks boolean"
    asked = save_table(queries.select("vec_id", "v").mapInArrow(ask, shape))
    met = _dealt(placed.mapInArrow(deal, shape), asked, ASKS)

    def search(table: pa.Table) -> pa.Table:
        asks = table["asks"].combine_chunks()
        q, x = table.filter(asks), table.filter(pa.compute.invert(asks))
        if not q.num_rows or not x.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        key, number = np.unique(x["keys"].combine_chunks().flatten().to_numpy(), return_inverse=True)
        wanted = q["keys"].combine_chunks()
        length = np.asarray(pa.compute.list_value_length(wanted))
        ends = np.concatenate([[0], np.cumsum(length)])
        flat = wanted.flatten().to_numpy()
        q_id, x_id = q["vec_id"].to_numpy(), x["vec_id"].to_numpy()
        q_all, x_all = as_matrix(q["v"], dim), as_matrix(x["v"], dim)
        parts = []
        for a in range(0, len(q_id), 64):
            some = slice(a, a + 64)
            own = flat[ends[a] : ends[min(a + 64, len(q_id))]]
            at = np.minimum(np.searchsorted(key, own), len(key) - 1)
            hit = key[at] == own
            row = np.repeat(np.arange(len(length[some])), length[some])
            has = np.zeros((len(length[some]), len(key)), bool)
            has[row[hit], at[hit]] = True
            open_ = has[:, number]
            parts.append(_result(q_id[some], x_id, *best_of(q_all[some], q_id[some], x_all, x_id, k, open_)))
        return pa.Table.from_batches(parts)

    found = save_table(_ranked(met.groupBy("g", "lot").applyInArrow(search, FOUND), k))
    # Queries with too few candidates in their buckets: all vectors, block by block.
    full = found.groupBy("query_id").count().filter(F.col("count") >= k).select("query_id")
    short = save_table(queries.select("vec_id", "v").join(full, F.col("vec_id") == F.col("query_id"), "left_anti"))
    n_short = short.count()
    if not n_short:
        return found
    more = []
    blocks = -(-n_short // EXACT_BLOCK)
    for block in range(blocks):
        own = short.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).collect()
        if own:
            more.append(_all_compared(index, own, dim, k))
    rest = more[0]
    for df_ in more[1:]:
        rest = rest.unionByName(df_)
    kept = found.join(short.select(F.col("vec_id").alias("_id")), F.col("query_id") == F.col("_id"), "left_anti")
    return kept.unionByName(save_table(_ranked(rest, k)))


def _all_compared(index: DataFrame, rows: list, dim: int, k: int) -> DataFrame:
    """The nearest of all vectors for a block of queries that is sent to every task."""
    asked = index.sparkSession.sparkContext.broadcast(
        (np.array([r.vec_id for r in rows], np.int64), b"".join(bytes(r.v) for r in rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_id, data = asked.value
        q = np.frombuffer(data, "<f8").reshape(len(q_id), dim)
        for batch in batches:
            x, x_id = as_matrix(batch.column("v"), dim), batch.column("vec_id").to_numpy()
            yield _result(q_id, x_id, *best_of(q, q_id, x, x_id, k))

    return index.select("vec_id", "v").mapInArrow(run, FOUND)
