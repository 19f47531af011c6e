"""Near-duplicate vectors by cosine, compared between the cells of a spherical k-means.

For linked unit vectors ``x`` of cell ``c`` and ``y`` of cell ``d``, with ``|x - y| <= s``, the
margins ``x.(c - d)`` and ``y.(d - c)`` add up to at most ``s |c - d|``. So of two cells, ordered
by their margins, each vector is compared with the first ones of the other only, which finds every
link once; with ``margin``, one of the two margins must be at most that, which loses links.

Different vectors are written once, as they came, in the order of their cells. A task reads two
groups of them from the files, so what is written does not grow with the number of comparisons.
Vectors are compared by their first principal components and the length of the rest, which is an
upper bound of the cosine; what passes is compared in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from repoatlas.functions.batches import give_back, kept
from repoatlas.llm.components import connected_components
from repoatlas.llm.vectors import dimensions, unit_rows
from repoatlas.sources.scratch import save_table, scratch_folder
from repoatlas.sources.stores import open_store

THRESHOLD = 0.9
#: The centroids go to every task: at most this many. The sample they are fitted on: vectors per
#: cell, and bytes at most.
MOST_CELLS, SAMPLE_PER_CELL, SAMPLE_BYTES, ROUNDS = 4096, 32, 1 << 26, 8
#: Vectors of a group: so many blocks of this many at most, and no more than have so many bytes.
BLOCK, GROUP_BLOCKS, GROUP_BYTES = 2048, 16, 1 << 25
#: Rows of a cell that are compared at once.
CHUNK = 512
#: Rows of a task whose equal vectors are collapsed together before any are sent.
LOT = 1 << 15
#: Tasks that compare, at most; each takes pairs of groups.
MOST_TASKS = 4096
SLACK = 1e-9


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Unit centroids; a cell that loses all its vectors gets the one that fits worst."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        home, nearest = np.empty(len(sample), np.int64), np.empty(len(sample))
        for a in range(0, len(sample), 1024):
            sims = sample[a : a + 1024] @ centroids.T
            home[a : a + 1024], nearest[a : a + 1024] = sims.argmax(axis=1), sims.max(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, home, sample)
        norm = np.sqrt((total * total).sum(axis=1))
        empty = norm < 1e-12
        worst = np.argsort(nearest, kind="stable")[: int(empty.sum())]
        norm[empty] = 1
        total /= norm[:, None]
        total[np.nonzero(empty)[0][: len(worst)]] = sample[worst]
        centroids = total
    return centroids


def homes(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The cell of each row, the same for equal rows in whatever company.

    A product of matrices may round differently from batch to batch; what it leaves in doubt is
    decided by exactly rounded sums.
    """
    home = np.empty(len(x), np.int64)
    for a in range(0, len(x), 1024):
        sims = x[a : a + 1024] @ centroids.T
        home[a : a + 1024] = sims.argmax(axis=1)
        close = sims >= sims.max(axis=1, initial=-np.inf)[:, None] - SLACK
        for i in np.nonzero(close.sum(axis=1) > 1)[0]:
            home[a + i] = max(np.nonzero(close[i])[0].tolist(), key=lambda c: (math.fsum(x[a + i] * centroids[c]), -c))
    return home


@dataclass(frozen=True)
class Screen:
    """``axes``: directions, the most telling first, of which ``first`` are multiplied out."""

    axes: np.ndarray
    first: int

    def short(self, x: np.ndarray) -> np.ndarray:
        """Rows whose products are upper bounds of those of the rows of ``x``, but for `least`."""
        y = x @ self.axes[:, : self.first]
        if self.first == self.axes.shape[1]:
            return y.astype("f4")
        rest = np.sqrt(np.maximum(0, (x * x).sum(axis=1) - (y * y).sum(axis=1)))
        return np.concatenate([y, rest[:, None]], axis=1).astype("f4")

    def least(self, threshold: float) -> np.float32:
        """What single precision makes of a product of ``threshold`` at the least."""
        return np.float32(threshold - 1e-6 - 1.5e-7 * (self.first + 2))


def fit_screen(sample: np.ndarray, threshold: float) -> Screen:
    """The number of directions that takes the least time; what passes costs some 200 as much."""
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()
    dim = axes.shape[1]
    a, b = np.array_split(sample[:4096], 2)
    linked = (a @ b.T >= threshold - 1e-6).mean() if len(b) else 0.0
    best, least = dim, np.inf
    for first in sorted({*range(8, dim, 4), dim}):
        if first > 8 and first + 1 >= least:
            break
        screen = Screen(axes, first)
        passed = (screen.short(a) @ screen.short(b).T >= screen.least(threshold)).mean() if len(b) else 0.0
        cost = first + 1 + 200 * dim * max(0.0, passed - linked) * 4
        if cost < least:
            best, least = first, cost
    return Screen(axes, best)


def lowest_labels(mask: np.ndarray, row_label: np.ndarray, col_label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label that each row and column reaches over the marked pairs."""
    most = np.iinfo(np.int64).max
    rows, cols = row_label.copy(), col_label.copy()
    while True:
        new_cols = np.minimum(cols, np.where(mask, rows[:, None], most).min(axis=0, initial=most))
        new_rows = np.minimum(rows, np.where(mask, new_cols[None], most).min(axis=1, initial=most))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def compare_block(rows: dict, cols: dict, cell: int, threshold: float, chunk: int = CHUNK) -> dict:
    """Links counted at each vector of a block, and its smallest reachable id.

    ``rows`` live in the cell; ``cols`` live in it or visit it. A row counts every column it
    links with. A visiting column counts a row only if that row does not visit the column's
    own cell, where the pair would be counted from the other side. The rows are taken by
    ``chunk``; where a later one lowers the label of a column, the old label is linked with the
    new one, so what the earlier chunks joined stays joined.
    """
    ids: list[np.ndarray] = []
    links: list[np.ndarray] = []
    labels: list[np.ndarray] = []
    col_links = np.zeros(len(cols["id"]), np.int64)
    col_label = cols["id"].copy()
    visitor = cols["home"] != cell
    for a in range(0, len(rows["id"]), chunk):
        part = slice(a, a + chunk)
        own = rows["id"][part]
        mask = rows["x"][part] @ cols["x"].T >= threshold
        mask &= own[:, None] != cols["id"][None]
        if not mask.any():
            continue
        r, c = np.nonzero(mask.any(axis=1))[0], np.nonzero(mask.any(axis=0))[0]
        small = mask[np.ix_(r, c)]
        ids.append(own[r])
        links.append(small @ cols["n"][c])
        met = rows["goes"][part][np.ix_(r, cols["home"][c])]
        col_links[c] += rows["n"][part][r] @ (small & visitor[c][None] & ~met)
        before = col_label[c]
        low, col_label[c] = lowest_labels(small, own[r], before)
        labels.append(low)
        lowered = col_label[c] < before
        joined = np.unique(np.stack([before[lowered], col_label[c][lowered]]), axis=1)
        ids.append(joined[0])
        links.append(np.zeros(joined.shape[1], np.int64))
        labels.append(joined[1])
    some = col_links > 0
    ids.append(cols["id"][some])
    links.append(col_links[some])
    labels.append(col_label[some])
    return {"vec_id": np.concatenate(ids), "links": np.concatenate(links), "label": np.concatenate(labels)}


def near_duplicates(
    df: DataFrame, threshold: float = THRESHOLD, margin: float | None = None,
    id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``df``.

    Two vectors of one length link when their cosine, in double precision, is at least
    ``threshold``. Vectors ``load_vectors`` leaves out link with nothing. Equal vectors are compared once and
    counted as often as they occur; rows of one id with different vectors share their links.
    Other columns are ignored, an empty table gives no rows. ``kept`` marks the smallest id of
    a component. With ``margin`` None no link is lost.
    """
    everyone = df.select(F.col(id_col).cast("long").alias("vec_id"))
    parts = []
    for dim in dimensions(df, vec_col):
        rows = _Rows(df, id_col, vec_col, dim)
        total = rows.keys().select("same").distinct().count()
        if total:
            cells = int(min(MOST_CELLS, max(1, round(total**0.5 / 3))))
            sample = rows.sample(total, min(SAMPLE_PER_CELL * cells, max(1, SAMPLE_BYTES // (8 * dim))))
            centroids, screen = fit_centroids(sample, cells, seed=seed), fit_screen(sample, threshold)
            folder = scratch_folder(df.sparkSession)
            distinct = _placed(rows, total, centroids, folder)
            found = _compared(distinct, folder, rows, total, centroids, screen, threshold, margin)
            copies = distinct.select("same", F.col("vec_id").alias("rep"), "n")
            parts.append((rows.keys(), copies, found))
    if not parts:
        return everyone.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    vectors, copies, found = (reduce(DataFrame.unionByName, same_kind) for same_kind in zip(*parts))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("_links")).withColumnRenamed("vec_id", "_rep")
    roots = connected_components(found.filter("label <> vec_id").select(F.col("vec_id").alias("a"), F.col("label").alias("b")))
    by_rep = copies.join(links, F.col("rep") == F.col("_rep"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    by_rep = save_table(by_rep.select(
        "same", "rep", (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("root", "rep").alias("component_id"),
    ).filter("n_links > 0 OR component_id <> rep").drop("rep"))  # the others have what a row without links has
    linked = vectors.select("vec_id", "same").join(by_rep, "same").groupBy(F.col("vec_id").alias("_id")).agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = everyone.join(linked, F.col("vec_id") == F.col("_id"), "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


class _Rows:
    """The vectors of one length that take part, read from ``df`` anew each time."""

    def __init__(self, df: DataFrame, id_col: str, vec_col: str, dim: int):
        single = isinstance(df.schema[vec_col].dataType.elementType, FloatType)
        self.dim, self.kind = dim, "<f4" if single else "<f8"
        e = F.col(vec_col).cast("array<float>" if single else "array<double>")
        rows = df.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("e"))
        self.rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("e") == dim))

    def map(self, run, schema: str) -> DataFrame:
        """What ``run`` makes of ids, vectors as doubles, and their hashes of two numbers each."""
        dim = self.dim

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for batch in batches:
                for a in range(0, batch.num_rows, LOT):
                    part = batch.slice(a, LOT)
                    x = part.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("<f8")
                    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                    x = x[good] + 0.0
                    ids = np.asarray(part.column("vec_id"))[good]
                    same = b"".join([xxhash.xxh3_128_digest(row) for row in x])
                    yield from run(ids, x, np.frombuffer(same, ">u8").reshape(-1, 2))

        return self.rows.mapInArrow(of, schema)

    def keys(self) -> DataFrame:
        """``vec_id`` and ``same``, the hash of the vector."""
        return self.map(lambda ids, x, same: [pa.RecordBatch.from_arrays([pa.array(ids), _digests(same)], names=["vec_id", "same"])],
                        "vec_id long, same binary")

    def sample(self, total: int, most: int) -> np.ndarray:
        """About ``most`` of ``total`` different vectors, those of the smallest hashes, as unit vectors."""
        bound = np.uint64(min(2**64 - 1, int(2**64 * (1.1 * most + 100) / total)))

        def few(ids: np.ndarray, x: np.ndarray, same: np.ndarray) -> list[pa.RecordBatch]:
            at = np.unique(same, axis=0, return_index=True)[1]
            at = at[same[at, 0] <= bound]
            return [pa.RecordBatch.from_arrays([_digests(same[at]), _as_bytes(x[at])], names=["same", "v"])]

        found = self.map(few, "same binary, v binary").groupBy("same").agg(F.first("v").alias("v")).orderBy("same").limit(most)
        return unit_rows(np.frombuffer(b"".join(r.v for r in found.select("v").collect()), "<f8").reshape(-1, self.dim))


def _digests(same: np.ndarray) -> pa.Array:
    return _as_bytes(same.astype(">u8"))


def _as_bytes(matrix: np.ndarray) -> pa.Array:
    """Each row as its bytes."""
    matrix = np.ascontiguousarray(matrix)
    width = matrix.dtype.itemsize * matrix.shape[1]
    return pa.Array.from_buffers(pa.binary(width), len(matrix), [None, pa.py_buffer(matrix.tobytes())]).cast(pa.binary())


def _from_bytes(column: pa.Array | pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    """The rows of ``width`` numbers that `_as_bytes` made bytes of."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, width), kind)
    first = np.frombuffer(column.buffers()[1], "<i4", 1, 4 * column.offset)[0]
    return np.frombuffer(column.buffers()[2], kind, len(column) * width, first).reshape(-1, width)


def _group_rows(total: int, dim: int) -> int:
    """Vectors of a group: so few that a worker holds two, and some pairs of groups at least."""
    most = min(GROUP_BLOCKS * BLOCK, max(1, GROUP_BYTES // (8 * dim)))
    return max(min(most, BLOCK), min(most, -(-total // 8)))


def _placed(rows: _Rows, total: int, centroids: np.ndarray, folder: str) -> DataFrame:
    """``home, same, vec_id, n, e`` of every different vector, in the order of the cells.

    ``vec_id`` is the smallest id, ``n`` counts the rows. Equal vectors are collapsed before they
    are sent, so that one of which there are very many does not fill a task.
    """
    dim, kind = rows.dim, rows.kind
    shared = rows.rows.sparkSession.sparkContext.broadcast(centroids)
    names = ["home", "same", "vec_id", "n", "e"]

    def place(ids: np.ndarray, x: np.ndarray, same: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        order = np.lexsort((ids, same[:, 1], same[:, 0]))
        same = same[order]
        at = np.nonzero(np.append(True, (same[1:] != same[:-1]).any(axis=1)))[0]
        n, one = np.diff(np.append(at, len(ids))), order[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array(homes(unit_rows(x[one]), shared.value), pa.int32()), _digests(same[at]),
             pa.array(ids[one]), pa.array(n, pa.int64()), _as_bytes(x[one].astype(kind))], names=names)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # of the rows so far; the next may be equal
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            same = _from_bytes(table["same"], ">u8", 2)
            at = np.nonzero(np.append(True, (same[1:] != same[:-1]).any(axis=1)))[0]
            ids = np.minimum.reduceat(np.asarray(table["vec_id"]), at)
            n = np.add.reduceat(np.asarray(table["n"]), at)
            table = table.take(pa.array(at))
            table = table.set_column(2, "vec_id", pa.array(ids)).set_column(3, "n", pa.array(n))
            *full, last = table.slice(0, len(at) - 1).to_batches() + table.slice(len(at) - 1).combine_chunks().to_batches()
            yield from full
        if last is not None:
            yield last

    schema = "home int, same binary, vec_id long, n long, e binary"
    groups = -(-total // _group_rows(total, dim))
    dealt = rows.map(place, schema).repartitionByRange(groups, "home", "same").sortWithinPartitions("home", "same")
    return save_table(dealt.mapInArrow(collapse, schema), folder)


def _group(names: list[str], folder: str, dim: int, kind: str, centroids: np.ndarray, screen: Screen) -> dict:
    """The vectors of some files, and where those of a cell stand."""
    store, at = open_store(folder)
    tables = []
    for name in names:
        with store.open_input_file(f"{at}/{name}") as file:
            tables.append(pq.ParquetFile(file).read(["home", "vec_id", "n", "e"]))
    table = pa.concat_tables(tables)
    home = np.asarray(table["home"]).astype(np.int64)
    order = np.argsort(home, kind="stable")
    home = home[order]
    x = unit_rows(_from_bytes(table["e"], kind, dim)[order].astype("<f8"))
    starts = np.nonzero(np.append(True, home[1:] != home[:-1]))[0]
    return {
        "id": np.asarray(table["vec_id"])[order], "n": np.asarray(table["n"])[order], "x": x, "short": screen.short(x),
        "own": np.einsum("ij,ij->i", x, centroids[home]), "cells": home[starts],
        "spans": [*zip(starts.tolist(), [*starts[1:].tolist(), len(home)])],
    }


def _candidates(ma: np.ndarray, mb: np.ndarray, apart: float, threshold: float, margin: float | None, chunk: int) -> Iterator[tuple]:
    """Rows of one cell and those of another they are compared with, by the margins of both."""
    if margin is not None:
        near, others, close = ma <= margin + SLACK, ma > margin + SLACK, np.nonzero(mb <= margin + SLACK)[0]
        for rows, cols in ((np.nonzero(near)[0], np.arange(len(mb))), (np.nonzero(others)[0], close)):
            for a in range(0, len(rows) if len(cols) else 0, chunk):
                yield rows[a : a + chunk], cols
        return
    most = np.sqrt(2 - 2 * threshold) * apart + SLACK
    rows = np.nonzero(ma <= most - mb.min())[0]
    rows, cols = rows[np.argsort(ma[rows])], np.argsort(mb)
    sorted_mb = mb[cols]
    for a in range(0, len(rows), chunk):
        n = np.searchsorted(sorted_mb, most - ma[rows[a]], "right")
        if not n:
            return
        yield rows[a : a + chunk], cols[:n]


def compare_groups(
    left: dict, right: dict, centroids: np.ndarray, screen: Screen, threshold: float, margin: float | None,
) -> Iterator[dict]:
    """Links and labels, as of `compare_block`, of all pairs of vectors of two groups, or within one."""
    least = screen.least(threshold)
    from_left = left["x"] @ centroids[right["cells"]].T
    from_right = right["x"] @ centroids[left["cells"]].T
    for i, (c, (a, b)) in enumerate(zip(left["cells"], left["spans"])):
        for j, (d, (f, g)) in enumerate(zip(right["cells"], right["spans"])):
            if left is right and j < i:
                continue
            inside = left is right and j == i
            if c == d:
                every = np.arange(g - f)
                pairs = ((np.arange(k, min(k + CHUNK, b - a)), every) for k in range(0, b - a, CHUNK))
            else:
                ma, mb = left["own"][a:b] - from_left[a:b, j], right["own"][f:g] - from_right[f:g, i]
                apart = np.sqrt(((centroids[c] - centroids[d]) ** 2).sum())
                pairs = _candidates(ma, mb, apart, threshold, margin, CHUNK)
            last, short = None, None
            for rows, cols in pairs:
                if last is None or len(cols) > len(last) or margin is not None:
                    last, short = cols, right["short"][f:g][cols]
                passed = np.flatnonzero(left["short"][a:b][rows] @ short[: len(cols)].T >= least)
                if not len(passed):
                    continue
                r, t = np.unique(passed // len(cols)), np.unique(passed % len(cols))
                r, t = rows[r] + a, cols[t] + f
                some = {k: left[k][r] for k in ("id", "n", "x")} | {"goes": np.zeros((len(r), 1), bool)}
                # a column of the same block is counted as a row; any other as a visitor
                others = {k: right[k][t] for k in ("id", "n", "x")} | {"home": np.full(len(t), 0 if inside else -1)}
                yield compare_block(some, others, 0, threshold)


def _compared(
    distinct: DataFrame, folder: str, rows: _Rows, total: int, centroids: np.ndarray, screen: Screen,
    threshold: float, margin: float | None,
) -> DataFrame:
    """``vec_id, links, label``: links counted and labels reached among different vectors of one length.

    Files are put together to groups; a task takes some pairs of groups, a row for each.
    """
    spark = distinct.sparkSession
    files = distinct.groupBy(F.col("_metadata.file_name").alias("name")).count().collect()  # a row per group, nearly
    groups: list[list[str]] = []
    held, most = 0, _group_rows(total, rows.dim)
    for name, n in sorted(map(tuple, files)):
        if not groups or held + n > most * 1.25:
            groups.append([])
            held = 0
        groups[-1].append(name)
        held += n
    pairs = len(groups) * (len(groups) + 1) // 2
    dim, kind, folder = rows.dim, rows.kind, _qualified(spark, folder)
    shared = spark.sparkContext.broadcast((centroids, screen, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, screen, groups = shared.value
        numbers = [k for batch in batches for k in batch.column("id").to_pylist()]
        get = lambda k: _group(groups[k], folder, dim, kind, centroids, screen)
        at = None
        for number in numbers:
            i = (math.isqrt(8 * number + 1) - 1) // 2
            j = number - i * (i + 1) // 2
            if at != i:
                at, left = i, kept((folder, i), lambda: get(i))
            found = [*compare_groups(left, left if i == j else get(j), centroids, screen, threshold, margin)]
            if found:
                table = pa.table({k: np.concatenate([x[k] for x in found]) for k in ("vec_id", "links", "label")})
                table = table.group_by(["vec_id", "label"]).aggregate([("links", "sum")])
                yield from table.select(["vec_id", "links_sum", "label"]).rename_columns(["vec_id", "links", "label"]).to_batches(max_chunksize=1 << 16)
        give_back((folder, at))

    tasks = spark.range(0, pairs, 1, min(pairs, MOST_TASKS))
    return save_table(tasks.mapInArrow(run, "vec_id long, links long, label long"))


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
