"""Removal of long byte strings that occur elsewhere, by suffix arrays over bounded blocks.

Two equal strings of ``length`` bytes have the same *anchor*: the k-gram with the smallest hash,
at the same place. So every start of such a string belongs to one anchor, strings can only be
equal within the group of an anchor, and a group whose anchor occurs once needs no text. For
the others the text around the anchors is put into blocks, whole groups together. In a block
the common prefixes of neighbouring suffixes follow from the Burrows-Wheeler transform:
intervals of suffixes are extended backwards, breadth first, which gives the common prefixes by
increasing value, and the search stops at ``length``; a pair of neighbours without a value by
then shares at least ``length`` bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import bit_field, flagged, give_back, id_slots, small_batches, texts_of
from repoatlas.sources.scratch import save_table

LENGTH = 400
#: Bytes of an anchor; starts looked at together; bytes of one block.
GRAM_LOG2, PART, BLOCK_BYTES = 6, 1 << 22, 1 << 19
#: Distances of a start to its anchor that are told apart in groups above a block, by turns.
STEPS = (32, 1)
FILTER_BITS = 23
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


# --- anchors ---------------------------------------------------------------------------------

def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of all k-grams of a byte string, k a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _A
    h ^= h >> np.uint64(29)
    n = 1
    for _ in range(GRAM_LOG2):
        h = h[:-n] * _B + (h[n:] ^ (h[n:] >> np.uint64(31))) * _C
        n *= 2
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts with one anchor: its hash, its place, first and last start.

    The leftmost of equal hashes counts, which is the same in equal strings.
    """
    none = np.zeros(0, np.int64)
    if len(text) < length:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(np.frombuffer(text, np.uint8))
    width = length - (1 << GRAM_LOG2) + 1
    n = len(h) - width + 1
    place = np.empty(n, np.int64)
    for a in range(0, n, PART):
        own = h[a : min(a + PART, n) + width - 1]
        key = (own >> np.uint64(24) << np.uint64(24)) | np.arange(len(own), dtype=np.uint64)
        full = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
        full[: len(key)] = key
        full = full.reshape(-1, width)
        left = np.minimum.accumulate(full, axis=1).ravel()
        right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        m = len(own) - width + 1
        least = np.minimum(right[:m], left[width - 1 : width - 1 + m])
        place[a : a + m] = a + (least & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.nonzero(np.concatenate([[True], place[1:] != place[:-1]]))[0]
    return h[place[new]], place[new], new, np.append(new[1:], n) - 1


# --- blocks ----------------------------------------------------------------------------------

def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, by prefix doubling.

    The first symbols of a suffix, as many as a 64-bit number holds, are sorted as one number;
    later rounds sort only the suffixes that share their rank with another.
    """
    n = len(symbols)
    used = np.bincount(symbols) > 0
    rank = (np.cumsum(used) - 1)[symbols]
    step, kinds = 1, int(used.sum()) + 1
    while step < min(depth, n) and kinds**2 < 1 << 63:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        rank = rank * kinds + after
        step, kinds = 2 * step, kinds**2
    order = np.argsort(rank, kind="stable")
    key = rank[order]
    rank = np.empty(n, np.int64)
    places = np.arange(n)
    while True:  # the rank of a suffix is the first place of its group, which later rounds keep
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        rank[order[places]] = np.repeat(places[first], np.diff(np.append(first, len(places))))
        places = places[~(new & np.append(new[1:], True))]
        if step >= depth or not len(places):
            return order
        own = order[places]
        after = np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + after
        by = np.argsort(key, kind="stable")
        order[places], key = own[by], key[by]
        step *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, ``length`` standing for all above.

    ``out[i]`` belongs to places ``i - 1`` and ``i``. An interval of suffixes that begin with
    one string is extended by each symbol before it; where its end has no value yet, the value
    is the length of the string, and the longer string is extended in the next turn.
    """
    n = len(symbols)
    before = symbols[order - 1]
    if n and symbols.max() < 1 << 16:
        before = before.astype(np.uint16)  # these are sorted by their digits
    last_first = np.empty(n, np.int64)  # place of the suffix that begins one symbol earlier
    last_first[np.argsort(before, kind="stable")] = np.arange(n)
    out = np.full(n + 1, -1, np.int64)
    out[0] = out[n] = 0
    low, high = np.array([0]), np.array([n - 1])
    for value in range(length):
        one = low == high
        new_low, new_high = [last_first[low[one]]], [last_first[low[one]]]
        low, high = low[~one], high[~one]
        if len(low):
            size = high - low + 1
            at = np.arange(size.sum()) + np.repeat(low - np.cumsum(size) + size, size)
            symbol = before[at]
            by = np.argsort(symbol, kind="stable")  # and so by interval and place, too
            symbol, number, to = symbol[by], np.repeat(np.arange(len(low)), size)[by], last_first[at[by]]
            edge = (symbol[1:] != symbol[:-1]) | (number[1:] != number[:-1])
            new_low.append(to[np.concatenate([[True], edge])])
            new_high.append(to[np.concatenate([edge, [True]])])
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        fresh = out[high + 1] < 0
        low, high = low[fresh], high[fresh]
        out[high + 1] = value
        if not len(low):
            break
    out[out < 0] = length
    return out[:n]


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, whether the ``length`` bytes from each start occur elsewhere in the texts."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes) - 1
    symbols = np.empty(int(sizes.sum()), np.int64)
    symbols[:] = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + len(texts)
    symbols[ends] = np.arange(len(texts))  # an end mark of its own for each text
    order = suffix_array(symbols, length)
    same = common_prefixes(symbols, order, length) >= length
    marked = np.zeros(len(symbols), bool)
    marked[order[same]] = True
    marked[order[np.nonzero(same)[0] - 1]] = True
    return [marked[e - s + 1 : e - length + 1] for e, s in zip(ends, sizes)]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.nonzero(edge > 0)[0].tolist(), (np.nonzero(edge < 0)[0] - 1).tolist()))


# --- the job ---------------------------------------------------------------------------------

PLACES = "doc_id long, t1 long, t2 long, anchor long, off int, lo long, hi long, times long, c1 long, c2 long"
#: Rows of one batch of places.
PLACES_BATCH = 1 << 14
KEYS = ["anchor", "c1", "c2"]


def _digest(data: bytes) -> tuple[int, int]:
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(data), "<i8").tolist())


def same_as_before(text: bytes, h: np.ndarray, off: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Runs of one start each that have the anchor and the bytes of the run before.

    Those are the starts inside a long run of one byte, where every start is its own anchor.
    """
    data = np.frombuffer(text, np.uint8)
    ends = np.append(np.flatnonzero(data[1:] != data[:-1]), len(data) - 1)  # of runs of one byte
    covered = ends[np.searchsorted(ends, np.maximum(lo - 1, 0))] >= lo + length - 1
    single = lo == hi
    out = np.zeros(len(lo), bool)
    out[1:] = single[1:] & single[:-1] & covered[1:] & (h[1:] == h[:-1]) & (off[1:] == off[:-1])
    return out


def find_places(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row for each run of starts with one anchor in ``doc_id, text``.

    ``t1, t2`` is a hash of the text, ``lo`` to ``hi`` are the starts, ``off`` is how far the
    anchor lies behind ``lo``, and ``c1, c2`` is a hash of the bytes that the starts cover. A
    row with ``times`` above 1 stands for that many runs of a single start, one after the
    other, whose bytes are all the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 4 + [pa.int32()] + [pa.int64()] * 5
        names = ["doc_id", "t1", "t2", "anchor", "off", "lo", "hi", "times", "c1", "c2"]
        for batch in small_batches(batches, "text"):
            columns: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                if len(text) < length:
                    continue
                h, place, lo, hi = anchors(text, length)
                t1, t2 = _digest(text)
                off = place - lo
                first = np.flatnonzero(~same_as_before(text, h, off, lo, hi, length))
                times = np.diff(np.append(first, len(lo)))
                h, off, lo, hi = h[first].view(np.int64), off[first], lo[first], hi[first]
                for at in range(0, len(lo), PLACES_BATCH):
                    own = [x[at : at + PLACES_BATCH].tolist() for x in (h, off, lo, hi, times)]
                    context = [_digest(b"%d:" % o + text[a : b + length]) for _, o, a, b, _ in zip(*own)]
                    n = len(context)
                    own = [[doc] * n, [t1] * n, [t2] * n, *own, [c[0] for c in context], [c[1] for c in context]]
                    for column, values in zip(columns, own):
                        column += values
                    if len(columns[0]) >= PLACES_BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
                        columns = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        give_back()

    return docs.mapInArrow(run, PLACES)


def _text_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` without most of those that have no row in ``wanted`` (by ``doc_id, t1, t2``).

    A bit field of fixed size tells which hashed ids occur; the join that follows is exact.
    """
    # a null id is taken as -1 in the filter
    some = wanted.select(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_field(some, "doc_id", FILTER_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            ids = pa.compute.fill_null(batch.column("doc_id"), -1).to_numpy()
            batch = batch.filter(pa.array(flagged(shared.value, id_slots(ids, FILTER_BITS))))
            if batch.num_rows:
                texts = list(texts_of(batch, "text"))
                hashes = [_digest(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([h[0] for h in hashes]), pa.array([h[1] for h in hashes]),
                     pa.array(texts, pa.binary())], names=["doc_id", "t1", "t2", "data"])

    return docs.mapInArrow(run, "doc_id long, t1 long, t2 long, data binary")


def _same_doc(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["_doc"]) & (a["t1"] == b["_t1"]) & (a["t2"] == b["_t2"])


def _contexts(docs: DataFrame, mixed: DataFrame, length: int) -> DataFrame:
    """``anchor, c1, c2, m, off, data``: the bytes of each different context, once."""
    one = mixed.groupBy(*KEYS).agg(
        F.sum("times").alias("m"), F.min(F.struct("doc_id", "t1", "t2", "lo", "hi", "off")).alias("p"))
    one = save_table(one.select(*KEYS, "m", "p.*"))
    by_doc = one.groupBy(*[F.col(c).alias(a) for c, a in (("doc_id", "_doc"), ("t1", "_t1"), ("t2", "_t2"))]).agg(
        F.collect_list(F.struct(*KEYS, "m", "lo", "hi", "off")).alias("wanted"))
    texts = _text_of(docs, one)
    joined = texts.join(by_doc, _same_doc(texts, by_doc)).select("data", "wanted", "doc_id", "t1", "t2")
    joined = joined.dropDuplicates(["doc_id", "t1", "t2"]).select("data", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "data"):
            rows = []
            for text, wanted in zip(texts_of(batch, "data"), batch.column("wanted").to_pylist()):
                rows += [(w["anchor"], w["c1"], w["c2"], w["m"], w["off"], text[w["lo"] : w["hi"] + length]) for w in wanted]
            if rows:
                types = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[*KEYS, "m", "off", "data"])

    return joined.mapInArrow(cut, "anchor long, c1 long, c2 long, m long, off int, data binary")


RUNS = "anchor long, c1 long, c2 long, first int, last int"


def _search(rows: DataFrame, length: int) -> DataFrame:
    """Runs of repeated starts ``first`` to ``last`` (from the context's first) in blocks.

    ``rows``: ``g`` (group), ``KEYS``, ``m``, ``shift`` and ``data``, groups below a block. Rows
    of one block lie together; equal data of one group is searched once.
    """
    bytes_, = rows.agg(F.sum(F.octet_length("data"))).first()
    blocks = max(1, -(-(bytes_ or 0) // (BLOCK_BYTES // 2)))

    def run(table: pa.Table) -> pa.Table:
        data = [x.as_py() for x in table["data"]]
        lists = [table[c].to_pylist() for c in (*KEYS, "m", "shift", "g")]
        total: dict[tuple, int] = {}
        for d, m, g in zip(data, lists[3], lists[5]):
            total[g, d] = total.get((g, d), 0) + m
        group_texts: dict[int, list[bytes]] = {}
        for g, d in total:
            group_texts.setdefault(g, []).append(d)
        found: dict[tuple, np.ndarray] = {}

        def solve(part: list[tuple[int, bytes]]) -> None:
            found.update(zip(part, repeated_starts([d for _, d in part], length)))

        part: list[tuple[int, bytes]] = []
        size = 0
        for g, texts in group_texts.items():
            if len(texts) > 1 or total[g, texts[0]] == 1:
                part += [(g, d) for d in texts]
                size += sum(map(len, texts))
            if size > BLOCK_BYTES:
                solve(part)
                part, size = [], 0
        if part:
            solve(part)
        out = []
        for anchor, c1, c2, _, shift, g, d in zip(*lists, data):
            n = len(d) - length + 1
            flags = np.ones(n, bool) if total[g, d] > 1 else found[g, d]
            out += [(anchor, c1, c2, a + shift, b + shift) for a, b in runs_of(flags)]
        columns = list(zip(*out)) or [[]] * 5
        types = [pa.int64()] * 3 + [pa.int32()] * 2
        return pa.table({n: pa.array(c, t) for n, c, t in zip([*KEYS, "first", "last"], columns, types)})

    dealt = rows.withColumn("_b", F.pmod(F.xxhash64("g"), F.lit(blocks)))
    return dealt.groupBy("_b").applyInArrow(lambda t: run(t), RUNS)


def _repeated_runs(contexts: DataFrame, length: int) -> DataFrame:
    """All runs of repeated starts; groups above a block are split by the distance to the anchor.

    Equal strings have the same distance, so a split by ranges of it loses nothing; with a
    range of one the strings themselves are the contexts, and equal ones are counted.
    """
    rows = contexts.select(F.col("anchor").alias("g"), *KEYS, "m", F.lit(0).alias("shift"), "off", "data")
    out = None
    for step in (*STEPS, None):
        sizes = rows.groupBy("g").agg(F.sum(F.octet_length("data")).alias("_size"))
        sizes = save_table(sizes.filter(F.col("_size") > BLOCK_BYTES).select(F.col("g").alias("_g")))
        some = sizes.limit(1).count()
        small = rows.join(sizes, rows["g"] == sizes["_g"], "left_anti") if some else rows
        if step is not None or not some:
            found = _search(small.drop("off"), length)
            out = found if out is None else out.unionByName(found)
        if not some:
            return out
        large = rows.join(sizes, rows["g"] == sizes["_g"]).drop("_g")
        if step is None:  # every row is one string now
            counted = rows.groupBy("g", F.xxhash64("data").alias("_h"), F.xxhash64(F.lit(1), "data").alias("_k"))
            counted = save_table(counted.agg(F.sum("m").alias("_m")).filter("_m > 1").withColumnRenamed("g", "_g"))
            hit = rows.join(counted, (rows["g"] == counted["_g"]) & (F.xxhash64("data") == F.col("_h"))
                            & (F.xxhash64(F.lit(1), "data") == F.col("_k")), "left_semi")
            return out.unionByName(hit.select(*KEYS, F.col("shift").alias("first"), F.col("shift").alias("last")))
        rows = save_table(large.mapInArrow(
            _splitter(step, length), "g long, anchor long, c1 long, c2 long, m long, shift int, off int, data binary"))
    return out


def _splitter(step: int, length: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "data", 1 << 20):
            rows = []
            for r in batch.select([*KEYS, "m", "shift", "off", "data"]).to_pylist():
                n = len(r["data"]) - length + 1
                distance = r["off"] - np.arange(n)  # of each start to the anchor
                part = distance // step
                new = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1, [n]]).tolist()
                for a, b in zip(new, new[1:]):
                    key = (r["anchor"] ^ (int(part[a]) + 1) * 0x1E3779B97F4A7C15) & ((1 << 63) - 1)
                    rows.append((key, r["anchor"], r["c1"], r["c2"], r["m"], r["shift"] + a, r["off"] - a,
                                 r["data"][a : b - 1 + length]))
            types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
            names = ["g", *KEYS, "m", "shift", "off", "data"]
            for i in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 2000]), types)], names=names)

    return split


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, t1, t2, spans``: the starts of repeated strings, as runs ``a`` to ``b``.

    ``docs`` has ``doc_id`` and ``text``; a row for each different document with such a start.
    """
    places = save_table(find_places(docs, length))
    context = F.struct("c1", "c2")
    groups = places.groupBy("anchor").agg(
        F.sum("times").alias("_n"), F.min(context).alias("_low"), F.max(context).alias("_high"))
    groups = groups.filter("_n > 1").select(F.col("anchor").alias("_anchor"), (F.col("_low") != F.col("_high")).alias("mixed"))
    groups = save_table(groups)
    met = save_table(places.join(groups, places["anchor"] == groups["_anchor"]).drop("_anchor"))
    whole = met.filter("NOT mixed").select("doc_id", "t1", "t2", F.col("lo").alias("a"), (F.col("hi") + F.col("times") - 1).alias("b"))
    mixed = met.filter("mixed")
    contexts = save_table(_contexts(docs, mixed, length))
    runs = save_table(_repeated_runs(contexts, length))
    runs = runs.select(F.col("anchor").alias("_a"), F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), "first", "last")
    own = mixed.join(runs, (mixed["anchor"] == runs["_a"]) & (mixed["c1"] == runs["_c1"]) & (mixed["c2"] == runs["_c2"]))
    own = own.select("doc_id", "t1", "t2", (F.col("lo") + F.col("first")).alias("a"), (F.col("lo") + F.col("last") + F.col("times") - 1).alias("b"))
    return whole.unionByName(own).groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))


def removed_spans(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Bytes covered by strings that start in the sorted runs, as maximal ``[first, end)``."""
    out: list[list[int]] = []
    for a, b in starts:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [tuple(x) for x in out]


def remove_repeats(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True,
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` and, if asked, ``kept``, per row.

    Removed is each byte covered by a string of ``length`` bytes that also starts anywhere
    else, in another document or the same; overlaps count, and strings are judged on the input.
    ``spans`` are the maximal removed runs, end exclusive, ``kept`` the bytes that remain. A
    null text is empty. Every row is a document of its own, also one that repeats another.
    Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = save_table(repeated_spans(docs, length))
    spans = spans.select(F.col("doc_id").alias("_doc"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "spans")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = list(texts_of(batch, "text"))
            hashes = [_digest(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([h[0] for h in hashes]), pa.array([h[1] for h in hashes]),
                 pa.array(texts, pa.binary())], names=["doc_id", "t1", "t2", "data"])

    texts = docs.mapInArrow(hashed, "doc_id long, t1 long, t2 long, data binary")
    joined = texts.join(spans, _same_doc(texts, spans), "left").select("doc_id", "data", "spans")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        types = [pa.int64()] * 4 + [pa.string(), span]
        if with_text:
            names, types = [*names, "kept"], [*types, pa.binary()]
        for batch in small_batches(batches, "data"):
            rows = []
            for doc, text, starts in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "data"), batch.column("spans").to_pylist()):
                gone = removed_spans([(s["a"], s["b"]) for s in starts or []], length)
                edges = [0, *(x for s in gone for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = (doc, len(text), len(text) - len(kept), len(gone), sha256(kept).hexdigest(),
                       [{"first": a, "end": b} for a, b in gone])
                rows.append((*row, kept) if with_text else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,end:long>>"
    return joined.mapInArrow(apply, schema + (", kept binary" if with_text else ""))
