"""Groups of documents whose sets of word n-grams have a high Jaccard similarity.

The join is size-aware. Elements have one global order, rare before common, from a count over
all documents. A *small* set gives all pairs of its first elements as keys: two similar small
sets share such a pair. A *large* set is entered under each of its first elements and the
lists of these are scanned; small sets near the boundary are entered there as well, for the
pairs across it. The boundary is the size at which both ways cost the same in all.

Only connectedness is asked for, so a list that very many documents share is first compared
with one of its documents, and what is left then, the pairs in such lists that lie in different
groups, is compared in blocks. No pair that could be similar is left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import bit_field, flagged, give_back, id_slots, small_batches, texts_of
from repoatlas.llm.components import connected_components
from repoatlas.sources.scratch import drop_folder, save_table, scratch_folder

WORDS, PERCENT = 4, 85
#: Counters of the element frequencies, and of them in one row.
SKETCH_BITS, SKETCH_ROW = 21, 1 << 15
#: Lists up to this length give all their pairs at once.
SHORT = 24
#: Documents of one side of a block of a longer list.
LOT = 512
#: Rows of a list of a very common element that are kept together; members of one comparison.
LIST_ROWS, MEMBERS = 2048, 256
#: A class of equal documents is skipped early if it is above this share of all documents.
CLASSES = 4096
#: Bits of the filter that keeps documents without candidates out of the comparison.
FILTER_BITS = 23
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_STEP = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 250_000:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            self[word] = value
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def ngram_set(text: bytes, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; A-Z is lower-cased.

    A shorter text is one n-gram of all its words; without words the set is empty.
    """
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, parts), np.uint64, len(parts))
    n = min(words, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = total * _STEP + h[i : len(h) - n + 1 + i]
    return np.unique(mixed(total))


def common_needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Least size of the intersection of a set of size ``n`` with any similar set."""
    return -(-percent * n // 100)


def similar(inter, n_a, n_b, percent: int):
    return 100 * inter >= percent * (n_a + n_b - inter)


@dataclass(frozen=True)
class Order:
    """Global order of the elements, and the boundary between small and large sets."""

    counts: np.ndarray
    boundary: int
    common: float
    percent: int

    def prefix(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first elements in the order, one more than a scan needs, and their counts."""
        n = len(elements)
        take = min(n, n - int(common_needed(np.int64(n), self.percent)) + 2)
        count = self.counts[(elements & np.uint64(len(self.counts) - 1)).astype(np.int64)]
        order = np.lexsort((elements, count))[:take]
        return elements[order], count[order]

    def keys(self, elements: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of a set, the place of the (last) element of each, and the lots of its list."""
        n = len(elements)
        first, count = self.prefix(elements)
        one = n - int(common_needed(np.int64(n), self.percent)) + 1
        key, place, lots = [], [], []
        if n > self.boundary or 100 * n > self.percent * self.boundary:
            key.append(mixed(first[:one]))
            place.append(np.arange(len(first[:one])))
            lots.append(np.where(count[:one] > self.common, -(-count[:one] // LIST_ROWS), 1))
        if n <= self.boundary and len(first) > 1:
            i, j = np.triu_indices(len(first), 1)
            key.append(mixed(first[i] * _MIX[0] + first[j]))
            place.append(i)
            least = np.minimum(count[i], count[j])
            lots.append(np.where(least > self.common, -(-least // LIST_ROWS), 1))
        if not key:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(key).view(np.int64), np.concatenate(place), np.concatenate(lots)


def best_boundary(sizes: np.ndarray, documents: np.ndarray, list_length: float, percent: int) -> int:
    """The size up to which pairs of elements are cheaper than list scans, over all documents."""
    first = sizes - common_needed(sizes, percent) + 1
    pairs = documents * first * (first + 1) / 2
    scans = documents * first * (1 + list_length)
    total = np.concatenate([[0], np.cumsum(pairs)]) + np.concatenate([np.cumsum(scans[::-1])[::-1], [0]])
    best = int(total.argmin())
    return int(sizes[best - 1]) if best else 0


def _profile(docs: DataFrame, words: int, folder: str) -> tuple[DataFrame, np.ndarray]:
    """``doc_id, n, f1, f2`` (size and hash of the set) and the element counts, in one pass."""
    slots = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        give_back()
        hashes, counts = WordHashes(), np.zeros(slots, np.uint32)
        used = False
        for batch in small_batches(batches, "text"):
            n, f1, f2 = [], [], []
            for text in texts_of(batch, "text"):
                elements = ngram_set(text, hashes, words)
                counts[(elements & np.uint64(slots - 1)).astype(np.int64)] += 1
                digest = np.frombuffer(xxhash.xxh3_128_digest(elements.tobytes()), "<i8")
                n.append(len(elements))
                f1.append(digest[0])
                f2.append(digest[1])
            used = True
            none = pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), none],
                names=["doc_id", "n", "f1", "f2", "counts"])
        if used:
            lot = TaskContext.get().partitionId() // 256
            for row in range(0, slots, SKETCH_ROW):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None], pa.int64()), pa.array([-1], pa.int64()), pa.array([row], pa.int64()),
                     pa.array([lot], pa.int64()), pa.array([counts[row : row + SKETCH_ROW].tobytes()], pa.binary())],
                    names=["doc_id", "n", "f1", "f2", "counts"])
        hashes.clear()
        del counts
        give_back()

    both = docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, counts binary")
    both = save_table(both, f"{folder}/profile")

    def add(kind: str):
        def inner(table: pa.Table) -> pa.Table:
            total = np.zeros(SKETCH_ROW, "<u8")
            for value in table["counts"]:
                total += np.frombuffer(value.as_py(), kind)
            return pa.table({"row": pa.array([table["row"][0].as_py()], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})
        return inner

    rows = both.filter("n < 0").select(F.col("f1").alias("row"), F.col("f2").alias("lot"), "counts")
    part = rows.groupBy("row", "lot").applyInArrow(add("<u4"), "row long, counts binary")
    total = np.zeros(slots, np.int64)
    for row, data in part.groupBy("row").applyInArrow(add("<u8"), "row long, counts binary").collect():
        total[row : row + SKETCH_ROW] = np.frombuffer(data, "<u8")
    return both.filter("n >= 0").drop("counts"), total


def _lists(table_rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Sorted rows, cut so that no list is spread over two parts."""
    held: list[pa.RecordBatch] = []
    names = ("key", "lot", "n", "doc", "place", "lots")
    for batch in table_rows:
        if not batch.num_rows:
            continue
        key, lot = batch.column("key").to_numpy(), batch.column("lot").to_numpy()
        same = (key == key[-1]) & (lot == lot[-1])
        first = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if held:
            k, s = held[-1].column("key")[-1].as_py(), held[-1].column("lot")[-1].as_py()
            if first == 0 and (key[0], lot[0]) == (k, s):
                held.append(batch)
                continue
        held.append(batch.slice(0, first))
        whole = pa.Table.from_batches(held)
        if whole.num_rows:
            yield tuple(whole[c].to_numpy() for c in names)
        held = [batch.slice(first)]
    if held:
        whole = pa.Table.from_batches(held)
        yield tuple(whole[c].to_numpy() for c in names)


def list_pairs(key, lot, n, doc, place, lots, boundary: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (row numbers) of sorted lists, and which rows belong to long lists.

    Pairs whose sizes or places in the order rule out a similarity are left out.
    """
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (lot[1:] != lot[:-1])])
    start = np.nonzero(new)[0]
    length = np.diff(np.append(start, len(key)))
    left, right = [], []
    for size in np.unique(length[(length > 1) & (length <= SHORT)]).tolist():
        at = start[length == size]
        i, j = np.triu_indices(size, 1)
        left.append((at[:, None] + i[None]).ravel())
        right.append((at[:, None] + j[None]).ravel())
    for at, size in zip(start[length > SHORT].tolist(), length[length > SHORT].tolist()):
        first = at
        while first < at + size:  # the smallest set, then the first that is too large for it
            last = at + int(np.searchsorted(n[at : at + size], 100 * n[first] // percent, "right"))
            left.append(np.full(last - first - 1, first))
            right.append(np.arange(first + 1, last))
            first = max(last, first + 1)
    long = np.repeat((length > SHORT), length) | (lots > 1)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), long
    a, b = np.concatenate(left), np.concatenate(right)
    return (*possible(a, b, n, doc, place, percent), long)


def possible(a, b, n, doc, place, percent: int) -> tuple[np.ndarray, np.ndarray]:
    most = np.minimum(n[a] - place[a], n[b] - place[b])
    ok = (doc[a] != doc[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
    ok &= similar(most, n[a], n[b], percent)
    return a[ok], b[ok]


class Nodes:
    """What stands for a row in the join: its id, or a number of its own where ids repeat.

    ``field`` flags the slots of ids that rows with different texts share. Such a row, and any
    other whose id has the same slot, is numbered by its id and its set, from 2**62 on.
    """

    def __init__(self, field: np.ndarray):
        self.field, self.any = field, bool(field.any())

    def own(self, ids: np.ndarray) -> np.ndarray:
        """Which ids have numbers of their own."""
        return flagged(self.field, id_slots(ids, FILTER_BITS)) if self.any else np.zeros(len(ids), bool)

    @staticmethod
    def number(doc: int, digest: tuple[int, int]) -> int:
        import xxhash

        return 1 << 62 | xxhash.xxh3_64_intdigest(struct.pack("<3q", doc, *digest)) >> 2


def set_digest(elements: np.ndarray) -> tuple[int, int]:
    import xxhash

    return tuple(np.frombuffer(xxhash.xxh3_128_digest(elements.tobytes()), "<i8").tolist())


def _texts(wanted: DataFrame, docs: DataFrame, nodes: Broadcast, words: int) -> DataFrame:
    """``doc, data`` (doc a node, data its text) of the documents in ``wanted``, and of a few others."""
    spark = docs.sparkSession
    field = spark.sparkContext.broadcast(bit_field(wanted, "doc", FILTER_BITS))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_batches(batches, "text"):
            ids = batch.column("doc_id").to_numpy()
            numbered = nodes.value.own(ids)
            keep = numbered | flagged(field.value, id_slots(ids, FILTER_BITS))
            some = batch.filter(pa.array(keep))
            found, data = [], []
            for doc, own, text in zip(ids[keep].tolist(), numbered[keep].tolist(), texts_of(some, "text")):
                if not text.strip():
                    continue  # of a row that is in no list; its id may have another
                if own:
                    doc = Nodes.number(doc, set_digest(ngram_set(text, hashes, words)))
                    if not flagged(field.value, id_slots(np.array([doc]), FILTER_BITS))[0]:
                        continue
                found.append(doc)
                data.append(text)
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int64()), pa.array(data, pa.binary())], names=["doc", "data"])
        hashes.clear()
        give_back()

    found = docs.filter("doc_id IS NOT NULL").mapInArrow(pick, "doc long, data binary")
    return found.dropDuplicates(["doc"])  # equal rows; the join that follows needs no other shuffle


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """``doc, elements`` of ``doc, data``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_batches(batches, "data"):
            data = [ngram_set(t, hashes, words).tobytes() for t in texts_of(batch, "data")]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(data, pa.binary())], names=["doc", "elements"])
        hashes.clear()
        give_back()

    return texts.mapInArrow(sets, "doc long, elements binary")


def _compared(pairs: DataFrame, docs: DataFrame, nodes: Broadcast, words: int, percent: int, folder: str) -> DataFrame:
    """The pairs ``a, b`` that are similar, by their whole sets.

    The pairs of a document ``a`` are dealt out in lots. ``routes`` says where a text goes: as
    the other side ``b`` to the lot of its pair, or as ``a`` to all of its lots. A text moves
    once to its routes and once along them, and is not written. Its set, which is larger and
    cannot be compressed, is made where it is compared.
    """
    spark = docs.sparkSession
    pairs = save_table(pairs, f"{folder}/pairs")
    lots = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("_lots"))
    lots = save_table(lots, f"{folder}/lots")
    members = pairs.join(lots, "a").select(
        F.col("b").alias("to"), "a", F.pmod(F.xxhash64("b"), F.col("_lots")).cast("int").alias("lot"),
        F.lit(False).alias("leads"))
    leaders = lots.select(
        F.col("a").alias("to"), "a", F.explode(F.sequence(F.lit(0), F.col("_lots") - 1)).alias("lot"),
        F.lit(True).alias("leads"))
    routes = members.unionByName(leaders)
    found = _texts(pairs.select(F.explode(F.array("a", "b")).alias("doc")), docs, nodes, words)
    sent = found.join(routes, found["doc"] == routes["to"]).select("a", "lot", "leads", "doc", "data")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        led, own = None, None
        for batch in small_batches(batches, "data"):
            links = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "lot", "leads", "doc")))
            for (a, lot, leads, doc), text in zip(rows, texts_of(batch, "data")):
                if not leads and led != (a, lot):
                    continue
                elements = ngram_set(text, hashes, words)
                if leads:  # the first of its lot
                    led, own = (a, lot), elements
                    continue
                at = np.searchsorted(own, elements)
                both = int((own[np.minimum(at, len(own) - 1)] == elements).sum()) if len(own) else 0
                if similar(both, len(own), len(elements), percent):
                    links.append((a, doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])
        hashes.clear()
        give_back()

    sorted_ = sent.repartition("a", "lot").sortWithinPartitions("a", "lot", F.desc("leads"))
    out = save_table(sorted_.mapInArrow(check, "a long, b long"), f"{folder}/links")
    for name in ("pairs", "lots"):
        drop_folder(spark, f"{folder}/{name}")
    return out


def similar_groups(
    docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    Two documents link when ``100 * intersection >= percent * union`` of their n-gram sets;
    the component is the smallest id reachable by links. Null, empty and blank texts have no
    n-grams and link with nothing; so do rows with a null id. Equal rows are one document.
    Rows of one id with different texts count as linked, and each of them links with what its
    own text is similar to. Other columns are ignored.
    """
    spark = docs.sparkSession
    folder = scratch_folder(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, counts = _profile(docs, words, folder)
    full = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = save_table(full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")), f"{folder}/classes")
    total, most_n = classes.agg(F.sum("m"), F.max("n")).first()
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2")
    if not total:
        return out.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # sizes up to 256 one by one, larger ones by steps of an eighth: a few hundred rows at most
    step = F.when(F.col("n") <= 256, F.col("n")).otherwise(F.floor(F.pow(F.lit(2.0), F.floor(F.log2("n") * 8) / 8)).cast("long"))
    by_size = sorted((r[0], r[1]) for r in classes.groupBy(step.alias("s")).count().collect())
    sizes, documents = (np.array(x, np.int64) for x in zip(*by_size))
    load = counts.sum() / len(counts)
    ordered = np.sort(counts)
    typical = ordered[np.searchsorted(np.cumsum(ordered), counts.sum() / 2)]
    boundary = best_boundary(sizes, documents, max(1.0, typical - load), percent)
    order = spark.sparkContext.broadcast(Order(counts, boundary, max(LIST_ROWS, 16 * load), percent))
    # ids that rows with different sets share
    ends = [f(c).alias(f"{n}{c}") for c in ("f1", "f2") for n, f in (("low", F.min), ("high", F.max))]
    shared_ids = full.groupBy("doc_id").agg(*ends).filter("lowf1 <> highf1 OR lowf2 <> highf2")
    nodes = spark.sparkContext.broadcast(Nodes(bit_field(shared_ids, "doc_id", FILTER_BITS)))
    large = classes.filter((F.col("m") > 16) & (F.col("m") > total / CLASSES))
    skip = spark.sparkContext.broadcast({(r.f1, r.f2): r.rep for r in large.collect()})  # at most CLASSES

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in small_batches(batches, "text", 1 << 20):
            parts = []
            ids = batch.column("doc_id").to_numpy()
            for doc, own, text in zip(ids.tolist(), nodes.value.own(ids).tolist(), texts_of(batch, "text")):
                elements = ngram_set(text, hashes, words)
                if not len(elements):
                    continue
                digest = set_digest(elements)
                if skip.value.get(digest, doc) != doc:
                    continue
                if own:
                    doc = Nodes.number(doc, digest)
                key, place, lots = order.value.keys(elements)
                lot = ((doc * 0x9E3779B1 & 0xFFFFFFFFFFFFFFFF) >> 7) % lots
                parts.append((key, lot, np.full(len(key), len(elements)), np.full(len(key), doc), place, lots))
            if parts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(t)) for c, t in zip(zip(*parts), ("i8", "i4", "i4", "i8", "i4", "i4"))],
                    names=["key", "lot", "n", "doc", "place", "lots"])
        hashes.clear()
        give_back()

    entries = docs.filter("doc_id IS NOT NULL").mapInArrow(enter, "key long, lot int, n int, doc long, place int, lots int")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, lot, n, doc, place, lots in _lists(batches):
            a, b, long = list_pairs(key, lot, n, doc, place, lots, boundary, percent)
            low, high = np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])
            if len(a):
                both = np.unique(np.stack([low, high], axis=1), axis=0)
                none = pa.nulls(len(both), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), none, none, none], names=["a", "b", "key", "n", "place"])
            if long.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc[long]), pa.nulls(int(long.sum()), pa.int64()), pa.array(key[long]),
                     pa.array(n[long].astype("i8")), pa.array(place[long].astype("i8"))],
                    names=["a", "b", "key", "n", "place"])

    sorted_ = entries.repartition("key", "lot").sortWithinPartitions("key", "lot", "n", "doc")
    met = save_table(sorted_.mapInArrow(meet, "a long, b long, key long, n long, place long"), f"{folder}/met")
    to_rep = full.join(classes.select("n", "f1", "f2", "rep"), ["n", "f1", "f2"]).filter("doc_id <> rep")
    copies = to_rep.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    if nodes.value.any:
        copies = copies.unionByName(_numbered(full, nodes).distinct())
    copies = save_table(copies, f"{folder}/copies")

    # first a single partner for each document, then whatever still lies in two groups
    pairs = met.filter("b IS NOT NULL").select("a", "b")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = copies.unionByName(_compared(first, docs, nodes, words, percent, f"{folder}/1"))
    roots = connected_components(links)
    again = save_table(_apart(pairs.distinct(), roots), f"{folder}/again")
    if again.count():
        links = links.unionByName(_compared(again, docs, nodes, words, percent, f"{folder}/2"))
        roots = connected_components(links)
    # the lists above SHORT that still hold two groups, each pair in one of its lists
    long = met.filter("b IS NULL").select(F.col("a").alias("doc"), "key", "n")
    blocks = save_table(_list_blocks(_in_two_groups(long, roots, folder), percent), f"{folder}/blocks")
    if blocks.limit(1).count():
        links = links.unionByName(_compared_blocks(blocks, docs, nodes, words, percent, f"{folder}/3"))
        roots = connected_components(links)
    if nodes.value.any:  # the smallest id itself, where ids are above the numbers
        known = save_table(out.select("doc_id").distinct().join(roots, F.col("doc_id") == F.col("node")), f"{folder}/known")
        least = known.groupBy("root").agg(F.min("doc_id").alias("_least"))
        roots = known.join(least, "root").select("node", F.col("_least").alias("root"))
    joined = out.join(roots, out["doc_id"] == roots["node"], "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def _numbered(full: DataFrame, nodes: Broadcast) -> DataFrame:
    """Links ``a, b`` of ids with the numbers of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = nodes.value.own(batch.column("doc_id").to_numpy())
            rows = list(zip(*(c.to_pylist() for c in batch.filter(pa.array(own)).columns)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([Nodes.number(r[0], r[1:]) for r in rows], pa.int64())],
                names=["a", "b"])

    return full.select("doc_id", "f1", "f2").mapInArrow(run, "a long, b long")


def _labelled(df: DataFrame, doc: str, roots: DataFrame, label: str) -> DataFrame:
    own = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return df.join(own, df[doc] == own["_node"], "left").withColumn(label, F.coalesce("_root", doc)).drop("_node", "_root")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends are in different groups so far."""
    both = _labelled(_labelled(pairs, "a", roots, "_la"), "b", roots, "_lb")
    return both.filter("_la <> _lb").select("a", "b")


def _in_two_groups(rows: DataFrame, roots: DataFrame, folder: str) -> DataFrame:
    """Rows, with their label, of the lists that hold more than one group."""
    own = save_table(_labelled(rows, "doc", roots, "label"), f"{folder}/long")
    lists = own.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low <> _high")
    lists = save_table(lists.select("key"), f"{folder}/lists")
    return save_table(own.join(lists, "key", "left_semi"), f"{folder}/some")


def _list_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """``h1, l1, h2, l2, doc, partners``: what is to be compared in which block.

    Rows of a list are dealt over lots of ``LOT`` documents, and every two lots are looked at
    together. A pair is left to the list with the smallest key that both documents are in.
    ``partners`` are documents of other groups whose sizes allow a similarity, each pair once.
    Documents have as home the smallest document in any of their lists, which nearly alike
    ones share. Pairs are compared in blocks by home, so that a set travels to few of them.
    """
    lot = F.pmod(F.xxhash64("doc"), F.col("_lots")).cast("int")
    lists = rows.groupBy("key").agg(F.ceil(F.count("*") / LOT).cast("int").alias("_lots"), F.min("doc").alias("lead"))
    lists = save_table(lists)
    sizes = lists.select("key", "_lots")
    homes = rows.join(lists.select("key", "lead"), "key").groupBy("doc").agg(
        F.collect_set("key").alias("keys"), F.min("lead").alias("home"))
    homes = save_table(homes)
    full = homes.groupBy("home").agg(F.ceil(F.count("*") / LOT).cast("int").alias("_lots"))
    every = homes.join(save_table(full), "home").select("doc", "keys", "home", lot.alias("home_lot"))
    other = F.explode(F.sequence(F.lit(0), F.col("_lots") - 1))
    dealt = rows.join(every, "doc").join(sizes, "key").withColumn("_u", lot).withColumn("_v", other)
    dealt = dealt.select(
        "key", F.least("_u", "_v").alias("s"), F.greatest("_u", "_v").alias("t"), F.col("_u").alias("lot"),
        "doc", "n", "label", "keys", "home", "home_lot")

    def pick(table: pa.Table) -> pa.Table:
        key, s, t = (table[c][0].as_py() for c in ("key", "s", "t"))
        doc, n, label, lot = (table[c].to_numpy() for c in ("doc", "n", "label", "lot"))
        known = table["keys"].combine_chunks()
        owner = np.repeat(np.arange(len(doc)), np.asarray(pa.compute.list_value_length(known)))
        flat = known.flatten().to_numpy()
        smaller = flat < key
        ids, column = np.unique(flat[smaller], return_inverse=True)
        held = np.zeros((len(doc), len(ids)), np.float32)
        held[owner[smaller], column] = 1
        open_ = (held @ held.T == 0) & (label[:, None] != label[None]) & (doc[:, None] < doc[None])
        if s != t:
            open_ &= lot[:, None] != lot[None]
        i, j = np.nonzero(open_)
        i, j = possible(i, j, n, doc, np.zeros_like(n), percent)  # not their first common element
        places = list(zip(table["home"].to_pylist(), table["home_lot"].to_pylist()))
        number = {p: x for x, p in enumerate(sorted(set(places)))}
        place = np.array([number[p] for p in places], np.int64)
        block = np.minimum(place[i], place[j]) * len(number) + np.maximum(place[i], place[j])
        known_places = sorted(number)
        out: list[tuple] = []
        for b in np.unique(block).tolist():
            mine = block == b
            own, other = i[mine], j[mine]
            used = np.unique(np.concatenate([own, other]))
            order = np.argsort(own, kind="stable")
            starts, ends = (np.searchsorted(own[order], used, side) for side in ("left", "right"))
            low, high = known_places[b // len(number)], known_places[b % len(number)]
            out += [(*low, *high, int(doc[u]), doc[other[order[x:y]]]) for u, x, y in zip(used, starts, ends)]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        columns = list(zip(*out)) or [[]] * 6
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("h1", "l1", "h2", "l2", "doc", "partners"), columns, types)})

    found = dealt.groupBy("key", "s", "t").applyInArrow(
        pick, "h1 long, l1 int, h2 long, l2 int, doc long, partners array<long>")
    return found.groupBy("h1", "l1", "h2", "l2", "doc").agg(F.flatten(F.collect_list("partners")).alias("partners"))


def _compared_blocks(blocks: DataFrame, docs: DataFrame, nodes: Broadcast, words: int, percent: int, folder: str) -> DataFrame:
    """Links of the blocks, as few as connect the same documents."""
    found = _sets(_texts(blocks.select("doc"), docs, nodes, words), words)
    joined = blocks.join(found.withColumnRenamed("doc", "_doc"), F.col("doc") == F.col("_doc")).drop("_doc")

    def check(table: pa.Table) -> pa.Table:
        doc = table["doc"].to_pylist()
        sets = {d: np.frombuffer(e.as_py(), np.uint64) for d, e in zip(doc, table["elements"])}
        root = {d: d for d in doc}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        links = []
        for d, partners in zip(doc, table["partners"].to_pylist()):
            own = sets[d]
            for p in partners:
                a, b = find(d), find(p)
                if a != b and p in sets:
                    at = np.searchsorted(own, sets[p])
                    both = int((own[np.minimum(at, len(own) - 1)] == sets[p]).sum())
                    if similar(both, len(own), len(sets[p]), percent):
                        root[max(a, b)] = min(a, b)
                        links.append((d, p))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return save_table(joined.groupBy("h1", "l1", "h2", "l2").applyInArrow(check, "a long, b long"), f"{folder}/links")
