"""Ranked lexical search by pipelined term partitioning, with integer scores.

Documents are numbered within shards, and every shard has an inverted list per term of the
queries. Terms belong to owners, the rarest to the first. Queries travel in bundles: a bundle of
a shard goes through the owners in turn, and each stage meets it with its owner's lists of that
shard by a cogroup and adds the contributions of its terms to the accumulators, which are sparse
arrays of document numbers and scores. After the last owner the best documents of every query
are chosen in the shard and then over all shards.

A stage may drop an accumulator only if it cannot be among the best any more: contributions are
never negative, so the k-th score of a shard so far is a lower bound of the query's last place,
and a term's greatest contribution is known. The result is the same as without dropping.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoatlas.llm.common import small_batches, texts_of
from repoatlas.sources.scratch import save_table

#: The white list of a term's bytes; all others separate terms, A-Z become a-z.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
TERM_BYTES = bytes.maketrans(
    SEPARATORS + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz"
)
#: Documents and postings at which a shard is closed.
SHARD_DOCS, SHARD_POSTINGS = 1 << 14, 1 << 21
#: Queries of a bundle, on average.
BUNDLE = 128
#: An owner has the terms that at most this share of all documents hold; the last has the rest.
OWNER_SHARES = (1 / 256, 1 / 16, 1 / 4)
#: Bits of the filter that keeps terms of no query out of the lists; it is the same size for
#: any number of queries, and what it lets through is filtered again by the terms themselves.
FILTER_BITS = 1 << 22
#: Bytes of a text that are cut into terms at once.
PART = 1 << 20
#: Lots of shards among which the best of a query are chosen before the last choice.
SELECT_LOTS = 256
#: Shards of one group of a join with the queries.
SHARDS_TOGETHER = 64
LISTS = "shard long, term string, n_docs int, n_terms long, docs binary, counts binary, lengths binary, ids array<long>"
BUNDLES = "shard long, bundle int, query long, terms array<struct<term:string,owner:int,weight:long,most:long>>, places binary, scores binary"

TERM = pa.struct([("term", pa.string()), ("owner", pa.int32()), ("weight", pa.int64()), ("most", pa.int64())])
BUNDLE_TYPES = pa.schema([
    ("shard", pa.int64()), ("bundle", pa.int32()), ("query", pa.int64()), ("terms", pa.list_(TERM)),
    ("places", pa.binary()), ("scores", pa.binary()),
])


def term_lots(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, lot by lot, so that a very long one is never held as words at once."""
    at = 0
    while at < len(text):
        end = min(at + PART, len(text))
        lot = text[at:end].translate(TERM_BYTES)
        if end < len(text):
            cut = lot.rfind(b" ")
            if cut < 0:  # a term longer than the lot
                rest = text[end:].translate(TERM_BYTES).partition(b" ")[0]
                lot += rest
                end += len(rest)
            else:
                lot, end = lot[:cut], at + cut + 1
        at = end
        yield lot.split()


def term_counts(text: bytes) -> Counter:
    counts: Counter = Counter()
    for lot in term_lots(text):
        counts.update(lot)
    return counts


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct ``query, term``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            ids, terms = [], []
            for query, text in zip(batch.column("query").to_pylist(), texts_of(batch, "text")):
                own = [t.decode() for t in term_counts(text)]
                ids += [query] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(terms, pa.string())], names=["query", "term"]
            )

    source = queries.select(F.col(id_col).cast("long").alias("query"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "query long, term string").distinct()


def term_filter(terms: DataFrame) -> bytes:
    """A bit field of fixed size in which the hash of every term is set."""
    slot = (F.crc32(F.col("term").cast("binary")) % FILTER_BITS).alias("slot")
    bits = F.bit_or(F.expr("shiftleft(1L, CAST(slot % 64 AS INT))"))
    words = terms.select(slot).groupBy(F.floor(F.col("slot") / 64).alias("at")).agg(bits.alias("bits"))
    field = np.zeros(FILTER_BITS // 64, "<i8")
    for at, bits in words.collect():
        field[at] = bits
    return field.tobytes()


class Shard:
    """Documents of one task until they are enough: their lengths, and per term where it occurs."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.lists: dict[bytes, tuple[list[int], list[int]]] = {}
        self.postings = 0

    def add(self, doc_id: int | None, n: int, counts: Iterable[tuple[bytes, int]]) -> None:
        place = len(self.ids)
        self.ids.append(doc_id)
        self.lengths.append(n)
        for term, count in counts:
            docs, times = self.lists.setdefault(term, ([], []))
            docs.append(place)
            times.append(count)
            self.postings += 1

    def full(self, docs: int) -> bool:
        return len(self.ids) >= docs or self.postings >= SHARD_POSTINGS

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        n = len(self.ids)
        lengths = np.array(self.lengths, "<i8")
        rows = [(number, None, n, int(lengths.sum()), None, None, lengths.tobytes(), self.ids)]
        for term, (docs, times) in self.lists.items():
            docs, times = np.array(docs, "<u2").tobytes(), np.array(times, "<u4").tobytes()
            rows.append((number, term.decode(), len(docs) // 2, None, docs, times, None, None))
        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.list_(pa.int64())]
        names = [x.split()[0] for x in LISTS.split(", ")]
        for i in range(0, len(rows), 4096):
            columns = zip(*rows[i : i + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def invert(
    docs: DataFrame, keep: bytes, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """The shards of all documents with at least one term.

    Per shard a row without term, which has the documents' ids and lengths, and a row per term
    that ``keep`` lets through, with places and counts of its documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        shard, crc = Shard(), zlib.crc32
        field, size = keep, FILTER_BITS
        for batch in small_batches(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text")):
                counts = term_counts(text)
                if not counts:
                    continue
                own = []
                for term, count in counts.items():
                    slot = crc(term) % size
                    if field[slot >> 3] >> (slot & 7) & 1:
                        own.append((term, count))
                shard.add(doc, counts.total(), own)
                if shard.full(shard_docs):
                    yield from shard.batches(number)
                    shard, number = Shard(), number + 1
        if shard.ids:
            yield from shard.batches(number)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, LISTS)


def base_contributions(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """A document's contribution for weight 1: of its count of the term and its length factor."""
    return (10**9 * counts) // (1000 * counts + 20 * factors)


def length_factors(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return np.array([50 + 50 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)


def add_contributions(terms: list, lists: dict, factors: np.ndarray, owner: int, scores: np.ndarray) -> None:
    """Add what the owner's terms of a query give; ``lists`` keeps base values once computed."""
    for t in terms:
        if t["owner"] == owner and (own := lists.get(t["term"])):
            if len(own) == 2:
                places, counts = own
                own = (places, counts, base_contributions(counts, factors[places]))
                lists[t["term"]] = own
            scores[own[0]] += t["weight"] * own[2]


def hopeful(scores: np.ndarray, k: int, to_come: int) -> np.ndarray:
    """Places of the accumulators that may still be among the best ``k`` of all documents."""
    held = np.flatnonzero(scores)
    if len(held) > k:
        last = int(np.partition(scores[held], len(held) - k)[len(held) - k])
        held = held[scores[held] + to_come >= last]
    return held


def shard_lists(table: pa.Table) -> tuple[np.ndarray, pa.Array, dict[str, tuple[np.ndarray, ...]]]:
    """Lengths and ids of a shard's documents, and its lists by term."""
    lengths, ids, lists = None, None, {}
    columns = (table.column(c) for c in ("term", "docs", "counts", "lengths", "ids"))
    for term, docs, counts, own_lengths, own_ids in zip(*columns):
        if term.is_valid:
            lists[term.as_py()] = (
                np.frombuffer(docs.as_buffer(), "<u2"), np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64),
            )
        else:
            lengths, ids = np.frombuffer(own_lengths.as_buffer(), "<i8"), own_ids.values
    return lengths, ids, lists


def stage(bundles: DataFrame, lists: DataFrame, owner: int, last: bool, k: int, n_docs: int, n_terms: int) -> DataFrame:
    """Send all bundles through one owner; after the last owner, the best ``k`` of each shard."""
    result = pa.schema([(c, pa.int64()) for c in ("query", "doc_id", "score", "shard")])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        lengths, ids, found = shard_lists(right)
        factors = length_factors(lengths, n_docs, n_terms)
        out = []
        for row in left.to_pylist():
            scores = np.zeros(len(factors), np.int64)
            scores[np.frombuffer(row["places"], "<u2")] = np.frombuffer(row["scores"], "<i8")
            add_contributions(row["terms"], found, factors, owner, scores)
            to_come = sum(t["most"] for t in row["terms"] if t["owner"] > owner)
            held = hopeful(scores, k, to_come)
            if last:
                own = ids.take(pa.array(held))
                order = np.lexsort((
                    np.asarray(own.fill_null(0)), np.asarray(own.is_valid().cast(pa.int8())), -scores[held],
                ))[:k]
                out += [
                    {"query": row["query"], "doc_id": doc, "score": score, "shard": row["shard"]}
                    for doc, score in zip(own.take(pa.array(order)).to_pylist(), scores[held[order]].tolist())
                ]
            else:
                row |= {"places": held.astype("<u2").tobytes(), "scores": scores[held].astype("<i8").tobytes()}
                out.append(row)
        return pa.Table.from_pylist(out, schema=result if last else BUNDLE_TYPES)

    schema = "query long, doc_id long, score long, shard long" if last else BUNDLES
    return bundles.groupBy("shard", "bundle").cogroup(lists.groupBy("shard", "bundle")).applyInArrow(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """``query, rank, doc_id, score``: the best over all shards, first within lots of shards."""
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    within = Window.partitionBy("query", "lot").orderBy(*order)
    lots = found.withColumn("lot", F.pmod(F.xxhash64("shard"), F.lit(SELECT_LOTS)))
    few = lots.withColumn("at", F.row_number().over(within)).filter(F.col("at") <= k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(*order))
    return few.select("query", rank.alias("rank"), "doc_id", "score").filter(F.col("rank") <= k)


def term_weights(wanted: DataFrame, lists: DataFrame, n_docs: int, owner_shares: tuple[float, ...]) -> DataFrame:
    """``term, weight, most, owner`` of the terms of queries that a document holds, weight above 0."""
    held = lists.filter("term IS NOT NULL").groupBy("term").agg(F.sum("n_docs").alias("df"))
    held = held.join(wanted.select("term").distinct(), "term", "left_semi")
    ratio = F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    owner = F.lit(len(owner_shares))
    for at in reversed(range(len(owner_shares))):
        owner = F.when(F.col("df") <= owner_shares[at] * n_docs, F.lit(at)).otherwise(owner)
    weighted = held.select(
        "term", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("weight"), owner.alias("owner")
    )
    # a contribution without its weight is below 10^9 / 1000
    return weighted.filter("weight > 0").withColumn("most", F.col("weight") * 10**6)


def ranked_search(
    docs: DataFrame, queries: DataFrame, k: int = 50, doc_id: str = "doc_id", doc_text: str = "text",
    query_id: str = "item_id", query_text: str = "text", owner_shares: tuple[float, ...] = OWNER_SHARES,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """The ``k`` best documents of every query: ``item_id`` (as named by ``query_id``), ``rank, doc_id, score``.

    Documents and queries are whole texts; a null text has no terms, a document without terms
    counts nowhere and a query without terms or without any document gives no row. Rows of one
    query id, null among them, are one query with the terms of all. Rows of one document id are
    documents of their own; of equal scores the smaller id is first, a null id before all.
    Documents with score 0 are left out, and an empty table gives an empty result. Other
    columns are ignored. What comes to the driver is three numbers and a bit field of fixed size.

    Joins of shards with queries go by groups of ``SHARDS_TOGETHER`` shards, so the lists of a
    term that all documents hold are never one group.
    """
    wanted = save_table(query_terms(queries, query_id, query_text))
    lists = save_table(invert(docs, term_filter(wanted), doc_id, doc_text, shard_docs))
    infos = lists.filter("term IS NULL")
    n_shards, n_docs, n_terms = infos.agg(F.count("shard"), F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms, lots = n_docs or 0, n_terms or 0, -(-n_shards // SHARDS_TOGETHER) or 1
    terms = term_weights(wanted, lists, n_docs, owner_shares)
    n_bundles = -(-wanted.select("query").distinct().count() // BUNDLE) or 1
    wanted = wanted.join(terms, "term").withColumn(
        "bundle", F.pmod(F.xxhash64("query"), F.lit(n_bundles)).cast("int")
    )
    wanted = save_table(wanted)
    lot = F.pmod(F.xxhash64("shard"), F.lit(lots)).cast("int")
    every_lot = F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot")

    payload = F.collect_list(F.struct("term", "owner", "weight", "most")).alias("terms")
    asked = wanted.groupBy("bundle", "query").agg(payload).select("*", every_lot)
    bundle = F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle")
    visits = infos.select(F.col("shard").alias("shard"), lot.alias("lot"), bundle)
    nothing = F.lit(b"")
    bundles = visits.join(asked, ["lot", "bundle"]).select(
        "shard", "bundle", "query", "terms", nothing.alias("places"), nothing.alias("scores")
    )
    routes = wanted.select("term", "owner", "bundle").distinct().select("*", every_lot)
    columns = ["shard", "bundle", "term", "docs", "counts", "lengths", "ids"]
    # a bundle needs the lengths of a shard's documents at every owner
    heads = infos.select("*", bundle).join(wanted.select("bundle").distinct(), "bundle", "left_semi").select(*columns)
    owners = len(owner_shares) + 1
    for owner in range(owners):
        own = lists.withColumn("lot", lot).join(routes.filter(F.col("owner") == owner), ["term", "lot"])
        own = own.select(*columns).unionByName(heads)
        bundles = stage(bundles, own, owner, owner == owners - 1, k, n_docs, n_terms)
    return best(bundles, k).withColumnRenamed("query", query_id).select(query_id, "rank", "doc_id", "score")
