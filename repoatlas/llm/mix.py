"""Mixing sources to target weights in blocks of words.

The documents of a source, one after the other, are cut into blocks of a fixed number of
words. The mix has a number of slots for each source. Every shard of the mix draws how many of
its slots each source gets (multinomial, with a generator of its own), the slots of a source
are numbered through, and slot ``j`` of a source with ``n`` blocks takes the block at place
``j mod n`` of the pseudorandom permutation number ``j div n``. So each block comes once before
any comes again, and nothing but block numbers is shuffled to choose them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import WORD, running_start, small_batches, texts_of
from repoatlas.sources.scratch import save_table

BLOCK_WORDS, SHARD_SLOTS = 64, 1024
#: Weights of the sources in code point order, repeating; the most often a source may be taken.
WEIGHTS, MOST_TIMES = (5, 2, 1), 3
#: The table of sources (a row each) goes to the driver and to every task; more are refused.
MOST_SOURCES = 1_000_000


def target_sizes(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; excess is reshared."""
    size, weight = np.array(sizes, float), np.array(weights, float)
    limit = most * size
    full = np.zeros(len(size), bool)
    share = np.zeros(len(size))
    while not full.all():
        rest = max(0.0, total - limit[full].sum())
        share = np.where(full, limit, rest * weight / weight[~full].sum())
        over = ~full & (share > limit)
        if not over.any():
            break
        full |= over
    return np.where(full, limit, share).tolist()


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of ``index`` (below ``n``) in the pseudorandom permutation of ``range(n)`` by ``key``.

    Four Feistel rounds over the next even power of two; values beyond ``n`` walk on.
    """
    half = np.ceil(np.log2(np.maximum(n, 2)) / 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, todo = index.astype(np.uint64), np.arange(len(index))
    limit, key = n.astype(np.uint64), key.astype(np.uint64)
    while len(todo):
        left, right = value[todo] >> half[todo], value[todo] & mask[todo]
        for turn in range(4):
            x = right * np.uint64(0x9E3779B97F4A7C15) + key[todo] + np.uint64(turn * 0x632BE5AB + 1)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask[todo])
        value[todo] = (left << half[todo]) | right
        todo = todo[value[todo] >= limit[todo]]
    return value.astype(np.int64)


@dataclass(frozen=True)
class Mix:
    """``rows``: id, source, size, source_size, target and ``_start`` (words of the source before
    it) of every document. ``slots``: shard, source number, epoch and block of every slot.
    ``pieces``: the part of a document that lies in a block.

    Slots and pieces are made of far smaller tables, by whose size Spark would take them, and
    what is summed from them, for small and broadcast it; all joins with them are by sorting."""

    rows: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """Each document with ``taken``: its words in the mix, repeats counted."""
        times = self.slots.groupBy("_source", "block").agg(F.count("*").alias("_times"))
        got = self.pieces.join(times.hint("merge"), ["_source", "block"]).groupBy("_source", "_start", "doc_id").agg(
            F.sum(F.col("words") * F.col("_times")).alias("taken")
        ).withColumnRenamed("doc_id", "_id")
        same = [self.rows[c] == got[c] for c in ("_source", "_start")]
        same += [self.rows["doc_id"].eqNullSafe(got["_id"]), self.rows["size"] > 0]
        return self.rows.join(got.hint("merge"), same, "left").select(
            "doc_id", "source", "size", "source_size", "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )

    def content(self) -> DataFrame:
        """What each slot holds: shard, epoch, block, doc_id, first word and number of words."""
        return self.slots.hint("merge").join(self.pieces, ["_source", "block"])


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_TIMES,
    block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> Mix:
    """Choose blocks of all documents so that the sources come near their target shares.

    Sources in code point order, null last, get the repeating ``weights`` of the words of all
    documents; a target stops at ``most`` times its source. A null text has no words; such
    documents are in ``rows`` but in no block. Rows with the same id are documents of their
    own. Other columns are ignored. The same input gives the same mix.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = save_table(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    ))
    totals = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r.n for r in totals]
    targets = target_sizes(sizes, [weights[i % len(weights)] for i in range(len(sizes))], sum(sizes), most)
    blocks = [-(-n // block_words) for n in sizes]
    quota = [min(int(most * b), round(t * b / n)) if n else 0 for n, b, t in zip(sizes, blocks, targets)]

    named = spark.createDataFrame(
        [(r.source, i, n, float(t)) for i, (r, n, t) in enumerate(zip(totals, sizes, targets))],
        "_name string, _source int, source_size long, target double",
    )
    known = F.broadcast(named)  # a row per source, at most MOST_SOURCES
    rows = sized.join(known, sized["source"].eqNullSafe(known["_name"])).drop("_name")
    rows = save_table(running_start(rows, "_source", ["doc_id", "size"], "size", "_start"))

    first, last = F.col("_start"), F.col("_start") + F.col("size")
    width = F.lit(block_words)
    at = F.col("block") * width
    pieces = rows.filter("size > 0").select(
        "_source", "_start", "doc_id", "size",
        F.explode(F.sequence(F.floor(first / width), F.floor((last - 1) / width))).alias("block"),
    ).select(
        "_source", "_start", "doc_id", "size", "block",
        (F.greatest(at, first) - first).alias("first_word"),
        (F.least(at + width, last) - F.greatest(at, first)).alias("words"),
    )
    return Mix(rows, _slots(spark, np.array(blocks), np.array(quota), shard_slots, seed), pieces)


def _slots(spark, blocks: np.ndarray, quota: np.ndarray, shard_slots: int, seed: int) -> DataFrame:
    total = int(quota.sum())
    kinds = "_shard long, _source int, n long"
    if not total:
        return spark.createDataFrame([], "_shard long, _source int, epoch long, block long")
    share = quota / total

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                size = min(shard_slots, total - int(shard) * shard_slots)
                drawn = np.random.default_rng([seed, int(shard)]).multinomial(size, share)
                some = np.nonzero(drawn)[0]
                yield pd.DataFrame({"_shard": shard, "_source": some.astype("int32"), "n": drawn[some]})

    shards = spark.range(-(-total // shard_slots))
    drawn = save_table(shards.mapInPandas(draw, kinds))
    got = np.zeros(len(quota), np.int64)
    for source, n in drawn.groupBy("_source").agg(F.sum("n")).collect():
        got[source] = n
    # Slots drawn beyond a source's number are given, in order, to sources that drew too few.
    lacking = np.maximum(quota - got, 0)
    ends = np.cumsum(lacking)
    limits = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quota)], "_source int, _quota long")
    numbered = running_start(drawn, "_source", ["_shard"], "n", "first").join(F.broadcast(limits), "_source")
    own = F.greatest(F.lit(0), F.least(F.col("n"), F.col("_quota") - F.col("first")))
    numbered = save_table(numbered.withColumn("own", own).withColumn("n", F.col("n") - own).withColumn("_all", F.lit(0)))
    over = running_start(numbered.filter("n > 0").select("_shard", "_source", "_all", "n"),
                         "_all", ["_shard", "_source"], "n", "first")
    both = numbered.filter("own > 0").select(
        "_shard", "_source", "first", F.col("own").alias("n"), F.lit(False).alias("over")
    ).unionByName(over.select("_shard", "_source", "first", "n", F.lit(True).alias("over")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.iloc[a : a + 512]
                n = part["n"].to_numpy()
                number = np.repeat(part["first"].to_numpy(), n)
                number += np.arange(len(number)) - np.repeat(np.cumsum(n) - n, n)
                source = np.repeat(part["_source"].to_numpy(), n)
                moved = np.repeat(part["over"].to_numpy(), n)
                to = np.searchsorted(ends, number[moved], "right")
                number[moved] += got[to] - (ends[to] - lacking[to])
                source[moved] = to
                size = blocks[source]
                epoch = number // size
                key = (source.astype(np.uint64) << np.uint64(20)) + epoch.astype(np.uint64)
                key = key * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed)
                yield pd.DataFrame({
                    "_shard": np.repeat(part["_shard"].to_numpy(), n), "_source": source.astype("int32"),
                    "epoch": epoch, "block": permuted(number % size, size, key),
                })

    return both.mapInPandas(place, "_shard long, _source int, epoch long, block long")


def mixed_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: one row per document and epoch.

    A document that is taken whole keeps its text; of one taken in part, the runs of words
    taken, each from the first character of its first word to the end of its last, stand in
    order with an empty line between. Documents the mix does not take go, those without words
    among them. ``n_chars``, where it exists, is counted anew. Of rows with the same id each
    stands for its own share. Other columns are kept, whatever their names.
    """
    names = docs.columns
    at = {name: f"c{i}" for i, name in enumerate(names)}
    docs = docs.toDF(*at.values())
    id_, text_ = at["doc_id"], at["text"]
    parts = mix.content().groupBy("_source", "_start", "doc_id", "size", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("first_word", "words"))).alias("_runs"), F.sum("words").alias("_got")
    )
    parts = parts.groupBy("doc_id", "_source", "_start", "size").agg(F.sort_array(F.collect_list(F.struct(
        "epoch", (F.col("_got") == F.col("size")).alias("whole"), "_runs"))).alias("_takes"))
    from pyspark.sql import Window

    nth = Window.partitionBy("_id").orderBy("_size", "_start")
    rank = Window.partitionBy(id_).orderBy("_words")
    plan = mix.rows.filter("size > 0").select(
        F.col("doc_id").alias("_id"), "_source", "_start", F.col("size").alias("_size")
    ).withColumn("_n", F.row_number().over(nth))
    plan = plan.join(
        parts.select(F.col("doc_id").alias("_of"), F.col("_source").alias("_s"), F.col("_start").alias("_at"), "_takes").hint("merge"),
        F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_source") == F.col("_s")) & (F.col("_start") == F.col("_at")),
    ).select("_id", "_n", "_takes")
    text = F.coalesce(F.col(text_), F.lit(""))
    own = docs.withColumn("_words", F.regexp_count(text, F.lit(WORD))).filter("_words > 0")
    own = own.withColumn("_k", F.row_number().over(rank))
    rows = own.join(plan.hint("merge"), own[id_].eqNullSafe(plan["_id"]) & ((own["_k"] - plan["_n"]) == 0))
    rows = rows.select(*docs.columns, F.explode("_takes").alias("_take"))
    rows = rows.select(*docs.columns, F.col("_take.whole").alias("_whole"), F.col("_take._runs").alias("_runs"))

    @F.pandas_udf("string")
    def cut(text: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([cut_words(t or "", [(r["first_word"], r["words"]) for r in x]) for t, x in zip(text, runs)])

    rows = rows.withColumn(text_, F.when(F.col("_whole"), F.col(text_)).otherwise(
        cut(F.when(~F.col("_whole"), F.col(text_)), F.when(~F.col("_whole"), F.col("_runs")).otherwise(F.array().cast("array<struct<first_word:bigint,words:bigint>>")))))
    if "n_chars" in at:
        size = F.char_length(text_).cast(docs.schema[at["n_chars"]].dataType)
        rows = rows.withColumn(at["n_chars"], size)
    return rows.select(*at.values()).toDF(*names)


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """The given runs ``(first word, number of words)``, neighbours as one, joined by blank lines."""
    import re

    if not runs:
        return ""
    joined: list[list[int]] = []
    for first, n in sorted(runs):
        if joined and joined[-1][1] == first:
            joined[-1][1] += n
        else:
            joined.append([first, first + n])
    words = [m.span() for m in re.finditer(WORD, text)]
    return "\n\n".join(text[words[a][0] : words[b - 1][1]] for a, b in joined)
