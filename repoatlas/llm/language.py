"""Language identification by sparse multinomial logistic regression on character n-grams.

Features are the hashed character n-grams of the lower-cased whole text, weighted by their
share of the text and their inverse document frequency. Frequencies are counted over all
training documents. The regression is trained, with follow-the-regularised-leader steps and an
elastic-net penalty, on a bounded sample of them, and a temperature fitted on other training
documents turns its scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from repoatlas.llm.common import fresh, give_back, small_batches, texts_of

BITS, ORDERS = 16, (1, 2, 3)
#: Bound of the sample: this many documents of each chunk of a language. Every fourth document
#: calibrates, the others train.
SAMPLE_CHUNKS, PER_CHUNK = 64, 16
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.3, 1.0, 0.02, 0.02
SCALE = 50.0
UNKNOWN = "und"
#: Bytes of text that are looked at together; each takes some sixty bytes meanwhile.
LOT = 1 << 18


def ngram_slots(texts: list[str], bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of all texts, one row per order, and the first place of each text.

    Every text is followed by as many zero characters as the longest order; the slots of
    n-grams that touch them are -1.
    """
    most = max(orders)
    chars = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(c) + most for c in chars], np.int64)
    starts = np.cumsum(sizes) - sizes
    whole = np.zeros(int(sizes.sum()), np.uint64)
    for c, at in zip(chars, starts):
        whole[at : at + len(c)] = c
    ends = starts + sizes - most
    slots = np.full((len(orders), len(whole)), -1, np.int32)
    value = np.zeros(len(whole), np.uint64)
    row = 0
    for n in range(1, most + 1):
        value = value[: len(whole) - n + 1] * np.uint64(0x100000001B3) + whole[n - 1 :] + np.uint64(n)
        if n in orders:
            mixed = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            slots[row, : len(value)] = (mixed >> np.uint64(64 - bits)).astype(np.int32)
            for end in ends:
                slots[row, max(0, end - n + 1) : end + most] = -1
            row += 1
    return slots, starts


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """``weights``: slot x language, already times the inverse document frequency."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> np.ndarray:
        slots, starts = ngram_slots(texts)
        table = np.vstack([self.weights, np.zeros((1, self.weights.shape[1]), np.float32)])
        total = np.zeros((slots.shape[1], len(self.languages)), np.float32)
        count = np.zeros(slots.shape[1], np.int64)
        for row in slots:
            total += table[row]
            count += row >= 0
        sums = np.add.reduceat(total, starts, axis=0, dtype=np.float64)
        return SCALE * sums / np.maximum(np.add.reduceat(count, starts), 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and calibrated probability; ``und`` and 0 without a letter."""
        some = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if some:
            logits = self.logits([texts[i] for i in some]) / self.temperature
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            for i, best, row in zip(some, odds.argmax(axis=1), odds):
                names[i], scores[i] = self.languages[best], float(row[best])
        return names, scores


def train(counts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_labels: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after FTRL-proximal steps over the documents, in the order given."""
    z, n = np.zeros((len(idf) + 1, n_labels)), np.zeros((len(idf) + 1, n_labels))
    bias_slot = len(idf)

    def weight(zi: np.ndarray, ni: np.ndarray, l1: float) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
        return -shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    for _ in range(EPOCHS):
        for (slots, count), label in zip(counts, labels):
            at = np.append(slots, bias_slot)
            x = np.append(SCALE * count / max(1, count.sum()) * idf[slots], 1.0)
            w = weight(z[at], n[at], L1)
            logits = x @ w
            odds = np.exp(logits - logits.max())
            odds /= odds.sum()
            odds[label] -= 1
            g = x[:, None] * odds
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = weight(z, n, L1)
    return w[:-1] * idf[:, None], w[-1]


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm."""
    def loss(log_t: float) -> float:
        scaled = logits / np.exp(log_t)
        top = scaled.max(axis=1)
        return float(np.mean(np.log(np.exp(scaled - top[:, None]).sum(axis=1)) + top
                             - scaled[np.arange(len(labels)), labels]))

    low, high, ratio = -4.0, 4.0, (5 ** 0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Training documents that hold each slot, and their number."""
    size = 1 << BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held, seen = np.zeros(size + 1, np.int64), np.zeros(size + 1, bool)
        n = 0
        for batch in small_batches(batches, "text"):
            texts = [t.decode() for t in texts_of(batch, "text")]
            slots, starts = ngram_slots(texts)
            for a, b in zip(starts, [*starts[1:], slots.shape[1]]):
                seen[:] = False
                seen[slots[:, a:b].ravel()] = True
                held += seen
            n += len(texts)
        some = np.nonzero(held[:size])[0]
        give_back()
        yield pa.RecordBatch.from_pydict({"slot": np.append(some, -1), "held": np.append(held[some], n)})

    counted = docs.select("text").mapInArrow(run, "slot long, held long").groupBy("slot").agg(F.sum("held"))
    held, n = np.zeros(size, np.int64), 0
    for slot, total in counted.collect():  # one row per slot at most
        if slot < 0:
            n = total
        else:
            held[slot] = total
    return held, n


def _sample(docs: DataFrame) -> list[tuple[str, int, np.ndarray, np.ndarray]]:
    """(language, number, slots, counts) of at most ``SAMPLE_CHUNKS * PER_CHUNK`` per language.

    The documents of a language are dealt over chunks by their hashed id and text, and the first
    of each chunk are taken, so no task orders a whole language. A document is an id and a text:
    rows that repeat both count once, rows that share a null or other id stay apart.
    """
    docs = docs.withColumn("_hash", F.xxhash64("text"))
    chunk = F.pmod(F.xxhash64("doc_id", "_hash"), F.lit(SAMPLE_CHUNKS)).alias("_chunk")
    rank = Window.partitionBy("lang", "_chunk").orderBy(F.xxhash64(F.lit(1), "doc_id", "_hash"), "doc_id", "_hash")
    chosen = docs.select("doc_id", "_hash", "lang").distinct().select("*", chunk)
    chosen = chosen.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= PER_CHUNK)
    place = (F.col("_rank") * SAMPLE_CHUNKS + F.col("_chunk")).cast("int").alias("_rank")
    chosen = chosen.select(
        F.col("doc_id").alias("_id"), F.col("_hash").alias("_own"), F.col("lang").alias("_lang"), place)
    few = F.broadcast(chosen)  # a bounded number of rows per language
    same = docs["doc_id"].eqNullSafe(few["_id"]) & (docs["_hash"] == few["_own"]) & (docs["lang"] == few["_lang"])
    picked = docs.join(few, same).dropDuplicates(["lang", "_rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            texts = [t.decode() for t in texts_of(batch, "text")]
            slots, starts = ngram_slots(texts)
            found = []
            for a, b in zip(starts, [*starts[1:], slots.shape[1]]):
                own = slots[:, a:b].ravel()
                found.append(np.unique(own[own >= 0], return_counts=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("_rank"),
                 pa.array([f[0] for f in found], pa.list_(pa.int32())),
                 pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                names=["lang", "rank", "slots", "counts"],
            )

    rows = picked.select("text", "lang", "_rank").mapInArrow(
        run, "lang string, rank int, slots array<int>, counts array<long>"
    ).toPandas()
    rows = [(r.lang, r.rank, np.array(r.slots), np.array(r.counts)) for r in rows.itertuples()]
    rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[3].sum() if len(r[3]) else 0))
    numbered, at, last = [], 0, None
    for lang, _, slots, counts in rows:
        at, last = (at + 1 if lang == last else 0), lang
        numbered.append((lang, at, slots, counts))
    return sorted(numbered, key=lambda r: (r[1], r[0]))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from all learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_language(docs: DataFrame) -> Model:
    """Learn from the rows with a text and a language that are not held out.

    Only ``doc_id`` (for the choice of rows), ``text`` and ``lang`` are used. Without any such
    row the model knows no language.
    """
    named = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    known = named.filter(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))
    )
    rows = _sample(known)
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    held, n = _document_frequency(known)
    idf = np.log((1 + n) / (1 + held)) + 1
    number = {name: i for i, name in enumerate(languages)}

    def part(rows: list) -> tuple[list, np.ndarray]:
        return [(r[2], r[3]) for r in rows], np.array([number[r[0]] for r in rows], int)

    trained, labels = part([r for r in rows if r[1] % 4 != 3])
    counts, own = part([r for r in rows if r[1] % 4 == 3])
    weights, bias = train(trained, labels, len(languages), idf)
    temperature = 1.0
    if counts:
        logits = np.array([SCALE * c @ weights[s] / max(1, c.sum()) + bias for s, c in counts])
        temperature = best_temperature(logits, own)
    return Model(languages, weights.astype(np.float32), bias, temperature)


def identify_language(
    docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """Adds the language and its score to all rows, as ``names`` (such columns are replaced).

    A null text or one without a letter is ``und`` with score 0. Whole texts are read. Nothing
    but the text decides.
    """
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    # the text once more at the end: the column itself may be of another type
    source = docs.select("*", F.col(text_col).cast("string").alias(fresh(columns, "_own_text")[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            renamed = pa.RecordBatch.from_arrays(
                batch.columns, names=[*(f"c{i}" for i in range(len(columns))), "text"]
            )
            for part in small_batches([renamed], "text", LOT):
                found, scores = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                    names=[*columns, *names],
                )
        give_back()

    schema = StructType([
        *docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType()),
    ])
    return source.mapInArrow(run, schema)
