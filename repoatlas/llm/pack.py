"""Best-fit packing of documents into training sequences by exact complements.

Only the lengths of pieces matter for a packing, and there are at most ``capacity`` lengths.
So Spark counts the pieces of each length, the plan is made from those counts for *kinds* of
sequences (a list of lengths and how often it is used), and every piece then finds its place
from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import give_back, kept, running_start, small_batches, texts_of
from repoatlas.sources.scratch import save_table

CAPACITY = 2048
#: Words whose ids a worker keeps, and as many of before; longer words are not kept.
CACHED_WORDS, CACHED_BYTES = 300_000, 48
#: By code point, whether it is a Latin letter that lower case leaves one such letter.
LATIN = np.array([all(x.isalpha() and x < "\u0250" for x in (chr(c), *chr(c).lower())) for c in range(0x250)])
#: Words that go to the model together.
TOGETHER = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary of a byte-level tokenizer.

    Printable characters stand for themselves, the others come from U+0100 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def splits_words(spec: dict) -> bool:
    """Whether a tokenizer is of the kind whose words stand for themselves.

    It composes, folds white space and lower-cases, then takes runs of letters, single digits,
    runs of other characters and the short English endings, and drops the white space.
    """
    def kinds(part: dict | None, inside: str) -> list[tuple]:
        return [
            (x["type"], (x.get("pattern") or {}).get("Regex"), x.get("content"), x.get("behavior"),
             x.get("invert"), x.get("add_prefix_space"), x.get("use_regex"))
            for x in (part or {}).get(inside, [])
        ]

    model = spec["model"]
    units = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    return (
        kinds(spec.get("normalizer"), "normalizers") == [
            ("NFC", None, None, None, None, None, None),
            ("Replace", r"\s+", " ", None, None, None, None),
            ("Lowercase", None, None, None, None, None, None),
        ]
        and kinds(spec.get("pre_tokenizer"), "pretokenizers") == [
            ("Split", units, None, "Removed", True, None, None),
            ("ByteLevel", None, None, None, None, False, False),
        ]
        and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
        and {"<|startoftext|>"} <= {t["content"] for t in spec["added_tokens"]}
        and not any(
            t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or "<|" not in t["content"]
            for t in spec["added_tokens"]
        )
    )


def ends_plainly(core: str) -> bool:
    """Whether a word ends with a letter or digit that stays one when it is normalized.

    True of Latin letters but the dotted capital I, which becomes a letter and a mark. Other
    scripts have letters that are taken apart, and a mark and a full stop are one unit.
    """
    last = core[-1]
    return last < "\u0250" and last.isalnum() and last != "\u0130"


def listed(words: pa.Array) -> list[bytes]:
    """Strings as a list of their bytes; `to_pylist` takes several times as long."""
    return words.view(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()


class WordIds:
    """Ids of the words of a text, as little-endian unsigned 32-bit integers.

    The tokenizer never joins characters across white space, nor a Latin letter or digit with
    a following ``.,;:!?``, and it lower-cases, so each distinct word is tokenized once, without
    such endings, and the ids of a text are those of its words in order. `splits_words` reads
    in the file whether this holds; for any other file whole texts go to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_words = splits_words(spec)
        self.model = Tokenizer.from_file(path)
        if not self.by_words:
            return
        self.letters = np.array([ord(c) for _, c in sorted(byte_letters().items())], "<u2")
        self.letters[32] = 32  # between words
        # plain dicts: a set loses their keys without going through all of them
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.mark = "<|startoftext|>"
        (self.mark_id,) = self.model.encode(self.mark, add_special_tokens=False).ids
        # the model alone, for units that need neither normalization nor cutting
        self.units = Tokenizer(self.model.model)
        self.units.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def learn_letters(self, words: list[bytes]) -> list[bytes]:
        """Learn the words of Latin letters alone and return the others.

        Such a word is one unit for the tokenizer and needs no normalization but lower case,
        so it can go to the model itself. The last token of a unit, and no other, ends it.
        """
        others = []
        for i in range(0, len(words), TOGETHER):
            part = words[i : i + TOGETHER]
            text = b" ".join(part).decode()
            points = np.minimum(np.frombuffer(text.encode("utf-32-le"), "<u4"), len(LATIN))
            gaps = points == 32
            odd = ~(np.append(LATIN, False)[points] | gaps)
            if odd.any():
                other = np.zeros(len(part), bool)
                other[np.cumsum(gaps)[odd]] = True
                others += [w for w, o in zip(part, other) if o]
                part = [w for w, o in zip(part, other) if not o]
                text = b" ".join(part).decode()
            if not part:
                continue
            letters = self.letters[np.frombuffer(text.lower().encode(), np.uint8)].tobytes().decode("utf-16-le")
            ids = np.array(self.units.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) != len(part) or ends[-1] != 4 * len(ids):  # a model that leaves something out
                others += part
                continue
            data = ids.tobytes()
            self.known.update(zip(part, (data[a:b] for a, b in zip([0, *ends], ends))))
        return others

    def learn(self, words: list[bytes]) -> None:
        """Many words go to the tokenizer as one text, with a special token between them."""
        words = self.learn_letters(words)
        plain = [w for w in words if b"<|" not in w]
        for word in words:
            if b"<|" in word:
                ids = self.model.encode(word.decode(), add_special_tokens=False).ids
                self.known[word] = np.array(ids, "<u4").tobytes()
        for i in range(0, len(plain), 64):
            part = plain[i : i + 64]
            text = self.mark.join(w.decode() for w in part)
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id).tolist()
            data = ids.tobytes()
            for word, a, b in zip(part, [-1, *cuts], [*cuts, len(ids)]):
                self.known[word] = data[4 * (a + 1) : 4 * b]

    def look_up(self, words: list[bytes]) -> pa.Array:
        """The ids of different words, learned where no task of this worker has met them."""
        known, old = self.known, self.old
        found = list(map(known.get, words))
        unknown = [w for w, ids in zip(words, found) if ids is None]
        known.update((w, old[w]) for w in unknown if w in old)
        self.learn([w for w in unknown if w not in known])
        if unknown:
            found = [known[w] if ids is None else ids for w, ids in zip(words, found)]
        for word in unknown:
            if len(word) > CACHED_BYTES:
                del known[word]
        return pa.array(found, pa.large_binary())

    def ids_of(self, words: pa.Array) -> pa.Array:
        """The ids of different words: those of a word without its ending, then of the ending."""
        special = pc.match_substring(words, "<|")
        fold = pc.and_not(pc.string_is_ascii(words), special)
        words = pc.if_else(fold, pc.ascii_lower(words), words)
        cores = pc.ascii_rtrim(words, ".,;:!?")
        last = pc.utf8_slice_codeunits(cores, -1).dictionary_encode()
        plainly = pa.array([bool(c) and ends_plainly(c) for c in last.dictionary.to_pylist()], pa.bool_())
        ended = pc.and_not(pc.and_(pc.not_equal(cores, words), plainly.take(last.indices)), special)
        cores = pc.if_else(ended, cores, words)
        # endings are few, and numbered; no ending has number 0
        number: dict[bytes, int] = {b"": 0}
        ending = np.zeros(len(words), np.int32)
        sizes = pc.binary_length(cores.filter(ended)).to_numpy().tolist()
        ending[ended.to_numpy(zero_copy_only=False)] = [
            number.setdefault(w[n:], len(number))
            for w, n in zip(listed(words.filter(ended)), sizes)
        ]
        cores = cores.dictionary_encode()
        own = self.look_up(listed(cores.dictionary)).take(cores.indices)
        after = self.look_up(list(number)).take(pa.array(ending))
        return pc.binary_join_element_wise(own, after, pa.scalar(b"", pa.large_binary()))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            found = self.model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [np.array(e.ids, "<u4").tobytes() for e in found]
        self.known[b""] = b""
        own = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        words = own.flatten().dictionary_encode()
        ids = self.ids_of(words.dictionary).take(words.indices)
        ends = np.append(0, np.cumsum(pc.binary_length(ids).to_numpy()))[own.offsets.to_numpy()].tolist()
        data = ids.buffers()[2]
        if len(self.known) > CACHED_WORDS:
            self.old, self.known = self.known, {}
        return [data[a:b].to_pybytes() if b > a else b"" for a, b in zip(ends, ends[1:])]


def word_ids(path: str) -> WordIds:
    """One table of words per worker process, until it takes tasks of another kind."""
    return kept(("word_ids", path), lambda: WordIds(path))


def cut_pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``.

    A document's tokens are those of its whole text and then ``end_id``; a null or empty text
    is ``end_id`` alone. Only documents longer than ``capacity`` are cut. Repeated rows give
    repeated pieces, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = word_ids(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in small_batches(batches, "text", 1 << 20):
            rows: list[tuple] = []
            found = known.encode(list(texts_of(batch, "text")))
            for doc, ids in zip(batch.column("doc_id").to_pylist(), found):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    row = (doc, piece, at // 4, len(own) // 4, zlib.crc32(own))
                    rows.append(row + (np.frombuffer(own, "<u4").tolist(),) if keep_ids else row)
            columns = list(zip(*rows))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            types += [pa.list_(pa.int64())] if keep_ids else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(types)],
            )
        give_back(("word_ids", tokenizer))

    schema = PIECES + (", ids array<long>" if keep_ids else "")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, schema)


class Availability:
    """How many pieces of each length are left, and which lengths exactly fill a gap."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()

    def pair(self, total: int) -> tuple[int, int] | None:
        """The pair of lengths with this sum whose larger part is largest."""
        if total < 2:
            return None
        half = total // 2
        small = self.left[1 : half + 1] > 0
        large = self.left[total - half : total][::-1] > 0
        both = small & large
        if total % 2 == 0:
            both[half - 1] = self.left[half] > 1
        at = int(both.argmax()) if both.size else 0
        return (total - at - 1, at + 1) if both.size and both[at] else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths with the sum ``gap`` that are all left."""
        if self.left[gap] > 0:
            return (gap,)
        if found := self.pair(gap):
            return found
        for first in np.nonzero(self.left[: gap - 1])[0][::-1].tolist():
            self.left[first] -= 1
            found = self.pair(gap - first)
            self.left[first] += 1
            if found:
                return (first, *found)
        return None

    def use(self, lengths: tuple[int, ...], most: int | None = None) -> int:
        """Take these lengths together as often as they last."""
        kinds, each = np.unique(lengths, return_counts=True)
        times = int((self.left[kinds] // each).min())
        times = times if most is None else min(times, most)
        self.left[kinds] -= each * times
        return times


def plan_packing(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences ``(lengths, how many)`` that use up ``counts[length]`` pieces.

    From the longest length down, sequences that one, two or three other lengths fill exactly
    are closed, as many of a kind as the counts allow. What is left goes, longest first, into
    the smallest open gap that holds it; a new sequence is filled exactly where the counts
    still allow it. Each step uses up a length or a gap, so there are a few thousand steps
    whatever the number of pieces.
    """
    have = Availability(counts)
    done: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        while have.left[length]:
            have.left[length] -= 1
            rest = () if length == capacity else have.exact(capacity - length)
            have.left[length] += 1
            if rest is None:
                break
            done.append(((length, *rest), have.use((length, *rest))))
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(kind: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(kind)
        while times and gap and (rest := have.exact(gap)):
            n = have.use(rest, times)
            done.append((kind + rest, n))
            times -= n
        if not times:
            return
        if not gap:
            done.append((kind, times))
            return
        if gap not in open_:
            gaps.insert(bisect_right(gaps, gap), gap)
        open_.setdefault(gap, []).append((kind, times))

    for length in range(capacity, 0, -1):
        while n := int(have.left[length]):
            at = bisect_right(gaps, length - 1)
            if at < len(gaps):
                gap = gaps[at]
                kind, times = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                    gaps.pop(at)
            else:
                gap, kind, times = capacity, (), n
            each = min(gap // length, n)
            full = min(times, n // each)
            have.left[length] -= each * full
            if kind and times > full:
                put(kind, times - full)
            put(kind + (length,) * each, full)
    done += [item for items in open_.values() for item in items]
    return done


def places(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, first sequence and offset of each run of pieces."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for kind, times in plan:
        offset = 0
        for length in kind:
            runs.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to the rows of ``cut_pieces``.

    ``pieces`` is read three times: save it first. Only one count per length comes to the
    driver (at most ``capacity``). A length that most pieces share is ranked in chunks.
    Without pieces the result is empty.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    spark = pieces.sparkSession
    shared = spark.sparkContext.broadcast(places(plan_packing(counts, capacity)))
    order = ["doc_id", "piece", "ids_crc32"]
    ranked = running_start(pieces.withColumn("_one", F.lit(1)), "length", order, "_one", "_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            ranks = batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths).tolist():
                mine = np.nonzero(lengths == length)[0]
                first, start, at = shared.value[length]
                run_ = np.searchsorted(first, ranks[mine], "right") - 1
                sequence[mine] = start[run_] + ranks[mine] - first[run_]
                offset[mine] = at[run_]
            kept = [c for c in batch.schema.names if c not in ("_rank", "_one")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*pieces.columns, "_rank").mapInArrow(
        run, f"{fields}, sequence_id long, offset long"
    )


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their places; see ``cut_pieces`` and ``pack_pieces``."""
    pieces = cut_pieces(docs, tokenizer, capacity, end_id, id_col, text_col, keep_ids)
    return pack_pieces(save_table(pieces), capacity)
