"""Token ids of a corpus in binary files of Simple-8b blocks, in the order of the documents.

A file holds, all numbers little-endian:

* eight bytes ``RTOK0001``;
* blocks of up to 65,536 ids: the words of the block, then its escaped ids, 64 bits each. A
  block runs on over the ends of documents;
* a directory: the ids of the documents (64 bits each), a byte per document that is 1 for a null
  id, the numbers of tokens of the documents as one Simple-8b block, and per block its first
  byte, ids, words and escapes (64 bits each);
* seven 64-bit numbers: first byte of the directory, documents, blocks, tokens, words and
  escapes of the lengths, CRC-32 of the directory; and again the eight bytes.

So a reader can take any block, or any range of tokens, without the ones before it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repoatlas.llm import simple8b
from repoatlas.llm.byte_bpe import text_ids
from repoatlas.llm.common import small_batches
from repoatlas.llm.warc import open_store, read_at
from repoatlas.sources.scratch import save_table, scratch_folder

MAGIC = b"RTOK0001"
TRAILER = struct.Struct("<7Q8s")
BLOCK = 1 << 16
#: A file is closed at the end of the document that takes it beyond so many tokens.
MOST_TOKENS = 1 << 27
#: Files of one task and of one step of the running sum over files.
FILE_BITS, FILE_LOT = 32, 4096
MANIFEST = "path string, file_no long, n_docs long, n_tokens long"


class TokenWriter:
    """Writes one file; ``add`` takes a document's ids in pieces, ``close`` writes the directory."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.at = file, file.write(MAGIC)
        self.blocks: list[tuple[int, int, int, int]] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.waiting: list[bytes] = []
        self.n_waiting, self.n_tokens = 0, 0

    def add(self, doc_id: int | None, pieces: Iterable[bytes]) -> None:
        n = 0
        for piece in pieces:
            n += len(piece) // 4
            self.waiting.append(piece)
            self.n_waiting += len(piece) // 4
            if self.n_waiting >= BLOCK:
                self.flush()
        self.docs.append(doc_id)
        self.lengths.append(n)
        self.n_tokens += n

    def flush(self, all_: bool = False) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        end = len(ids) if all_ else len(ids) - len(ids) % BLOCK
        for i in range(0, end, BLOCK):
            self.block(ids[i : min(i + BLOCK, end)])
        self.waiting = [ids[end:].tobytes()]
        self.n_waiting = len(ids) - end

    def block(self, ids: np.ndarray) -> None:
        words, escapes = simple8b.encode(ids)
        self.blocks.append((self.at, len(ids), len(words), len(escapes)))
        self.at += self.file.write(words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes())

    def close(self) -> None:
        self.flush(all_=True)
        words, escapes = simple8b.encode(np.array(self.lengths, np.uint64))
        directory = b"".join([
            np.array([d or 0 for d in self.docs], "<i8").tobytes(), bytes(d is None for d in self.docs),
            words.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(),
            np.array(self.blocks, "<u8").tobytes(),
        ])
        self.file.write(directory)
        self.file.write(TRAILER.pack(
            self.at, len(self.docs), len(self.blocks), self.n_tokens, len(words), len(escapes),
            zlib.crc32(directory), MAGIC,
        ))
        self.file.close()


class TokenReader:
    """Reads the directory of a file at once and its blocks as they are asked for."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        size = file.size()
        if size < len(MAGIC) + TRAILER.size:
            raise ValueError("not a token file: too short")
        at, n, n_blocks, self.n_tokens, n_words, n_escapes, crc, magic = TRAILER.unpack(
            read_at(file, size - TRAILER.size, TRAILER.size)
        )
        if magic != MAGIC:
            raise ValueError("not a token file: no trailer")
        data = read_at(file, at, size - TRAILER.size - at)
        if zlib.crc32(data) != crc:
            raise ValueError("damaged directory of a token file")
        ids, nulls, words, escapes, blocks = np.split(
            np.frombuffer(data, np.uint8),
            np.cumsum([8 * n, n, 8 * n_words, 8 * n_escapes]),
        )
        self.docs, self.nulls = ids.view("<i8"), nulls.astype(bool)
        self.lengths = simple8b.decode(words.view("<u8"), escapes.view("<u8"), n).astype(np.int64)
        self.blocks = blocks.view("<u8").reshape(n_blocks, 4).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        """The ids of a block."""
        at, n, n_words, n_escapes = self.blocks[k].tolist()
        data = np.frombuffer(read_at(self.file, at, 8 * (n_words + n_escapes)), "<u8")
        return simple8b.decode(data[:n_words], data[n_words:], n).astype("<u4")

    def tokens(self, first: int, n: int) -> np.ndarray:
        """The ``n`` ids from place ``first`` of the file on; only their blocks are read."""
        ends = np.cumsum(self.blocks[:, 1])
        if first < 0 or n < 0 or first + n > self.n_tokens:
            raise ValueError(f"no tokens {first} to {first + n}: the file has {self.n_tokens}")
        if not n:
            return np.zeros(0, "<u4")
        a, b = np.searchsorted(ends, [first, first + n - 1], "right").tolist()
        ids = np.concatenate([self.block(k) for k in range(a, b + 1)])
        skipped = first - int(ends[a] - self.blocks[a, 1])
        return ids[skipped : skipped + n]

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """Each document with its ids in pieces; one block is held at a time, or a document's."""
        k, left = -1, np.zeros(0, "<u4")
        for doc, null, n in zip(self.docs.tolist(), self.nulls.tolist(), self.lengths.tolist()):
            pieces = []
            while n > len(left):
                pieces.append(left)
                n -= len(left)
                k += 1
                left = self.block(k)
            pieces.append(left[:n])
            left = left[n:]
            yield (None if null else doc), pieces


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", most_tokens: int = MOST_TOKENS,
) -> DataFrame:
    """Write all documents in ascending order of their ids; a row per file: ``MANIFEST``.

    The files follow each other in the order of ``file_no``. A null text is empty, every
    document ends with ``end_id`` if one is given. Null ids come first; rows of one id come in
    the order of their texts' hashes, so reruns write the same files. A text of any length is
    tokenized whole, and an empty table gives no file. The name of a file is new for every
    attempt of a task, and only the files in the saved result of this function count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << FILE_BITS
        known = text_ids(tokenizer)
        end = [] if end_id is None else [np.array([end_id], "<u4").tobytes()]
        store, root = open_store(folder)
        store.create_dir(root)
        writer, name, made = None, "", 0
        for batch in small_batches(batches, "text", 1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, pieces in zip(batch.column("doc_id").to_pylist(), known.encode(texts)):
                if writer is None:
                    name = f"tokens-{uuid.uuid4().hex}.rtok"
                    writer = TokenWriter(store.open_output_stream(f"{root}/{name}"))
                writer.add(doc, _then(pieces, end))
                if writer.n_tokens > most_tokens:
                    yield _manifest(writer, f"{folder}/{name}", base + made)
                    writer, made = None, made + 1
        if writer is not None:
            yield _manifest(writer, f"{folder}/{name}", base + made)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    return ordered.select("doc_id", "text").mapInArrow(run, MANIFEST)


def _then(pieces: Iterable[bytes], end: list[bytes]) -> Iterator[bytes]:
    yield from pieces
    yield from end


def _manifest(writer: TokenWriter, path: str, number: int) -> pa.RecordBatch:
    writer.close()
    return pa.RecordBatch.from_pydict({
        "path": [path], "file_no": [number], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_tokens],
    })


def place_files(files: DataFrame) -> DataFrame:
    """Adds ``first``: the tokens of all files before this one. ``files`` is read twice."""
    lot = files.withColumn("_lot", F.floor(F.col("file_no") / F.lit(1 << FILE_BITS) / F.lit(FILE_LOT)))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = lot.groupBy("_lot").agg(F.sum("n_tokens").alias("_sum"))
    sums = sums.select("_lot", F.sum("_sum").over(earlier(Window.orderBy("_lot"))).alias("_base"))
    own = F.sum("n_tokens").over(earlier(Window.partitionBy("_lot").orderBy("file_no")))
    first = F.coalesce(own, F.lit(0)) + F.coalesce("_base", F.lit(0))
    return lot.withColumn("_own", own).join(sums, "_lot").select(*files.columns, first.cast("long").alias("first"))


def read_token_files(files: DataFrame, keep_ids: bool = False) -> DataFrame:
    """The documents of the files: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids``.

    ``files`` is the saved result of ``write_token_files``. ``start`` counts the tokens of all
    documents before this one, in all files. Each file is read by one task, block by block.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    types = [pa.int64()] * 4 + ([pa.list_(pa.int64())] if keep_ids else [])
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(types)]

    def rows_of(path: str, at: int) -> Iterator[tuple]:
        store, name = open_store(path)
        with store.open_input_file(name) as file:
            for doc, pieces in TokenReader(file).documents():
                crc, n = 0, 0
                for piece in pieces:
                    crc = zlib.crc32(piece, crc)
                    n += len(piece)
                row = (doc, at, n, crc)
                yield (*row, np.concatenate(pieces).tolist()) if keep_ids else row
                at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(batch.column(c).to_pylist() for c in ("path", "first"))):
                lot, held = [], 0
                for row in rows_of(path, first):
                    lot.append(row)
                    held += row[2] if keep_ids else 1
                    if held > 20_000:
                        yield _batch(lot, names, types)
                        lot, held = [], 0
                if lot:
                    yield _batch(lot, names, types)

    tasks = max(1, files.count())
    placed = place_files(files).repartitionByRange(tasks, "file_no")
    return placed.select("path", "first").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def encode_corpus(
    docs: DataFrame, tokenizer: str, end_id: int | None = None, folder: str | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write all documents to token files and return the saved table of the files."""
    folder = folder or scratch_folder(docs.sparkSession)
    return save_table(write_token_files(docs, f"{folder}/tokens", tokenizer, end_id, id_col, text_col))
