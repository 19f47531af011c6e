"""Archives, read member by member and never whole.

Plain tar and zip files are indexed first: only headers or the directory are read, which gives
a row per member with its place. The members are then read by byte range in lots, so an archive
of any size is read by many tasks. A compressed tar has no places to start from, so one task
streams through it, a member at a time.

What cannot be read is a row with an ``error``: an archive that ends too early gives the members
before that and one such row.
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from repoatlas.functions.batches import give_back
from repoatlas.sources.scratch import save_table
from repoatlas.sources.stores import open_store, read_range

#: What the names of archives end with.
ENDINGS = r"(?i)(\.tar|\.tar\.(gz|bz2|xz)|\.tgz|\.tbz2|\.txz|\.zip)$"
SPLIT = r"(?i)(\.tar|\.zip)$"
#: Members and bytes that a task reads, bytes of one read, and of a gap that is read over.
MEMBERS, BYTES, RANGE, GAP = 10_000, 64 << 20, 4 << 20, 64 << 10
#: A batch of members has about so many bytes.
BATCH = 8 << 20
ZIP_HEADER = struct.Struct("<4s5H3I2H")
STORED, DEFLATED, BZIP2 = 0, 8, 12
INDEX = (
    "archive string, path string, size bigint, kind string, method int, start bigint, "
    "stored bigint, crc bigint, error string"
)
INDEX_TYPES = pa.schema([
    ("archive", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("kind", pa.string()),
    ("method", pa.int32()), ("start", pa.int64()), ("stored", pa.int64()), ("crc", pa.int64()),
    ("error", pa.string()),
])
MEMBER = "archive string, path string, size bigint, raw binary, error string"
MEMBER_TYPES = pa.schema([
    ("archive", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("raw", pa.binary()),
    ("error", pa.string()),
])


def is_archive(path: Column) -> Column:
    return path.rlike(ENDINGS)


def _failure(name: str, size: int | None, error: object) -> dict:
    return {"path": name, "size": size, "error": str(error) or type(error).__name__}


# -- index ------------------------------------------------------------------

def tar_index(file: pa.NativeFile, size: int, name: str) -> Iterator[dict]:
    """Regular files of a plain tar; a failure row where it ends without its end mark."""
    try:
        with tarfile.open(fileobj=file, mode="r:") as archive:
            for member in archive:
                archive.members = []  # it would keep them all
                if member.isfile() and member.sparse is not None:
                    yield _failure(member.name.removeprefix("./"), member.size, "sparse member")
                elif member.isfile():
                    if member.offset_data + member.size > size:
                        break
                    yield {
                        "path": member.name.removeprefix("./"), "size": member.size, "kind": "tar",
                        "method": STORED, "start": member.offset_data, "stored": member.size,
                    }
            at = archive.offset
        if read_range(file, at, 512) != bytes(512):
            yield _failure(name, size, f"truncated or damaged after {min(at, size)} bytes")
    except (tarfile.TarError, OSError, EOFError) as error:
        yield _failure(name, size, f"truncated or damaged: {error}")


def _zip_row(path: str, flags: int, method: int, size: int, start: int, stored: int, crc: int) -> dict:
    if flags & 1:
        return _failure(path, size, "encrypted member")
    if method not in (STORED, DEFLATED, BZIP2):
        return _failure(path, size, f"compression method {method}")
    return {
        "path": path, "size": size, "kind": "zip", "method": method, "start": start,
        "stored": stored, "crc": crc,
    }


def zip_index(file: pa.NativeFile, size: int, name: str) -> Iterator[dict]:
    """Files of a zip from its directory, or from the headers of the members if that is missing."""
    try:
        with zipfile.ZipFile(file) as archive:
            for m in archive.infolist():
                if not m.is_dir():
                    yield _zip_row(
                        m.filename, m.flag_bits, m.compress_type, m.file_size, m.header_offset,
                        m.compress_size, m.CRC,
                    )
    except (zipfile.BadZipFile, OSError, EOFError, struct.error, NotImplementedError) as error:
        at = 0
        while len(head := read_range(file, at, ZIP_HEADER.size)) == ZIP_HEADER.size:
            mark, _, flags, method, _, _, crc, stored, plain, n_name, n_extra = ZIP_HEADER.unpack(head)
            end = at + ZIP_HEADER.size + n_name + n_extra + stored
            if mark != b"PK\x03\x04" or flags & 8 or end > size:
                break
            path = read_range(file, at + ZIP_HEADER.size, n_name)
            path = path.decode("utf-8" if flags & 0x800 else "cp437", "replace")
            if not path.endswith("/"):
                yield _zip_row(path, flags, method, plain, at, stored, crc)
            at = end
        yield _failure(name, size, f"truncated or damaged after {min(at, size)} bytes: {error}")


def index_archives(archives: DataFrame) -> DataFrame:
    """``INDEX`` rows of the plain tar and zip files ``uri, size``; a row per member or failure."""

    def rows_of(uri: str, size: int) -> Iterator[dict]:
        name = uri.rsplit("/", 1)[-1]
        index = zip_index if name.lower().endswith(".zip") else tar_index
        try:
            store, path = open_store(uri)
            with store.open_input_file(path) as file:
                yield from index(file, size, name)
        except (OSError, ValueError) as error:
            yield _failure(name, size, f"cannot be read: {error}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size in zip(*(batch.column(c).to_pylist() for c in ("uri", "size"))):
                lot = []
                for row in rows_of(uri, size):
                    lot.append({"archive": uri} | row)
                    if len(lot) == 1000:
                        yield pa.RecordBatch.from_pylist(lot, schema=INDEX_TYPES)
                        lot = []
                yield pa.RecordBatch.from_pylist(lot, schema=INDEX_TYPES)

    tasks = 4 * archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("uri", "size").repartition(tasks).mapInArrow(run, INDEX)


# -- members ----------------------------------------------------------------

def _batches(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    lot, held = [], 0
    for row in rows:
        lot.append(row)
        held += len(row.get("raw") or b"") + 100
        if held > BATCH:
            yield pa.RecordBatch.from_pylist(lot, schema=MEMBER_TYPES)
            lot, held = [], 0
    if lot:
        yield pa.RecordBatch.from_pylist(lot, schema=MEMBER_TYPES)


def _end(row: dict) -> int:
    """A bound on the last byte of a member; the header of a zip has a name and an extra part."""
    extra = ZIP_HEADER.size + 4096 if row["kind"] == "zip" else 0
    return row["start"] + row["stored"] + extra


def _groups(rows: Iterable[dict]) -> Iterator[list[dict]]:
    """Neighbours of one archive that are read together."""
    group: list[dict] = []
    for row in rows:
        near = group and row["archive"] == group[0]["archive"] and (
            row["start"] - _end(group[-1]) <= GAP and _end(row) - group[0]["start"] <= RANGE
        )
        if group and not near:
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def _member(row: dict, data: bytes, first: int, file: pa.NativeFile) -> bytes:
    """The bytes of a member, checked where the archive has a sum."""
    at = row["start"] - first
    if row["kind"] == "tar":
        return data[at : at + row["size"]]
    head = ZIP_HEADER.unpack_from(data, at)
    if head[0] != b"PK\x03\x04":
        raise ValueError("no header where the directory says")
    at += ZIP_HEADER.size + head[9] + head[10]
    stored = data[at : at + row["stored"]]
    if len(stored) < row["stored"]:  # longer extra parts than were read
        stored = read_range(file, first + at, row["stored"])
    if row["method"] == DEFLATED:
        inflate = zlib.decompressobj(-15)
        stored = inflate.decompress(stored, row["size"] + 1)
    elif row["method"] == BZIP2:
        stored = bz2.BZ2Decompressor().decompress(stored, row["size"] + 1)
    if len(stored) != row["size"] or zlib.crc32(stored) != row["crc"]:
        raise ValueError("damaged member")
    return stored


def read_members(index: DataFrame, max_size: int) -> DataFrame:
    """``MEMBER`` rows of indexed members, with their bytes up to ``max_size``.

    ``index`` is read twice: save it first. Tasks get lots of neighbouring members.
    """
    spark = index.sparkSession
    wanted = F.when(F.col("error").isNull() & (F.col("size") <= max_size), F.col("stored"))
    n, n_bytes = index.agg(F.count("*"), F.coalesce(F.sum(wanted), F.lit(0))).first()
    tasks = max(spark.sparkContext.defaultParallelism, -(-n // MEMBERS), -(-n_bytes // BYTES))

    def rows_of(rows: Iterable[dict]) -> Iterator[dict]:
        readable, name, file = [], None, None
        for row in rows:
            if row["error"] is None and row["size"] <= max_size:
                readable.append(row)
            else:
                yield row
        for group in _groups(readable):
            try:
                if group[0]["archive"] != name:
                    name = group[0]["archive"]
                    store, path = open_store(name)
                    file = store.open_input_file(path)
                first = group[0]["start"]
                data = read_range(file, first, _end(group[-1]) - first)
            except (OSError, ValueError) as error:
                name = None
                yield from ({**row, "error": f"cannot be read: {error}"} for row in group)
                continue
            for row in group:
                try:
                    yield {**row, "raw": _member(row, data, first, file)}
                except (ValueError, OSError, EOFError, struct.error, zlib.error) as error:
                    yield {**row, "error": str(error)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(rows_of(batch.to_pylist()))
        give_back()

    dealt = index.repartitionByRange(tasks, "archive", "start").sortWithinPartitions("archive", "start")
    return dealt.mapInArrow(run, MEMBER)


def inflated(file: pa.NativeFile):
    """A stream of what is compressed in the file; reading beyond a premature end is an error."""
    head = read_range(file, 0, 6)
    file.seek(0)
    for mark, opened in ((b"\x1f\x8b", gzip.open), (b"BZh", bz2.open), (b"\xfd7zXZ\x00", lzma.open)):
        if head.startswith(mark):
            return opened(file)
    raise ValueError("not a compressed tar")


def stream_archives(archives: DataFrame, max_size: int) -> DataFrame:
    """``MEMBER`` rows of compressed tar files ``uri, size``, each streamed through by one task."""

    def rows_of(uri: str, size: int) -> Iterator[dict]:
        name = uri.rsplit("/", 1)[-1]
        try:
            store, path = open_store(uri)
            with store.open_input_file(path) as file, inflated(file) as data, tarfile.open(fileobj=data, mode="r|") as archive:
                for member in archive:
                    archive.members = []
                    if not member.isfile():
                        continue
                    row = {"path": member.name.removeprefix("./"), "size": member.size}
                    if member.size <= max_size:
                        row["raw"] = archive.extractfile(member).read()
                        if len(row["raw"]) < member.size:
                            raise EOFError(f"ends inside {row['path']}")
                    yield row
        except (tarfile.TarError, OSError, EOFError, ValueError, zlib.error, lzma.LZMAError) as error:
            yield _failure(name, size, f"truncated or damaged: {error}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size in zip(*(batch.column(c).to_pylist() for c in ("uri", "size"))):
                yield from _batches({"archive": uri} | row for row in rows_of(uri, size))
        give_back()

    tasks = 4 * archives.sparkSession.sparkContext.defaultParallelism
    return archives.select("uri", "size").repartition(tasks).mapInArrow(run, MEMBER)


def read_archives(archives: DataFrame, max_size: int) -> DataFrame:
    """``MEMBER`` rows of all archives ``uri, size``: every file, and a row per failure."""
    plain = F.col("uri").rlike(SPLIT)
    index = save_table(index_archives(archives.filter(plain)))
    return read_members(index, max_size).unionByName(stream_archives(archives.filter(~plain), max_size))
