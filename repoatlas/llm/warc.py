"""Web archive records in ZIP packages: written, located by their directories and range-read.

A package is a ZIP file with two *stored* members: ``archive/data.warc.gz``, whose records are
gzip members of their own, and ``indexes/index.tsv`` with a line per record. The reader takes
the end record, the ZIP64 end record where there is one, and the central directory to find
where the members lie, reads the index, and then reads single records by their byte range.
Nothing is unpacked to disk. Files are opened through ``pyarrow.fs``, so a package may lie in
any store that knows the URI scheme of the folder.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repoatlas.llm.common import small_batches
from repoatlas.sources.scratch import save_table, scratch_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
#: Payloads below this size are always stored in full.
LEAST_SHARED = 100
#: A package is closed beyond this many records or bytes, a read joins ranges up to RANGE.
MOST_RECORDS, MOST_BYTES, RANGE = 50_000, 1 << 30, 4 << 20
#: Records that one task reads.
PER_TASK = 20_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or absolute path; ``file:/x`` is taken as ``file:///x``."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


# --- writing ---------------------------------------------------------------------------------

def make_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record, compressed. A revisit holds the HTTP head only; its length is the payload's."""
    block = HTTP_OK.format(len(payload)).encode()
    kind = "response" if refers_to is None else "revisit"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")),
        ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{hashlib.sha256(payload).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if refers_to is None:
        block += payload
    else:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packed = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packed.compress(head.encode() + block + b"\r\n\r\n") + packed.flush()


def write_package(store: pafs.FileSystem, path: str, records: Iterable[tuple[int | None, bytes]]) -> int:
    """Write one package from ``(page, record)``; the index alone is held in memory."""
    lines: list[str] = []
    at = 0
    with store.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as pack:
        with pack.open(zipfile.ZipInfo(DATA), "w", force_zip64=True) as member:
            for page, record in records:
                member.write(record)
                lines.append(f"{'' if page is None else page}\t{at}\t{len(record)}\n")
                at += len(record)
        pack.writestr(zipfile.ZipInfo(INDEX), "".join(lines))
    return len(lines)


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, html, refers_to`` as packages below ``folder``.

    Returns ``path, n_records`` of each package, to be saved at once: running it writes. A
    task that is run again writes files of new names, and only those that the saved rows name
    belong to the collection.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for batch in small_batches(batches, "html"):
                for row in batch.to_pylist():
                    payload = (row["html"] or "").encode()
                    yield row["page_id"], make_record(row["page_id"], row["url"], payload, row["refers_to"])

        source = rows()
        ahead = next(source, None)
        while ahead is not None:

            def one() -> Iterator[tuple[int | None, bytes]]:
                nonlocal ahead
                n = size = 0
                while ahead is not None and n < MOST_RECORDS and size < MOST_BYTES:
                    n, size = n + 1, size + len(ahead[1])
                    yield ahead
                    ahead = next(source, None)

            name = f"{uuid.uuid4().hex}.wacz"
            n = write_package(store, f"{base}/{name}", one())
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n]})

    wanted = records.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"),
        F.col("refers_to").cast("long"),
    )
    return wanted.mapInArrow(run, "path string, n_records long")


def shared_payloads(pages: DataFrame) -> DataFrame:
    """Adds ``refers_to``: the smallest page_id with an equal payload, for all other pages.

    Pages that have that smallest id themselves, and payloads below ``LEAST_SHARED`` bytes,
    get null. Only ids and digests are grouped; the pages themselves move once, by their own
    id, so no payload that is very common comes together in one task.
    """
    marked = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("_digest", F.sha2("html", 256))
    narrow = save_table(marked.filter(F.octet_length("html") >= LEAST_SHARED).select("page_id", "_digest"))
    first = narrow.groupBy("_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    first = save_table(first.filter("_n > 1").drop("_n"))
    again = (
        narrow.join(first, "_digest").filter(~F.col("page_id").eqNullSafe(F.col("_first")))
        .select(F.col("page_id").alias("_page"), F.col("_digest").alias("_same"), F.col("_first").alias("refers_to"))
    )
    again = save_table(again.distinct())
    return marked.join(
        again, marked["page_id"].eqNullSafe(again["_page"]) & (marked["_digest"] == again["_same"]), "left"
    ).select("page_id", "url", "html", "refers_to")


# --- reading ---------------------------------------------------------------------------------

def read_at(file: pa.NativeFile, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(size)


def zip_members(file: pa.NativeFile, size: int) -> dict[str, tuple[int, int]]:
    """Name -> (first byte, length) of the stored members, from the directories alone."""
    tail_at = max(0, size - 65_557)
    tail = read_at(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    locator = tail_at + end - 20
    if locator >= 0 and (found := read_at(file, locator, 20))[:4] == b"PK\x06\x07":
        wide = read_at(file, struct.unpack_from("<Q", found, 8)[0], 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is not where its locator says")
        count, length, start = struct.unpack_from("<QQQ", wide, 32)
    directory = read_at(file, start, length)
    members: dict[str, tuple[int, int]] = {}
    at = 0
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", directory, at + 20)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # the 64-bit values of those fields that are full of ones
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        if method == 0:
            head = read_at(file, local, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            n_own, n_more = struct.unpack_from("<HH", head, 26)
            members[name] = (local + 30 + n_own + n_more, packed)
        at += 46 + n_name + n_extra + n_note
    return members


def read_record(data: bytes) -> dict:
    """Fields of one compressed record, its payload checked against its digest."""
    text = zlib.decompress(data, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http).group(1))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = lambda name: fields[name][len("<urn:page:") : -1]
    if fields["WARC-Type"] == "response":
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record of page {page('WARC-Record-ID')}")
    number = lambda s: None if s == "None" else int(s)
    return {
        "page_id": number(page("WARC-Record-ID")), "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"], "payload_bytes": length, "payload_digest": digest,
        "refers_to": number(page("WARC-Refers-To")) if "WARC-Refers-To" in fields else None,
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def locate_records(packages: DataFrame) -> DataFrame:
    """``path, start, length`` of every record of the packages named in the column ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = open_store(path)
                with store.open_input_file(name) as file:
                    members = zip_members(file, file.size())
                    lines = read_at(file, *members[INDEX]).decode().splitlines()
                first = members[DATA][0]
                spans = [line.split("\t")[1:] for line in lines]
                for i in range(0, len(spans), 10_000):
                    part = spans[i : i + 10_000]
                    yield pa.RecordBatch.from_pydict({
                        "path": [path] * len(part), "start": [first + int(a) for a, _ in part],
                        "length": [int(n) for _, n in part],
                    })

    return packages.select("path").mapInArrow(run, "path string, start long, length long")


def read_records(located: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at ``path, start, length``, read by byte range; neighbours are read together.

    ``payload_bytes`` and ``payload_digest`` are of the full payload for both kinds of record;
    ``payload`` (if asked for) is null for a revisit.
    """
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    if with_payload:
        names, types, schema = [*names, "payload"], [*types, pa.binary()], schema + ", payload binary"

    def ranges(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
        group: list[tuple[str, int, int]] = []
        for row in sorted(rows):
            if group and (row[0] != group[0][0] or row[1] + row[2] - group[0][1] > RANGE):
                yield group
                group = []
            group.append(row)
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length"))))
            for group in ranges(rows):
                if group[0][0] != path:
                    path = group[0][0]
                    store, name = open_store(path)
                    file = store.open_input_file(name)
                first = group[0][1]
                data = read_at(file, first, group[-1][1] + group[-1][2] - first)
                found = [read_record(data[a - first : a - first + n]) for _, a, n in group]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in found], t) for c, t in zip(names, types)], names=names
                )

    return located.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages as records and return the saved table of packages (``path, n_records``).

    A null html is an empty payload, rows with the same id are records of their own, other
    columns are ignored, and an empty table gives no package.
    """
    folder = folder or scratch_folder(pages.sparkSession)
    return save_table(write_packages(shared_payloads(pages), f"{folder}/packages"))


def read_archives(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the packages; see ``read_records``."""
    n = packages.agg(F.sum("n_records")).first()[0] or 0
    tasks = max(packages.sparkSession.sparkContext.defaultParallelism, -(-n // PER_TASK))
    located = locate_records(packages.repartition(tasks, "path"))
    return read_records(located.repartitionByRange(tasks, "path", "start"), with_payload)
