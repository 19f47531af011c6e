"""The corpus of the registered queries, written as archives and folders to be scanned again."""

from __future__ import annotations

import tarfile
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.catalog import views
from repoatlas.functions.batches import give_back, rows_of
from repoatlas.sources.scratch import scratch_folder
from repoatlas.sources.stores import open_store

WRITTEN = "name string, size bigint"
#: Bytes of a tar are in blocks; bytes that are copied at a time.
BLOCK, COPY = 512, 1 << 20


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, source, inside, content``: the files by source, each path with its repo before it."""
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "source")
    files = views.files_with_id(spark, sf_dir).join(docs, "doc_id")
    return files.select(
        "doc_id", F.coalesce("source", F.lit("none")).alias("source"),
        F.concat_ws("/", "repo", "path").alias("inside"), F.coalesce("content", F.lit("")).alias("content"),
    )


def _add(archive, path: str, data: bytes) -> None:
    if isinstance(archive, zipfile.ZipFile):
        archive.writestr(zipfile.ZipInfo(path), data, zipfile.ZIP_DEFLATED if len(data) % 2 else zipfile.ZIP_STORED)
    else:
        member = tarfile.TarInfo(path)
        member.size = len(data)
        archive.addfile(member, BytesIO(data))
        archive.members = []  # it would keep them all


def _open(name: str, file: pa.NativeFile):
    if name.endswith(".zip"):
        return zipfile.ZipFile(file, "w")
    return tarfile.open(fileobj=file, mode="w|gz" if name.endswith("gz") else "w|")


def _copy(whole: pa.NativeFile, part: pa.NativeFile, size: int) -> None:
    """The first ``size`` bytes of a file, or all that it has."""
    while size and (data := whole.read(min(COPY, size))):
        part.write(data)
        size -= len(data)


def write_archives(files: DataFrame, folder: str, halves: bool = False) -> None:
    """One archive ``name`` per group of ``name, inside, content``; of a tar, its first half if asked."""

    def write(rows: Iterator[tuple]) -> Iterator[tuple[str, int]]:
        store, root = open_store(folder)
        store.create_dir(root)
        last, total, file, archive = None, 0, None, None

        def close() -> tuple[str, int]:
            archive.close()
            file.close()
            if halves:
                with store.open_input_file(f"{root}/{last}.whole") as whole:
                    with store.open_output_stream(f"{root}/{last}", compression=None) as half:
                        _copy(whole, half, total // 2)
                store.delete_file(f"{root}/{last}.whole")
            return last, total

        for name, inside, content in rows:
            if name != last:
                if last is not None:
                    yield close()
                last, total = name, 0
                file = store.open_output_stream(f"{root}/{name}" + (".whole" if halves else ""), compression=None)
                archive = _open(name, file)
            data = content.encode()
            _add(archive, inside, data)
            total += BLOCK + len(data) + -len(data) % BLOCK
        if last is not None:
            yield close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, size in write(rows_of(batches, "name", "inside", "content")):
            yield pa.RecordBatch.from_pydict({"name": [name], "size": [size]})
        give_back()

    dealt = files.select("name", "inside", "content").repartition("name")
    dealt.sortWithinPartitions("name", "inside").mapInArrow(run, WRITTEN).write.parquet(f"{folder}-done")


def corpus_archives(spark: SparkSession, sf_dir: str, halves: bool = False) -> str:
    """The folder of an archive per source: plain and compressed tar and zip files, or halves of tars."""
    files = source_files(spark, sf_dir)
    kind = F.array(*[F.lit(e) for e in (".tar", ".zip", ".tar.gz", ".tar")])
    ending = F.lit(".tar") if halves else F.element_at(kind, F.pmod(F.crc32("source"), F.lit(4)).cast("int") + 1)
    folder = scratch_folder(spark)
    write_archives(files.withColumn("name", F.concat("source", ending)), folder, halves)
    return folder


def corpus_folders(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a sub-folder per source, with hidden and underscored names in it."""
    inside = F.expr(
        "CASE doc_id % 3 WHEN 0 THEN inside WHEN 1 THEN concat(inside, '/.eslintrc')"
        " ELSE concat('_lib/', inside, '/__main__.py') END"
    )
    folder = scratch_folder(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            names = batch.column("name").to_pylist()
            for name, content in zip(names, batch.column("content").to_pylist()):
                store.create_dir(f"{root}/{name}".rpartition("/")[0])
                with store.open_output_stream(f"{root}/{name}", compression=None) as file:
                    file.write(content.encode())
            yield pa.RecordBatch.from_pydict({"name": names, "size": [0] * len(names)})

    files = source_files(spark, sf_dir).select(F.concat_ws("/", "source", inside).alias("name"), "content")
    files.mapInArrow(run, WRITTEN).write.parquet(f"{folder}-done")
    return folder
