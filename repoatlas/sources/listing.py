"""Listing of folders by tasks, every name included.

Spark's own listing leaves out names that start with ``.`` or ``_`` and runs in the driver.
Here folders are rows: a task lists a folder and goes down into it for a while, and the folders
it does not get to are rows of the next round. So a repo with a third of all files is listed by
many tasks, and nothing is listed in the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.sources.scratch import save_table
from repoatlas.sources.stores import open_store

FOUND = (
    "base string, inside string, depth int, patterns array<string>, is_folder boolean, size bigint,"
    " error string"
)
TYPES = pa.schema([
    ("base", pa.string()), ("inside", pa.string()), ("depth", pa.int32()),
    ("patterns", pa.list_(pa.string())), ("is_folder", pa.bool_()), ("size", pa.int64()),
    ("error", pa.string()),
])
#: Entries that a task lists below one of its folders before it leaves the rest to others.
ENTRIES = 5_000
GLOB = re.compile(r"[*?\[{]")


def segment_pattern(glob: str) -> str:
    """Regex of one path segment with ``* ? [a-z] [^a] {x,y} \\x``."""
    out, depth, i = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        elif c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"a brace is not closed inside one path segment: {glob!r}")
    return "(?s:" + "".join(out) + ")"


def split_root(root: str) -> tuple[str, list[str]]:
    """The part of a root before its first segment with a pattern, and the segments from there on."""
    parts = root.split("/")
    first = next((i for i, part in enumerate(parts) if GLOB.search(part)), len(parts))
    return "/".join(parts[:first]) or ("/" if first else "."), [p for p in parts[first:] if p]


def _children(store: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    """Entries of a folder; folders that are links are left out, as they may lead back."""
    found = store.get_file_info(pafs.FileSelector(path))
    if isinstance(store, pafs.LocalFileSystem):
        found = [
            f for f in found
            if f.type != pafs.FileType.Directory or not os.path.islink(f.path)
        ]
    return sorted(found, key=lambda f: f.base_name)


def _list_below(row: dict, entries: int) -> Iterator[dict]:
    """Files below a folder, and the folders that were not gone into."""
    waiting, listed = [row], 0
    while waiting:
        at = waiting.pop()
        if listed > entries:
            yield at | {"is_folder": True}
            continue
        try:
            store, path = open_store(at["base"])
            here = f"{path.rstrip('/')}/{at['inside']}" if at["inside"] else path
            own = store.get_file_info(here)
            if own.type == pafs.FileType.File and not at["inside"]:
                folder, _, name = at["base"].rstrip("/").rpartition("/")
                yield at | {"base": folder, "inside": name, "is_folder": False, "size": own.size}
                continue
            children = _children(store, here)
        except (OSError, ValueError) as error:
            yield at | {"is_folder": False, "error": f"cannot be listed: {error}"}
            continue
        listed += len(children) + 1
        patterns = at["patterns"]
        for child in children:
            if patterns and not re.fullmatch(patterns[0], child.base_name):
                continue
            inside = f"{at['inside']}/{child.base_name}".lstrip("/")
            made = at | {"inside": inside, "depth": at["depth"] + 1, "patterns": patterns[1:]}
            if child.type == pafs.FileType.Directory:
                waiting.append(made)
            elif len(patterns) <= 1:
                yield made | {"is_folder": False, "size": child.size}


def list_files(
    spark: SparkSession, roots: list[str], entries: int = ENTRIES, tasks: int | None = None,
) -> DataFrame:
    """``base, inside, size, error``: every file below the roots, hidden names too.

    A root is a folder, a file or a pattern; ``base`` is its qualified part without patterns and
    ``inside`` the path from there on. A file below two roots is listed for each of them. Folders
    that cannot be listed are rows with an ``error`` and no size. Links to folders of a local
    disk are not followed.
    """
    system = spark._jvm.org.apache.hadoop.fs
    start = []
    for root in roots:
        base, patterns = split_root(root)
        path = system.Path(base)
        full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        start.append((full, "", 0, [segment_pattern(p) for p in patterns], True, None, None))
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for row in batch.to_pylist():
                for found in _list_below(row, entries):
                    rows.append(found)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=TYPES)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=TYPES)

    folders = spark.createDataFrame(start, FOUND)
    rounds = []
    while not folders.isEmpty():
        listed = save_table(folders.repartition(tasks).mapInArrow(run, FOUND))
        rounds.append(listed.filter("NOT is_folder"))
        folders = listed.filter("is_folder")
    found = reduce(DataFrame.unionByName, rounds) if rounds else folders
    return found.select("base", "inside", "size", "error")


#: Files that a task reads, and rows of a batch.
FILES_TOGETHER, BATCH = 2_000, 64
RAW = pa.schema([
    ("base", pa.string()), ("inside", pa.string()), ("size", pa.int64()), ("raw", pa.binary()),
    ("error", pa.string()),
])


def read_files(listed: DataFrame, max_size: int) -> DataFrame:
    """``base, inside, size, raw, error``: the listed files with their bytes up to ``max_size``.

    A file that is gone or cannot be read is a row with an ``error``. ``listed`` is read twice.
    """

    def read(row: dict) -> dict:
        if row["error"] is None and row["size"] <= max_size:
            try:
                store, path = open_store(row["base"])
                with store.open_input_file(f"{path.rstrip('/')}/{row['inside']}") as file:
                    row["raw"] = file.read()
            except (OSError, ValueError) as error:
                row["error"] = f"cannot be read: {error}"
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                rows = [read(row) for row in batch.slice(i, BATCH).to_pylist()]
                yield pa.RecordBatch.from_pylist(rows, schema=RAW)

    tasks = -(-listed.count() // FILES_TOGETHER) or 1
    schema = "base string, inside string, size bigint, raw binary, error string"
    return listed.repartition(max(tasks, listed.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, schema)
