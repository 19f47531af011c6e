"""Scans: files of many repos, step templates, step outputs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas import fixed_values as fv
from repoatlas.functions import content as fc
from repoatlas.functions import paths as fp
from repoatlas.sources.archives import ENDINGS, is_archive, read_archives
from repoatlas.sources.listing import list_files, read_files
from repoatlas.sources.scratch import save_table

FILES_SCHEMA = "repo string, path string, size bigint, content string"
RAW_SCHEMA = "repo string, path string, size bigint, raw binary"


# -- S1 ---------------------------------------------------------------------

def root_base(spark: SparkSession, root: str) -> str:
    """The root as Spark lists it: qualified, without doubled slashes and dots.

    Of a root with a glob pattern it is the part before the first pattern.
    """
    parts = root.split("/")
    plain = next((i for i, part in enumerate(parts) if re.search(r"[*?\[{]", part)), len(parts))
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts[:plain]) or ("/" if plain else "."))
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def _spark_listing(spark: SparkSession, roots: list[str], max_size: int) -> DataFrame:
    """Files below folders by Spark's own listing, which leaves out hidden names."""
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    # the scan of the bytes has the size filter pushed down; larger files are listed only
    inside = F.lit(None).cast("string")
    for base in sorted((root_base(spark, root) + "/" for root in roots), key=len):
        below = F.substr(F.col("path"), F.lit(len(base) + 1))
        inside = F.when(F.col("path").startswith(base), below).otherwise(inside)
    lost = F.raise_error(F.concat(F.lit("below none of the roots: "), F.col("path")))
    inside = F.coalesce(inside, lost.cast("string"))
    listing = binary.load(roots)
    named = [inside.alias("inside"), F.col("length").alias("size")]
    small = listing.filter(F.col("length") <= max_size).select(
        *named, F.col("content").alias("raw"), F.lit(None).cast("string").alias("error")
    )
    large = listing.filter(F.col("length") > max_size).select(
        *named, F.lit(None).cast("binary").alias("raw"), F.lit(None).cast("string").alias("error")
    )
    return small.unionByName(large)


def _checked(files: DataFrame, errors: str) -> DataFrame:
    """The files with what could not be read: as rows, left out, or as the end of the job."""
    if errors == "rows":
        return files
    if errors == "skip":
        return files.filter("error IS NULL").drop("error")
    told = F.concat_ws(": ", F.lit("cannot read"), "repo", "path", "error")
    checked = F.when(F.col("error").isNotNull(), F.raise_error(told).cast("string"))
    return files.withColumn("content", checked.otherwise(F.col("content"))).drop("error")


def scan_repos(
    spark: SparkSession,
    roots: str | list[str],
    fmt: str = "parquet",
    max_size: int | None = fv.MAX_FILE_BYTES,
    errors: str = "raise",
    listing: str = "own",
) -> DataFrame:
    """``files(repo, path, size, content)`` of many repos.

    ``parquet``   a table that has these columns already
    ``directory`` folders with one sub-folder per repo, also as glob patterns or relative
                  paths; with a pattern, the repo is the first folder from the pattern on.
                  All names are seen, also those that start with ``.`` or ``_``.
                  ``listing='spark'`` takes Spark's listing in place of `listing.list_files`,
                  for stores that only Spark can open; it leaves such names out
    ``archive``   tar (also compressed) or zip files, one per repo, named after it, found
                  below the roots; see `archives`. All names are seen

    Files over ``max_size`` bytes (None: no limit) keep their row and have no content.

    ``errors`` says what becomes of files, members, folders and archives that cannot be read:
    ``'raise'`` ends the job when their content is used, ``'skip'`` leaves them out, ``'rows'``
    adds a column ``error``, null for all that could be read. The row of a damaged archive has
    the archive's name as its path, beside the rows of the members before the damage.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    limit = fv.NO_LIMIT if max_size is None else max_size
    if errors not in ("raise", "skip", "rows") or listing not in ("own", "spark"):
        raise ValueError("errors must be 'raise', 'skip' or 'rows' and listing 'own' or 'spark'")
    if fmt == "parquet":
        table = spark.read.parquet(*roots).select("repo", "path", "size", "content")
        return table.withColumn("error", F.lit(None).cast("string")) if errors == "rows" else table
    content = fc.decode_text(F.col("raw")).alias("content")
    if fmt == "directory":
        if listing == "spark":
            raw = _spark_listing(spark, roots, limit)
        else:
            raw = read_files(save_table(list_files(spark, roots)), limit)
        files = raw.select(
            F.substring_index("inside", "/", 1).alias("repo"),
            F.regexp_extract("inside", r"(?s)^[^/]*/(.*)$", 1).alias("path"),
            "size", content, "error",
        )
        return _checked(files.filter((F.col("path") != "") | F.col("error").isNotNull()), errors)
    if fmt == "archive":
        listed = save_table(list_files(spark, roots))
        found = listed.filter(is_archive(F.col("inside")) & F.col("error").isNull()).select(
            F.concat_ws("/", F.rtrim("base", F.lit("/")), "inside").alias("uri"), "size"
        )
        lost = listed.filter("error IS NOT NULL").select(
            F.col("base").alias("archive"), F.col("inside").alias("path"), "size",
            F.lit(None).cast("binary").alias("raw"), "error",
        )
        rows = read_archives(found, limit).unionByName(lost)
        repo = F.regexp_replace(fp.file_name("archive"), ENDINGS, "").alias("repo")
        return _checked(rows.select(repo, "path", "size", content, "error"), errors)
    raise ValueError(f"fmt must be 'parquet', 'directory' or 'archive', not {fmt!r}")


# -- S2 ---------------------------------------------------------------------

def read_text(
    files: DataFrame, max_size: int = fv.MAX_FILE_BYTES, keep_missing: bool = False
) -> DataFrame:
    """Files within the size gate, their content decoded.

    ``keep_missing`` keeps the rows of files over the gate, with a null content.
    """
    small = F.col("size") <= max_size
    text = fc.decode_text(F.col("content"))
    if keep_missing:
        return files.withColumn("content", F.when(small, text))
    return files.filter(small).withColumn("content", text)


# -- S3, S4 -----------------------------------------------------------------

def find_by_extension(
    files: DataFrame, extensions: Iterable[str], exclude_dirs: Iterable[str] = fv.EXCLUDED_DIRS
) -> DataFrame:
    """Files whose name ends with one of the extensions, outside the excluded directories."""
    return files.filter(
        fp.ends_with_one(fp.file_name(), extensions) & ~fp.in_excluded_dir(dirs=exclude_dirs)
    )


def find_by_pattern(
    files: DataFrame, pattern: str, exclude_dirs: Iterable[str] = fv.EXCLUDED_DIRS
) -> DataFrame:
    """Files whose name contains the pattern, outside the excluded directories."""
    return files.filter(
        fp.file_name().contains(pattern) & ~fp.in_excluded_dir(dirs=exclude_dirs)
    )


# -- S5 ---------------------------------------------------------------------

def file_info(files: DataFrame, max_size: int = fv.MAX_FILE_BYTES) -> DataFrame:
    """Loose file records: default flags, content under the limit, `error` if unreadable.

    The ``error`` column of a scan with ``errors='rows'`` is carried on; a file without a size,
    or within the limit but without a content, is unreadable too. Such a record has nothing but
    its path and the error.
    """
    small = F.col("size") <= max_size
    missing = F.when(F.col("size").isNull(), F.lit("no size")).when(
        small & F.col("content").isNull(), F.lit("no content")
    )
    error = F.coalesce("error", missing) if "error" in files.columns else missing
    read = error.isNull()
    flag = F.when(read, F.lit(False))
    return files.select(
        "repo", "path", F.when(read, F.col("size")).alias("size"),
        flag.alias("is_key_file"), flag.alias("is_entry_point"), flag.alias("is_config"),
        F.when(read, F.lit(fv.UNKNOWN_LANGUAGE)).alias("language"),
        F.when(read & small, F.col("content")).alias("content"),
        error.alias("error"),
    )


# -- S6, S7 -----------------------------------------------------------------

def scan_step_templates(files: DataFrame) -> DataFrame:
    """``step, name, path`` of the files named ``NN-*.md``, without skipped ones, in order."""
    name = fp.file_name()
    number = F.regexp_extract(name, fv.STEP_FILE, 1)
    return (
        files.filter((number != "") & (number != "00") & ~name.contains(".SKIP."))
        .select(
            "repo",
            number.cast("int").alias("step"),
            F.regexp_extract(name, r"^\d{2}-(.*)\.md$", 1).alias("name"),
            "path",
        )
        .orderBy("repo", "step", "path")
    )


def scan_step_outputs(step_outputs: DataFrame, n: int) -> DataFrame:
    """Non-empty outputs of the steps before ``n``."""
    return step_outputs.filter((F.col("step") < n) & (F.length("output") > 0))
