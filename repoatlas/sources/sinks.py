"""Writing results.

Tables that are written by step are rebalanced first: AQE then sizes the files and splits
steps or repos that are too large for one task.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from repoatlas.functions import content as fc
from repoatlas.functions import text as ft


def _by_step(rows: DataFrame):
    return rows.hint("rebalance", "step").write.partitionBy("step")


# -- K1 ---------------------------------------------------------------------

def write_contexts(contexts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Context rows as JSON lines, one folder per step; values JSON lacks become strings."""
    plain = ("string", "boolean", "int", "bigint", "double", "float", "smallint", "tinyint")
    columns = [
        F.col(name) if kind in plain or kind.startswith(("array", "map", "struct"))
        else F.col(name).cast("string").alias(name)
        for name, kind in contexts.dtypes
    ]
    _by_step(contexts.select(*columns)).mode(mode).json(path)


# -- K2 ---------------------------------------------------------------------

def without_content(profile: DataFrame) -> DataFrame:
    """Profile without any file content: content maps, and `content` inside file lists."""
    out = profile.drop("content", "contents", "file_contents", "readme_contents")
    for name in ("files", "sorted_files", "top_files"):
        if name in out.columns:
            out = out.withColumn(name, F.transform(name, _drop_content(out, name)))
    return out


def _drop_content(df: DataFrame, name: str):
    has = "content" in df.schema[name].dataType.elementType.names

    def clean(item: Column) -> Column:
        return item.dropFields("content") if has else item

    return clean


def write_profile(profile: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON line per repo, without file contents."""
    without_content(profile).write.mode(mode).json(path)


MANIFEST = "current.json"


def _file(spark: SparkSession, path: str):
    full = spark._jvm.org.apache.hadoop.fs.Path(path)
    return full, full.getFileSystem(spark._jsc.hadoopConfiguration())


def write_tables(tables: dict[str, DataFrame], path: str) -> str:
    """Several tables that become visible together; returns the version's folder.

    All tables are written below a new folder of ``path``; last comes one small file that
    names it. A reader sees the tables of the version before until that file is there, also if
    the job ends in between. Folders of earlier versions stay for those who still read them.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"version-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{path}/{version}/{name}")
    told = {"version": version, "tables": {n: t.schema.jsonValue() for n, t in tables.items()}}
    full, system = _file(spark, f"{path}/{MANIFEST}")
    out = system.create(full, True)
    out.write(bytearray(json.dumps(told).encode()))
    out.close()
    return f"{path}/{version}"


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the version that ``path`` names; an error if none was ever completed."""
    full, system = _file(spark, f"{path}/{MANIFEST}")
    if not system.exists(full):
        raise FileNotFoundError(f"no complete version in {path}")
    stream = system.open(full)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    told = json.loads(text)
    return {
        name: spark.read.schema(StructType.fromJson(schema)).parquet(f"{path}/{told['version']}/{name}")
        for name, schema in told["tables"].items()
    }


def write_saved_profile(
    profile: DataFrame, lists: DataFrame, path: str, **more: DataFrame
) -> str:
    """The profile of all repos with their path lists, and ``more`` tables, visible together.

    ``lists`` are rows ``repo, list, path, ord`` of the chosen analyzers. No table has file
    contents.
    """
    tables = {"profile": without_content(profile), "lists": lists.select("repo", "list", "path", "ord")}
    return write_tables(tables | more, path)


# -- K3 ---------------------------------------------------------------------

def write_prompts(prompts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Prompts as Parquet, one folder per step."""
    _by_step(prompts).mode(mode).parquet(path)


# -- K4 ---------------------------------------------------------------------

def split_reasoning(step_outputs: DataFrame, final_step: int = 4) -> DataFrame:
    """Step outputs with a `reasoning` column, taken out of the text of the final step."""
    parts = fc.extract_reasoning(F.col("output"))
    final = F.col("step") == final_step
    return step_outputs.select(
        "repo",
        "step",
        F.when(final, parts["text"]).otherwise(F.col("output")).alias("output"),
        F.when(final, parts["reasoning"]).alias("reasoning"),
    )


def write_step_outputs(step_outputs: DataFrame, path: str, final_step: int = 4) -> None:
    """Step outputs as Parquet; writing a step replaces that step only."""
    rows = split_reasoning(step_outputs, final_step)
    _by_step(rows).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


# -- K5 ---------------------------------------------------------------------

def write_readmes(
    final: DataFrame, path: str, model: str, date: str, mode: str = "overwrite"
) -> None:
    """Final README of each repo with the watermark, as Parquet."""
    marked = final.withColumn("readme", ft.watermark(F.col("readme"), date, model))
    marked.write.mode(mode).parquet(path)
