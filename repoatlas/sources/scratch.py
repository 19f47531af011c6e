"""Tables that a job writes for itself and reads again."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def scratch_base(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    First the setting ``spark.checkpoint.dir``, then a folder set with
    ``SparkContext.setCheckpointDir``. On a local master a folder below the warehouse will do;
    on a cluster that may be a folder of one machine, so there it is an error.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return base.rstrip("/")


def scratch_folder(spark: SparkSession, base: str | None = None) -> str:
    """A new folder below ``base``, or below the shared folder of the session."""
    return f"{(base or scratch_base(spark)).rstrip('/')}/repoatlas-{uuid.uuid4().hex}"


def save_table(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The DataFrame, written as Parquet to the shared folder and read back.

    Used for the one narrow table several passes need, so the contents of the corpus are
    scanned once; the written table also survives lost executors.
    """
    path = folder or scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder with all it holds."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
