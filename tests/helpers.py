"""Small inputs for the tests."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.sources.scan import FILES_SCHEMA


def make_files(spark: SparkSession, repos: dict[str, dict[str, str | None]]) -> DataFrame:
    rows = [
        (repo, path, len((content or "").encode()), content)
        for repo, files in repos.items()
        for path, content in files.items()
    ]
    return spark.createDataFrame(rows, FILES_SCHEMA)


def evaluate(spark: SparkSession, values, make, kind: str = "string") -> list:
    """The Column ``make(col("x"))`` for each value, in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}").repartition(3)
    out = df.select("i", make(F.col("x")).alias("y")).collect()
    return [row.y for row in sorted(out, key=lambda row: row.i)]


def matches(df: DataFrame, *columns: str) -> set:
    return {tuple(row) for row in df.select(*columns).collect()}
