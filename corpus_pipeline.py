"""The corpus pipeline: language ID, n-gram join, secret scan, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repoatlas.llm.common import fresh
from repoatlas.llm.language import UNKNOWN, fit_language, identify_language
from repoatlas.llm.mix import mix_sources, mixed_documents
from repoatlas.llm.ngram_join import similar_groups
from repoatlas.llm.pack import pack_documents
from repoatlas.llm.queries import tokenizer_path
from repoatlas.llm.secrets import find_secrets, redact
from repoatlas.sources.scratch import save_table, scratch_folder

#: A document whose language is less certain than this goes.
LEAST_SCORE = 0.5
#: Shingles of this many words, alike from this percentage on.
SHINGLE, PERCENT = 5, 80
#: No stage can be stated in SQL as a whole: training, tokenizing and packing are in it.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a letter whose language is recognised; ``lang`` is what was found.

    The model learns from the labels of the documents themselves; without any label all
    documents with a letter are kept, and their ``lang`` stays null.
    """
    model = fit_language(docs)
    found_name, score_name = fresh(docs.columns, "_found", "_score")
    found = identify_language(docs, model, names=(found_name, score_name))
    if not model.languages:
        return docs.filter(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).select(*docs.columns)
    kept = found.filter((F.col(found_name) != UNKNOWN) & (F.col(score_name) >= LEAST_SCORE))
    return kept.withColumn("lang", F.col(found_name)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of similar documents the one with the smallest id.

    Rows with a null id and texts without words are in no group and stay. Of rows with the
    same id and text one stays.
    """
    groups = save_table(similar_groups(docs, PERCENT, SHINGLE))
    (gone_name,) = fresh(docs.columns, "_gone")
    gone = groups.filter("component_id <> doc_id").select(F.col("doc_id").alias(gone_name)).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone[gone_name], "left_anti")
    again = groups.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if again.limit(1).count():
        kept = kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).unionByName(
            kept.filter("doc_id IS NULL"))
    return kept.select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the text by a mark; ``n_chars`` is counted anew where that happens.

    All rows stay, in number and order of their columns; a null text stays null, and an empty
    table stays empty.
    """
    (spans,) = fresh(docs.columns, "_spans")
    found = find_secrets(docs, out=spans)
    hit = F.size(spans) > 0
    marked = redact(found, spans=spans)
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        marked = marked.withColumn("n_chars", F.when(hit, size).otherwise(F.col("n_chars")))
    return marked.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: a row per document and repeat, texts cut where it cuts.

    Documents without words go, and so do those the mix does not reach. Rows that repeat, also
    with a null id, are documents of their own. An empty table stays empty.
    """
    return mixed_documents(docs, mix_sources(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their place in the training sequences.

    A null or empty text is its end token alone, repeated rows are packed each, and an empty
    table gives no pieces.
    """
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_folder(spark)
    for name, stage in STAGES[:-1]:
        docs = save_table(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
