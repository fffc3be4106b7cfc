"""The training-data pipeline: quality, exact and near deduplication, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; docs are rows read from files, so that a stage can
read them more than once. All but the last return the columns of documents. The last one returns these and
source_size, target and taken: the words that the mix takes of the document, up to twice its size; documents of
which it takes nothing are gone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlode.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from gridlode.llm.common import checkpoint, fresh_path, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from all labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.drop_low_quality(docs, labels)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keeps the row with the largest doc_id."""
    return exact_dedup.drop_exact(docs)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity of 0.8 or more), keeps the smallest doc_id."""
    return near_dedup.drop_near(docs, percent=80)


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes words of each source up to its target. Columns named source_size, target or taken give way to the mix's."""
    plan = checkpoint(mixing.plan_mix(mixing.sized_documents(docs)))
    made = ["source_size", "target", "taken"]
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    sized = docs.select(own.alias("row"), "source", mixing.word_count(F.col("text")).alias("_size"), mixing.hash60(F.col("doc_id")).alias("_h"))
    return mixing.apply_mix(sized, plan).where("taken > 0").select("row.*", *made)


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", keep_distinct),
    ("near_dedup", keep_unlike),
    ("decontaminate", keep_unleaked),
    ("mix_sources", mix),
]

#: The near-duplicate and quality stages can't be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
