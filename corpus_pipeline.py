"""The corpus pipeline: five stages, each over all documents that its predecessor kept.

Toxic documents go; of documents that are linked by their shingles one stays; documents with
a benchmark passage go; personal data is replaced by its kind; what is left is mixed to the
target weights of its sources. Every stage but the last returns the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.llm import decontaminate, jaccard, mixing, pii, toxicity
from plumeria.llm.frames import table
from plumeria.session import scratch_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, "_toxicity").where(F.col("_toxicity") < 0.5).drop("_toxicity")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where a text changes, n_chars is its new length."""
    made = pii.redact(docs.withColumn("_before", F.xxhash64("text")))
    changed = F.xxhash64("text") != F.col("_before")
    return made.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("_before")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it is drawn, with its shard, pass and position."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("jaccard_join", one_of_each),
    ("decontamination", not_leaked),
    ("pii", redacted),
    ("mixing", mixed),
]

#: No SQL states the trained models and seeded draws of the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
