"""A corpus pipeline: quality filter, exact dedup, near dedup, benchmark decontamination, mixing to target weights.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs. All but the
last return the columns of documents. ORACLE_SQL is None: the quality model is fitted in numpy and MinHash links by
hashed bands, neither of which SQL can express; tests/llm/test_pipeline.py holds the result against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import common, decontam, exact_dedup, minhash, mixing, quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores at 0.5 or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, labels)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the row with the largest id."""
    return exact_dedup.keep_one(docs, keep="max")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group, the document with the smallest id."""
    return minhash.keep_one(docs, threshold=85)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a single window of a benchmark item, however long they are."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.keep_clean(docs, benchmark, share=0.0)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how often (repeats) and the target of their source."""
    mixed = mixing.mix_sources(docs).filter(F.col("taken") > 0)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken", (F.col("taken") / F.col("size")).cast("int").alias("repeats"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing to target weights", mix_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), "stage")
    return docs
