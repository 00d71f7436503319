"""Documents to packed training sequences in five stages; each stage's result is written before the next one reads it."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from feedfold.llm.common import table  # noqa: E402
from feedfold.llm.exact_dedup import drop_exact_copies  # noqa: E402
from feedfold.llm.ngram_join import drop_near_copies  # noqa: E402
from feedfold.llm.pii import replace_pii  # noqa: E402
from feedfold.llm.quality import keep_sampled  # noqa: E402
from feedfold.llm.queries import PII_KEY, packed  # noqa: E402
from feedfold.session import fresh_path  # noqa: E402


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws."""
    return keep_sampled(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of equal texts."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return drop_near_copies(docs)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; n_chars follows its text."""
    out = replace_pii(docs, PII_KEY)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts that are left into sequences."""
    return packed(docs)


STAGES = [("quality_classifier", quality_classifier), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("pii_surrogates", pii_surrogates), ("packing", packing)]

# Resampling, chosen paths, keyed surrogates and tokenising are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
