"""Registered queries: each operator on the driver's tables, next to its DuckDB SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedfold.functions.text import iso_utc
from feedfold.plans.feed import Feed
from feedfold.plans.oracle import with_ctes
from feedfold.session import input_size, size_shuffles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def presentable(df: DataFrame) -> DataFrame:
    """Timestamps as ISO text and doubles rounded, so that results compare across engines."""
    columns = []
    for f in df.schema:
        if isinstance(f.dataType, T.TimestampType):
            columns.append(iso_utc(f"`{f.name}`").alias(f.name))
        elif isinstance(f.dataType, T.DoubleType):
            columns.append(F.round(F.col(f"`{f.name}`"), 9).alias(f.name))
        else:
            columns.append(F.col(f"`{f.name}`"))
    return df.select(*columns)


def register(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register ``build(feed)`` under ``name`` with the SELECT of its SQL twin."""
    def add(build: Callable[[Feed], DataFrame]) -> Callable[[Feed], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            size_shuffles(spark, input_size(spark, f"{sf_dir}/documents.parquet"))
            return presentable(build(Feed(spark, sf_dir)))

        QUERIES[name] = run
        if sql:
            ORACLE[name] = with_ctes(sql, extra)
        return build
    return add


def load() -> None:
    from feedfold.plans import (queries_audit, queries_canonical, queries_features, queries_landing,  # noqa: F401
                                queries_reports, queries_streaming)
