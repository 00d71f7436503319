"""Constraints as expectations: each rule yields its violating rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _key_text(columns: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns])


def unique_rule(df: DataFrame, table: str, key: list[str]) -> DataFrame:
    """Keys that occur more than once (partial counts combine before the shuffle)."""
    return (df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key]))
            .groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
            .select(F.lit(table).alias("table_name"), F.lit("unique").alias("rule"),
                    F.lit(",".join(key)).alias("subject"), _key_text(key).alias("violating_key"), "n"))


def foreign_key_rule(df: DataFrame, table: str, columns: list[str], parent: DataFrame,
                     parent_columns: list[str]) -> DataFrame:
    """Referencing keys without a parent row; keys with a NULL part are not checked.

    Both sides are reduced to distinct keys first, so a key shared by many rows is joined once.
    """
    child = (df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
             .groupBy(*columns).agg(F.count("*").alias("n")))
    keys = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_columns, columns)]).distinct()
    return (child.join(keys, columns, "left_anti")
            .select(F.lit(table).alias("table_name"), F.lit("foreign_key").alias("rule"),
                    F.lit(",".join(columns)).alias("subject"), _key_text(columns).alias("violating_key"), "n"))


def check_rule(df: DataFrame, table: str, rules: dict[str, Column], key: Column) -> DataFrame:
    """One row per row and failed check; a check that is NULL passes, as in SQL."""
    failed = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    return (df.select(key.cast("string").alias("violating_key"), F.explode(failed).alias("subject"))
            .select(F.lit(table).alias("table_name"), F.lit("check").alias("rule"), "subject",
                    "violating_key", F.lit(1).cast("bigint").alias("n")))


def not_null_rule(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Number of NULLs per required column, for the columns that have any."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return (counts.unpivot([], columns, "subject", "n").filter("n > 0")
            .select(F.lit(table).alias("table_name"), F.lit("not_null").alias("rule"), "subject",
                    F.lit("").alias("violating_key"), "n"))


def expect(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)
