"""Profiles that merge: sketches of distinct values and quantiles, kept per part of a table.

A part (a run, a day) is read once. Its sketches are a few kilobytes per column whatever its size, and those of any parts
merge into the profile of all of them without reading the rows again; rows that several parts share count once among the
distinct values, but once per part among rows and quantiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 2^14 registers: distinct counts have a standard error of 0.8 %.
LG_REGISTERS = 14
# Up to here the sketch lists the hashes themselves, so that the count is exact.
FEW_VALUES = 100
# Ranks of quantiles are off by less than 0.2 % of the rows, with 99 % confidence.
QUANTILE_K = 2000


def _hashable(field: T.StructField) -> Column:
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.IntegerType, T.LongType)):
        return column
    return F.concat(F.lit("="), column.cast("string"))  # the sketch leaves empty strings out


def column_sketches(rows: DataFrame, part: str) -> DataFrame:
    """Per part and column: row_count, missing_count and a sketch of the distinct values; one pass, combined before the shuffle."""
    fields = [f for f in rows.schema if f.name != part]
    facts = rows.groupBy(F.col(part).alias("_part")).agg(F.count(F.lit(1)).alias("_rows"), *[F.struct(
        F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
        F.count_if(F.col(f"`{f.name}`").isNull()).alias("missing_count"),
        F.hll_sketch_agg(_hashable(f), LG_REGISTERS).alias("distinct_sketch")).alias(f"_{i}") for i, f in enumerate(fields)])
    cells = F.explode(F.array(*[F.col(f"_{i}") for i in range(len(fields))])).alias("x")
    return facts.select("_part", "_rows", cells).select(F.col("_part").alias("part"), F.col("_rows").alias("row_count"), "x.*")


def merged_columns(sketches: DataFrame) -> DataFrame:
    """Column profile over all parts given: counts, estimated distinct values (NULL is one), and ``few_values``.

    ``few_values`` is the exact number of distinct values where it is at most FEW_VALUES, else NULL.
    """
    merged = sketches.groupBy("column_name", "dtype").agg(
        F.sum("row_count").alias("row_count"), F.sum("missing_count").alias("missing_count"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("estimate"))
    unique = (F.coalesce("estimate", F.lit(0)) + (F.col("missing_count") > 0).cast("bigint")).alias("unique_estimate")
    return merged.select("column_name", "dtype", "row_count", "missing_count", unique).withColumn(
        "few_values", F.when(F.col("unique_estimate") <= FEW_VALUES, F.col("unique_estimate")))


def quantile_sketches(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per group and integer column a quantile sketch; NULLs are left out."""
    facts = rows.groupBy(*keys).agg(*[F.kll_sketch_agg_bigint(F.col(c).cast("bigint"), QUANTILE_K).alias(c) for c in columns])
    return facts.unpivot(keys, columns, "variable", "quantile_sketch")


def merged_quantiles(sketches: DataFrame, keys: list[str], ranks: dict[str, float]) -> DataFrame:
    """Per group and variable over all parts given: n, min and max (both exact), and a value at each rank."""
    merged = sketches.groupBy(*keys, "variable").agg(F.kll_merge_agg_bigint("quantile_sketch", QUANTILE_K).alias("s"))
    merged = merged.withColumn("n", F.kll_sketch_get_n_bigint("s"))

    def at(rank: float) -> Column:
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_bigint("s", F.lit(rank)))

    return merged.select(*keys, "variable", "n", at(0.0).alias("min"), *[at(r).alias(name) for name, r in ranks.items()],
                         at(1.0).alias("max"))
