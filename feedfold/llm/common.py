"""Row identity, joins that survive hot keys, and bounded Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedfold.session import written

# A key with more than 1/HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique_ids(docs: DataFrame, id_col: str) -> bool:
    n, ids, distinct = docs.agg(F.count(F.lit(1)), F.count(id_col), F.countDistinct(id_col)).first()
    return n == ids == distinct


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = "row_key") -> DataFrame:
    """Add a non-null long ``key`` that names a row and orders like ``id_col`` (nulls first).

    Where ids are unique and not null the key is the id. Otherwise rows are told apart by a digest of their
    text as well; rows that agree in id and text share a key.
    """
    if unique_ids(docs, id_col):
        return docs.withColumn(key, F.col(id_col).cast("long"))
    digest = F.xxhash64(F.col(text_col), F.hash(F.col(text_col)))
    pairs = docs.select(F.col(id_col).alias("_name"), digest.alias("_digest")).distinct()
    order = [F.col("_name").asc_nulls_first(), F.col("_digest")]
    names = written(pairs.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn(key, F.monotonically_increasing_id()), "row-names")
    return (docs.withColumn("_d", digest)
            .join(names, F.col(id_col).eqNullSafe(F.col("_name")) & (F.col("_d") == F.col("_digest")))
            .drop("_d", "_name", "_digest"))


def carried(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """Rows as one struct ``row`` beside their ``row_key``, so that no column of ``docs`` clashes with a helper's.

    Also tells whether every row has a key of its own.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if unique_ids(docs, id_col):
        return rows.withColumn("row_key", F.col("row")[id_col].cast("long")), True
    rows = rows.withColumns({"_id": F.col("row")[id_col], "_text": F.col("row")[text_col]})
    return identified(rows, "_id", "_text").select("row_key", "row"), False


def spread_join(rows: DataFrame, groups: DataFrame, on: list[str], size: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``groups`` (one row a key, ``size`` telling how many rows have it) without a hot task.

    The fewer than HOT_SHARE keys with over 1/HOT_SHARE of the rows are broadcast; all others are shuffled.
    ``rows`` is read twice, so pass a stored table. ``how`` is inner or left.
    """
    total, most = groups.agg(F.sum(size), F.max(size)).first()
    if (most or 0) * HOT_SHARE <= (total or 0):
        return rows.join(groups, on, how)
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot = groups.filter(is_hot)
    names = F.broadcast(hot.select(*on))
    return (rows.join(F.broadcast(hot), on)
            .unionByName(rows.join(names, on, "left_anti").join(groups.filter(~is_hot), on, how)))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (F.when(F.octet_length(text) == F.char_length(text), F.lower(text))
            .otherwise(F.translate(text, upper, upper.lower())))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` (text, bytes or a list) has about ``limit`` bytes in each, one row at least."""
    for batch in batches:
        start, held = 0, 0
        for i, n in enumerate(byte_sizes(batch.column(batch.schema.get_field_index(column)))):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if batch.num_rows > start:
            yield batch.slice(start)


def release() -> None:
    """Give freed memory back to the system: Python workers are reused, so what one stage keeps is missing in the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def byte_sizes(values: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    lengths = pc.binary_length(values) if pa.types.is_string(values.type) or pa.types.is_binary(values.type) \
        or pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else pc.list_value_length(values)
    return pc.fill_null(lengths, 0).to_pylist()
