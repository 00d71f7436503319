"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of fixed size. The distinct blocks are sorted and a block's place in that order is its
integer name; then adjacent names are paired and the pairs are named the same way until one name is left. Names are
ranks and not digests, so two texts get one identity exactly if they are equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedfold.llm.common import HOT_SHARE, carried, fold_ascii, identified, spread_join
from feedfold.session import written

BLOCK_BYTES = 1024
# Sorting is split into so many ranges; a name is the range number and the rank within the range.
RANGES = 1 << 20
RANK_BITS = 43
NO_PARTNER = -(1 << 63)


def _named(units: DataFrame, keys: list[str], total: int, suspects: DataFrame | None) -> tuple[DataFrame, bool]:
    """Add ``name``, an integer that stands for the values of ``keys`` and for no others; also tells if any was hot.

    Ranges are sorted separately. Values that more than ``total`` / HOT_SHARE units have (fewer than HOT_SHARE values) are
    ranked among themselves after a partial aggregation, get negative names and are broadcast. Only the ``suspects``
    among the units can have them.
    """
    units = units.withColumn("digest", F.xxhash64(*keys))

    def rank(rows: DataFrame) -> DataFrame:
        part = F.pmod("digest", F.lit(RANGES))
        place = F.dense_rank().over(Window.partitionBy("part").orderBy(*keys))
        return (rows.withColumn("part", part)
                .withColumn("name", F.shiftleft(F.col("part"), RANK_BITS) + place.cast("long")).drop("part", "digest"))

    if suspects is None:
        return rank(units).drop(*keys), False
    hot = written(suspects.groupBy(F.xxhash64(*keys).alias("digest")).agg(F.count(F.lit(1)).alias("n"))
                  .filter(F.col("n") * HOT_SHARE > F.lit(total)).select("digest"), "hot-units")
    if hot.isEmpty():
        return rank(units).drop(*keys), False
    few = F.broadcast(hot)
    names = rank(units.join(few, "digest", "left_semi").select(*keys, "digest").distinct())
    names = names.withColumn("name", -F.col("name"))
    return (rank(units.join(few, "digest", "left_anti")).drop(*keys)
            .unionByName(units.join(few, "digest", "left_semi").join(F.broadcast(names), keys).drop("digest", *keys))), True


def block_identity(rows: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One (key, level, name) row per key; (level, name) is equal exactly where the texts are equal."""
    rows = rows.select(key, F.encode(F.col(text), "UTF-8").alias("bytes"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / F.lit(block_bytes))).cast("int")
    total, most = rows.select(count.alias("n")).agg(F.sum("n"), F.max("n")).first()
    if not total:
        return rows.select(key, F.lit(0).alias("level"), F.lit(0).cast("long").alias("name"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1),
                      lambda i: F.substring("bytes", i * block_bytes + 1, F.lit(block_bytes)))
    units = rows.withColumn("n", count).select(key, "n", F.posexplode(cut).alias("pos", "block"))
    names, hot = _named(units, ["block"], total, units)
    names = written(names, "block-names")
    done, level = [], 0
    while True:
        done.append(names.filter("n = 1").select(key, F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        most, level = (most + 1) // 2, level + 1
        side = [F.coalesce(F.max(F.when(F.col("pos") % 2 == i, F.col("name"))), F.lit(NO_PARTNER)) for i in (0, 1)]
        pairs = (names.filter("n > 1")
                 .groupBy(key, F.floor(F.col("pos") / 2).cast("int").alias("half"), F.ceil(F.col("n") / 2).cast("int").alias("m"))
                 .agg(side[0].alias("first"), side[1].alias("second"))
                 .select(key, F.col("m").alias("n"), F.col("half").alias("pos"), "first", "second"))
        # a pair is hot only if both of its names are, and those are negative
        names, hot = _named(pairs, ["first", "second"], total, pairs.filter("first < 0 AND second < 0") if hot else None)
        names = written(names, f"names-{level}")
    return reduce(DataFrame.unionByName, done).dropDuplicates([key])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: row_key, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared after lower-casing A-Z; null counts as empty, and empty texts are equal. The row with the
    largest id stays (a null id is smallest; of rows with one id and different raw texts the larger row key stays). Rows that repeat
    id and text are returned as often as they occur, one of them kept. An empty table gives an empty result; other
    columns are not read.
    """
    rows = identified(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    rows = rows.select("doc_id", "row_key", fold_ascii(F.col("text")).alias("text"))
    owners = (rows.select("row_key", "doc_id", F.sha2("text", 256).alias("text_sha256"))
              .groupBy("row_key", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies")))
    members = written(owners.join(block_identity(rows, "row_key", "text", block_bytes), "row_key"), "exact-members")
    groups = members.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "row_key")).alias("keep"), F.sum("copies").alias("group_size"),
        F.count(F.lit(1)).alias("members"))
    found = spread_join(members, groups, ["level", "name"], "members")
    return (found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .select("row_key", "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
                    ((F.col("row_key") == F.col("keep.row_key")) & (F.col("copy") == 1)).alias("kept"), "text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; null texts are empty texts."""
    gone = (exact_groups(docs, id_col, text_col).groupBy("row_key")
            .agg(F.max("kept").alias("kept")).filter("not kept").select("row_key"))
    rows, unique = carried(docs, id_col, text_col)
    left = rows.join(gone, "row_key", "left_anti")
    return (left if unique else left.dropDuplicates(["row_key"])).select("row.*")
