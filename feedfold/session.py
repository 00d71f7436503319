"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app_name: str = "feedfold", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# The bytes of a shuffle that a task reads, of the input per shuffle partition, and of files that a task reads.
TASK_BYTES, PARTITION_BYTES, FILE_BYTES = 8 << 20, 2 << 20, 16 << 20


def size_shuffles(spark: SparkSession, size: int) -> None:
    """Let the shuffles of the queries that follow grow with ``size``, the bytes of their main input.

    A text takes far longer to clean than to move, so a task gets few bytes: the cores stay evenly busy, and what a task sorts or collects
    fits its memory at any size, where a fixed number of ever larger partitions spills. What the application's own configuration sets stays.
    """
    given = spark.sparkContext.getConf()
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    for key, value in (("spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{TASK_BYTES}b"),
                       ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions)),
                       ("spark.sql.files.maxPartitionBytes", f"{FILE_BYTES}b")):
        if not given.contains(key):
            spark.conf.set(key, value)


def input_size(spark: SparkSession, path: str) -> int:
    """Bytes of the files at or below ``path``, from the listing of the store it is in; 0 where nothing is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(place).getLength() if files.exists(place) else 0


_LOCAL_DIRS: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="feedfold-")
    return _LOCAL_DIRS[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/feedfold/{label}-{uuid.uuid4().hex}"


# Spark's setting by which the shuffle files of a query go when it ends, and not when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Fixed value: the codec of stored texts. They take about a third less room than with Spark's default, for the same time.
TEXT_CODEC = "zstd"

_PASSING = threading.local()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what runs inside go with the end of their query."""
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread writes inside go when the block ends, so that a drain of many batches holds those of one at a time."""
    outer, _PASSING.paths = getattr(_PASSING, "paths", None), []
    try:
        yield
    finally:
        paths, _PASSING.paths = _PASSING.paths, outer
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage; the write's shuffle files go with its end."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if getattr(_PASSING, "paths", None) is not None:
        _PASSING.paths.append(path)
    with shuffles_dropped(spark):
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_popular(rows: DataFrame, groups: DataFrame, on: list[str], how: str = "inner", most: int = 200) -> DataFrame:
    """Join ``rows`` with ``groups`` (one row per key) when a few keys may hold much of ``rows``.

    The ``most`` commonest keys of ``rows`` are joined through a broadcast of at most that many groups, so none of them
    fills a task; all other keys hold little and are shuffled. Keys with a NULL part match nothing. ``how`` is inner or left.
    """
    counted = rows.select(*on).dropna().groupBy(*on).agg(F.count("*").alias("popularity"))
    popular = F.broadcast(counted.orderBy(F.col("popularity").desc(), *on).limit(most).select(*on))
    few = F.broadcast(groups.join(popular, on, "left_semi"))
    return (rows.join(popular, on, "left_semi").join(few, on, how)
            .unionByName(rows.join(popular, on, "left_anti").join(groups, on, how)))


def join_dimension(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a dimension that is usually small.

    It is written first, so Spark knows its bytes and broadcasts it below ``spark.sql.autoBroadcastJoinThreshold``; a larger
    dimension goes through the ordinary join, where adaptive execution handles skewed keys.
    """
    return fact.join(written(dim, "dimension"), on, how)
