"""Tables of a stream's state: bucketed by the hash of their key, versioned by batch, switched together by one manifest.

A batch writes new versions of the buckets it touches beside the old ones. Its manifest, a small file that appears by one rename, names for
every table and bucket the versions that make it up; the newest manifest is the state. A batch that died before the
rename left nothing that a reader opens, and a batch that a manifest already counts is skipped when it is replayed.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedfold.session import TEXT_CODEC, shuffles_dropped

# A bucket of an appended table is rewritten as one version when it has so many.
VERSIONS = 16

# Fixed value: up to so many folders of buckets are listed by the driver; Spark's own limit of 32 sends out a job to list a few small folders.
LISTED = 1024
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.threshold"


class KeyedState:
    """State below ``root``; ``keys`` names the key columns of every table."""

    def __init__(self, spark: SparkSession, root: str, keys: dict[str, list[str]], buckets: int = 32) -> None:
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets

    # --- manifest ---------------------------------------------------------------------------------
    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _files(self):
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        files = self._files()
        if not files.exists(self._path("manifest")):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(self._path("manifest")) if s.getPath().getName().endswith(".json"))

    def _load(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{name}", wholetext=True).first()[0])

    def manifest(self) -> dict:
        """The newest manifest: the last batch, and by table and bucket its versions and row schema."""
        names = self._manifests()
        return self._load(names[-1]) if names else {"batch": -1, "buckets": self.buckets, "tables": {}, "schemas": {}}

    def _publish(self, manifest: dict) -> None:
        """One rename makes the batch's versions the state."""
        name = f"manifest/{manifest['batch']:020d}"
        out = self._files().create(self._path(f"{name}.new"), True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._files().rename(self._path(f"{name}.new"), self._path(f"{name}.json")):
            raise RuntimeError(f"batch {manifest['batch']} was published by another writer")

    # --- reading ----------------------------------------------------------------------------------
    def bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*self.keys[table]), F.lit(self.buckets)).cast("int")

    def read(self, table: str, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The rows of a table, or of some of its buckets only (no file of another one is opened); None before its first batch."""
        manifest = manifest or self.manifest()
        if table not in manifest["schemas"]:
            return None
        found = manifest["tables"][table]
        paths = [f"{self.root}/{table}/version={v}/bucket={b}" for b, versions in found.items() for v in versions
                 if buckets is None or int(b) in buckets]
        return self._open(paths, manifest["schemas"][table])

    def _open(self, paths: list[str], schema: dict) -> DataFrame:
        kind = T.StructType.fromJson(schema)
        if not paths:
            return self.spark.createDataFrame([], kind)
        before = self.spark.conf.get(_LISTING)
        self.spark.conf.set(_LISTING, str(max(LISTED, int(before))))
        try:
            return self.spark.read.schema(kind).parquet(*paths)
        finally:
            self.spark.conf.set(_LISTING, before)

    def lookup(self, table: str, wanted: DataFrame) -> DataFrame:
        """Rows of some keys (``wanted``, a stored frame with the key columns); only their buckets are opened.

        Spark knows the bytes of the keys and broadcasts them below its own threshold.
        """
        touched = [r.b for r in wanted.select(self.bucket(table).alias("b")).distinct().collect()]
        return self.read(table, touched).join(wanted.select(*self.keys[table]), self.keys[table], "left_semi")

    # --- writing ----------------------------------------------------------------------------------
    @contextmanager
    def batch(self, batch_id: int):
        """A ``Batch`` to write with; what it wrote becomes the state when the block ends. None if it is state already."""
        manifest = self.manifest()
        if batch_id <= manifest["batch"]:
            yield None
            return
        if manifest["buckets"] != self.buckets:
            raise ValueError(f"the state has {manifest['buckets']} buckets")
        batch = Batch(self, batch_id, manifest)
        yield batch
        self._publish(batch.next)

    def vacuum(self, keep: int = 2) -> None:
        """Delete the versions that none of the ``keep`` newest manifests names, and the older manifests."""
        names = self._manifests()
        kept = [self._load(name) for name in names[-keep:]]
        for table in {t for m in kept for t in m["tables"]}:
            live = {(v, b) for m in kept for b, versions in m["tables"].get(table, {}).items() for v in versions}
            for folder in self._files().listStatus(self._path(table)):
                version = int(folder.getPath().getName().partition("=")[2])
                if version > kept[-1]["batch"]:
                    continue
                for part in self._files().listStatus(folder.getPath()):
                    name = part.getPath().getName()
                    if name.startswith("bucket=") and (version, name.partition("=")[2]) not in live:
                        self._files().delete(part.getPath(), True)
        for name in names[:-keep]:
            self._files().delete(self._path(f"manifest/{name}"), False)


class Batch:
    """The next version of a state, not yet visible."""

    def __init__(self, state: KeyedState, batch_id: int, manifest: dict) -> None:
        self.state, self.id, self.before = state, batch_id, manifest
        self.next = {**manifest, "batch": batch_id, "tables": {t: dict(b) for t, b in manifest["tables"].items()},
                     "schemas": dict(manifest["schemas"])}

    def _write(self, table: str, rows: DataFrame) -> list[int]:
        """Write the buckets of ``rows``, whose column ``bucket`` names them, and return their numbers."""
        path = f"{self.state.root}/{table}/version={self.id}"
        with shuffles_dropped(rows.sparkSession):
            rows.write.mode("overwrite").option("compression", TEXT_CODEC).partitionBy("bucket").parquet(path)
        self.next["schemas"][table] = rows.drop("bucket").schema.jsonValue()
        names = [s.getPath().getName() for s in self.state._files().listStatus(self.state._path(f"{table}/version={self.id}"))]
        return [int(n.partition("=")[2]) for n in names if n.startswith("bucket=")]

    def _switch(self, table: str, buckets: list[int], append: bool) -> None:
        versions = self.next["tables"].setdefault(table, {})
        for b in buckets:
            versions[str(b)] = (versions.get(str(b), []) if append else []) + [self.id]

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows; buckets in many versions become one."""
        state = self.state
        full = [int(b) for b, v in self.before["tables"].get(table, {}).items() if len(v) >= VERSIONS]
        named = rows.withColumn("bucket", state.bucket(table))
        if full:
            old = state.read(table, full, self.before).withColumn("bucket", state.bucket(table))
            named = named.unionByName(old)
        touched = self._write(table, named.repartition("bucket"))
        self._switch(table, [b for b in touched if b not in full], append=True)
        self._switch(table, full, append=False)

    def fold(self, table: str, rows: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
        """Merge rows into the buckets that they touch; ``merge`` folds rows of any ages to one per key.

        Returns the new rows of these buckets and the old ones (None if there are none).
        """
        state = self.state
        touched = [r.b for r in rows.select(state.bucket(table).alias("b")).distinct().collect()]
        old = state.read(table, touched, self.before)
        both = rows if old is None else rows.unionByName(old)
        merged = merge(both.withColumn("bucket", state.bucket(table)).repartition("bucket"))
        written = self._write(table, merged.withColumn("bucket", state.bucket(table)))
        self._switch(table, written, append=False)
        new = state._open([f"{state.root}/{table}/version={self.id}/bucket={b}" for b in written], self.next["schemas"][table])
        return new, old


def upsert_changed(state: KeyedState, table: str) -> Callable[[DataFrame, int], None]:
    """A sink for streaming aggregations in update mode: the groups that a batch changed replace their older rows."""
    def latest(rows: DataFrame) -> DataFrame:
        key = state.keys[table]
        values = [c for c in rows.columns if c not in (*key, "bucket", "batch")]
        return rows.groupBy("bucket", *key).agg(F.max_by(F.struct(*values, "batch"), "batch").alias("row")).select(*key, "row.*")

    def handle(changed: DataFrame, batch_id: int) -> None:
        with state.batch(batch_id) as batch:
            if batch:
                batch.fold(table, changed.withColumn("batch", F.lit(batch_id).cast("long")), latest)
    return handle
