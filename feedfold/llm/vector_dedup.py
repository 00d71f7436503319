"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits the vectors recursively at the middle of a random projection; rows near the middle go to both sides
(spill). The first splits use quantiles of a bounded sample, oversize cells are split again by distributed quantiles, and a cell that fits a task is split to
leaves there. Pairs within a leaf are compared, links of all trees are united, and all pairs of a component are verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedfold.llm.common import identified, slices, spread_join
from feedfold.llm.graph import components, local_roots, pair_tasks
from feedfold.session import written

COSINE = 0.95
TREES = 8
# Share of a cell's rows that go to both sides of a split.
SPILL = 0.15
# Rows up to which a cell is split and compared inside one task, and rows of a leaf.
CELL = 8192
LEAF = 1024
# Vectors in the sample that places the first splits, and the most levels placed by it.
SAMPLE = 20_000
SAMPLED_LEVELS = 8
SEED = 23
VECTORS_PER_TASK = 2048


def unit_rows(parts: list[bytes], dim: int) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    x = np.frombuffer(b"".join(parts), "<f8").reshape(len(parts), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _direction(cell: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, cell & ((1 << 63) - 1), dim]).standard_normal(dim)


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of doubles; those that are null, zero or not finite throughout are left out."""
    for batch in slices(batches, "vector", 1 << 18):
        keys, out, dims = [], [], []
        for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not value.is_valid or value.values.null_count:
                continue
            x = value.values.to_numpy(zero_copy_only=False).astype("<f8")
            if len(x) and np.isfinite(x).all() and x.any():
                keys.append(key)
                out.append((x + 0.0).tobytes())
                dims.append(len(x))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())],
                                             ["row_key", "dim", "vector"])


def _halves(values: np.ndarray, low, high) -> tuple[np.ndarray, np.ndarray]:
    return values <= high, values >= low


def _child(cell: int, side: int) -> int:
    """Number of a child cell: the parent's, mixed with the side."""
    x = (cell * 2 + side + 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
    return (x ^ (x >> 27)) & ((1 << 63) - 1)


def _sampled_splits(vectors: DataFrame, dim: int, n: int) -> dict[int, tuple[float, float]]:
    """Where the first cells split, from the quantiles of a bounded sample."""
    levels = min(SAMPLED_LEVELS, max(0, math.ceil(math.log2(max(1, n / CELL)))))
    if not levels:
        return {}
    sample = vectors.filter(F.col("dim") == dim).orderBy(F.xxhash64("rep")).limit(SAMPLE).select("vector").toPandas()
    x, splits = unit_rows([bytes(v) for v in sample.vector], dim), {}
    cells = [(tree, np.arange(len(x))) for tree in range(TREES)]
    for _ in range(levels):
        below = []
        for cell, rows in cells:
            if len(rows) < 8:
                continue
            value = x[rows] @ _direction(cell, dim)
            low, high = np.quantile(value, [0.5 - SPILL / 2, 0.5 + SPILL / 2])
            splits[cell] = (float(low), float(high))
            below += [(_child(cell, side), rows[half]) for side, half in enumerate(_halves(value, low, high))]
        cells = below
    return splits


def _plant(splits: dict[int, tuple[float, float]], dim: int):
    """Send every vector down the sampled part of every tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "vector", 1 << 20):
            x = unit_rows(batch.column(1).to_pylist(), dim)
            todo, cells, rows = [(tree, np.arange(len(x))) for tree in range(TREES)], [], []
            while todo:
                cell, at = todo.pop()
                if cell in splits and len(at):
                    value = x[at] @ _direction(cell, dim)
                    todo += [(_child(cell, side), at[half]) for side, half in enumerate(_halves(value, *splits[cell]))]
                else:
                    cells.append(np.full(len(at), cell))
                    rows.append(at)
            order = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), *(c.take(order) for c in batch.columns)],
                                             ["cell", "rep", "vector"])
    return run


def _projected(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "vector", 1 << 20):
            x, cell = unit_rows(batch.column(2).to_pylist(), dim), batch.column(0).to_numpy()
            value = np.empty(len(x))
            for one in np.unique(cell):
                value[cell == one] = x[cell == one] @ _direction(int(one), dim)
            sides = [pa.array([_child(int(c), side) for c in cell], pa.int64()) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), *sides],
                                             ["cell", "rep", "vector", "value", "first", "second"])
    return run


def _linked(x: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of unit rows at least that similar, a block of rows at a time."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, len(x), 512):
        i, j = np.nonzero(x[start:start + 512] @ x[start:].T >= cosine)
        ahead = j > i
        left.append(i[ahead] + start)
        right.append(j[ahead] + start)
    return np.concatenate(left), np.concatenate(right)


def _grow(dim: int, cosine: float):
    """Split each cell of a task to leaves, compare within them and link what is similar."""
    def run(members: pa.Table) -> pa.Table:
        members = members.sort_by([("cell", "ascending"), ("rep", "ascending")])
        cell, rep, own = (members.column(c).to_numpy() for c in ("cell", "rep", "own"))
        across = members.column("block").to_numpy() != members.column("other").to_numpy()
        x = unit_rows(members.column("vector").to_pylist(), dim)
        cuts = np.nonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))[0]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            todo = [(int(cell[a]), np.arange(a, b))]
            while todo:
                one, rows = todo.pop()
                if len(rows) > LEAF and not across[a]:
                    value = x[rows] @ _direction(one, dim)
                    halves = _halves(value, *np.quantile(value, [0.5 - SPILL / 2, 0.5 + SPILL / 2]))
                    if max(h.sum() for h in halves) < 0.8 * len(rows):
                        todo += [(_child(one, side), rows[half]) for side, half in enumerate(halves)]
                        continue
                i, j = _linked(x[rows], cosine)
                if across[a]:
                    far = own[rows[i]] != own[rows[j]]
                    i, j = i[far], j[far]
                left.append(rows[i])
                right.append(rows[j])
        root = local_roots(len(rep), np.concatenate(left), np.concatenate(right))
        some = np.nonzero(root != np.arange(len(rep)))[0]
        return pa.table({"rep": pa.array(rep[some]), "root": pa.array(rep[root[some]])}).group_by(["rep", "root"]).aggregate([])
    return run


def forest_links(vectors: DataFrame, dim: int, n: int, cosine: float = COSINE) -> DataFrame:
    """Links (rep, root) that join vectors of one length that are similar and share a leaf of some tree."""
    vectors = vectors.filter(F.col("dim") == dim)
    splits = _sampled_splits(vectors, dim, n)
    schema = "cell long, rep long, vector binary"
    cells, done = written(vectors.select("rep", "vector").mapInArrow(_plant(splits, dim), schema), "cells"), []
    while True:
        sizes = written(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell-sizes")
        large = sizes.filter(F.col("n") > 2 * CELL)
        if large.isEmpty():
            done.append(cells)
            break
        done.append(spread_join(cells, sizes.filter(F.col("n") <= 2 * CELL), ["cell"], "n").drop("n"))
        wide = written(spread_join(cells, large, ["cell"], "n").drop("n").mapInArrow(
            _projected(dim), schema + ", value double, first long, second long"), "projected")
        marks = F.percentile_approx("value", [0.5 - SPILL / 2, 0.5 + SPILL / 2], 1000)
        places = wide.groupBy("cell").agg(marks.alias("q"), F.count(F.lit(1)).alias("n"))
        wide = spread_join(wide, written(places, "quantiles"), ["cell"], "n")
        lower, upper = F.col("value") <= F.col("q")[1], F.col("value") >= F.col("q")[0]
        share = written(wide.groupBy("cell").agg(F.max("n").alias("n"), F.greatest(
            F.count(F.when(lower, 1)), F.count(F.when(upper, 1))).alias("most")), "halves")
        stuck = share.filter(F.col("most") >= 0.8 * F.col("n")).select("cell", "n")
        done.append(spread_join(cells, written(stuck, "stuck"), ["cell"], "n").drop("n"))
        moving = wide.join(share.filter(F.col("most") < 0.8 * F.col("n")).select("cell"), "cell", "left_semi")
        sides = F.explode(F.filter(F.array(F.when(lower, F.col("first")), F.when(upper, F.col("second"))), lambda c: c.isNotNull()))
        cells = written(moving.select(sides.alias("cell"), "rep", "vector"), "cells")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    tasks = pair_tasks(every if len(done) == 1 else written(every, "all-cells"), "cell", "rep", F.lit(1), 2 * CELL)
    return tasks.groupBy("task").applyInArrow(_grow(dim, cosine), "rep long, root long").distinct()


def _counted(cosine: float):
    """All pairs of the components in a task: per vector the copies linked to it."""
    def run(members: pa.Table) -> pa.Table:
        members = members.sort_by([("component", "ascending"), ("rep", "ascending")])
        comp, rep, own, copies = (members.column(c).to_numpy() for c in ("component", "rep", "own", "copies"))
        across = members.column("block").to_numpy() != members.column("other").to_numpy()
        parts, linked = members.column("vector").to_pylist(), np.zeros(len(rep), np.int64)
        cuts = np.nonzero(np.concatenate([[True], comp[1:] != comp[:-1], [True]]))[0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            i, j = _linked(unit_rows(parts[a:b], len(parts[a]) // 8), cosine)
            i, j = i + a, j + a
            if across[a]:
                far = own[i] != own[j]
                i, j = i[far], j[far]
            np.add.at(linked, i, copies[j])
            np.add.at(linked, j, copies[i])
        some = np.nonzero(linked)[0]
        return pa.table({"rep": pa.array(rep[some]), "linked": pa.array(linked[some])})
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Rows link if the cosine of their vectors, in double precision, is at least ``cosine``. n_links counts the other rows linked directly;
    component_id is the smallest id reached by links (null ids are smallest). Equal vectors are indexed once and counted as often as they occur.
    Vectors that are null, empty, zero or have a null or non-finite component, and vectors of different lengths, do not
    link. Rows that agree in id and vector link with each other and are all kept or not. An empty table gives an empty result; other columns are not
    read.
    """
    rows = identified(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")), "vec_id", "vector")
    usable = written(rows.select("row_key", F.col("vector").cast("array<double>").alias("vector"))
                     .mapInArrow(_usable, "row_key long, dim int, vector binary"), "vectors")
    classes = written(usable.groupBy("vector").agg(F.min("row_key").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    reps = written(classes.select("rep", "copies", F.floor(F.octet_length("vector") / 8).cast("int").alias("dim"), "vector"), "representatives")
    links = None
    for row in reps.groupBy("dim").count().collect():
        found = forest_links(reps, row.dim, row["count"], cosine)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    groups = written(components(links, "rep", "root").withColumnRenamed("node", "rep"), "groups")
    members = written(groups.join(reps, "rep"), "group-vectors")
    tasks = pair_tasks(members, "component", "rep", F.lit(1), VECTORS_PER_TASK)
    linked = (tasks.groupBy("task").applyInArrow(_counted(cosine), "rep long, linked long")
              .groupBy("rep").agg(F.sum("linked").alias("linked")))
    owners = rows.select(F.col("row_key").alias("key"), F.col("vec_id").alias("component_id")).distinct()
    judged = (classes.join(linked, "rep", "left").join(groups, "rep", "left").withColumn("key", F.coalesce("component", "rep"))
              .join(owners, "key")
              .select("vector", "copies", "key", "component_id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    by_row = spread_join(usable, written(judged, "judged"), ["vector"], "copies")
    by_row = by_row.select("row_key", "key", "component_id", "n_links").dropDuplicates(["row_key"])
    return rows.select("row_key", "vec_id").join(by_row, "row_key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        (F.col("key").isNull() | (F.col("key") == F.col("row_key"))).alias("kept"))
