"""Connected components of link tables, and all-pairs work inside groups cut into bounded tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from feedfold.llm.common import spread_join
from feedfold.session import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    Alternates large-star and small-star steps until every node links to its root only. A hub's neighbours are
    never gathered: minima are partial aggregates, and hot hubs are joined through a broadcast.
    """
    def store(rows: DataFrame) -> tuple[DataFrame, dict]:
        seen = Observation()
        rows = rows.filter("u != v").distinct().observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("mark"))
        return written(rows, "links"), seen.get

    edges, mark = store(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = written(spread_join(both, written(least, "minima"), ["u"], "n").filter("v > u")
                        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "minima")
        moved = spread_join(large, least, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, now = store(moved.unionByName(least.select("u", F.col("m").alias("v"))))
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def pair_tasks(members: DataFrame, group: str, member: str, weight: Column, per_task: int) -> DataFrame:
    """Deal the members of groups to tasks so that every pair within a group meets in one task.

    Groups of up to ``per_task`` total weight share tasks. A heavier group is cut into k blocks and gets a task for each
    two of them (k copies of a row, not one per pair). Adds ``task``, ``block`` and ``other``: in a task with block != other only
    pairs across the two blocks count. Call with a stored table.
    """
    sizes = members.groupBy(group).agg(F.sum(weight).alias("_w"), F.count(F.lit(1)).alias("_n"))
    blocks = F.least(F.ceil(F.col("_w") / per_task), F.col("_n")).cast("int")
    sizes = written(sizes.withColumn("_k", F.greatest(F.lit(1), blocks)), "group-sizes")
    total = sizes.agg(F.sum("_w")).first()[0] or 0
    shared = max(1, int(total * 2) // per_task)
    rows = spread_join(members, sizes, [group], "_n")
    rows = rows.withColumn("_own", F.pmod(F.xxhash64(member), F.col("_k")).cast("int"))
    rows = rows.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    block, other = F.least("_own", "_with"), F.greatest("_own", "_with")
    task = (F.when(F.col("_k") == 1, F.pmod(F.xxhash64(group), F.lit(shared)))
            .otherwise(F.xxhash64(group, block, other) % F.lit(1 << 62) - F.lit(1 << 62)))
    return (rows.withColumn("task", task).withColumn("block", block).withColumn("other", other)
            .withColumn("own", F.col("_own")).drop("_w", "_n", "_k", "_own", "_with"))


def local_roots(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest number in the component of each of 0..size-1, given links between them."""
    root = np.arange(size)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        if (root == before).all():
            break
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up
