"""Connected components of a large edge table, by alternating large-star and small-star steps.

Every join is between two written tables on a plain key, so that a hub with a third of all edges is a skewed join that
Spark splits at run time, and no step depends on an executor that may be lost. Nothing but two checksums reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratapoint.runtime import Scratch


#: Up to so many edges (16 bytes each) are joined by one task: a join of joins costs more than it spreads.
ONE_TASK_EDGES = 100_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            up[max(u, v)] = min(u, v)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def components(scratch: Scratch, edges: DataFrame, name: str, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """edges(a, b: long) -> node, root for every node of an edge, root being the smallest node of its component.

    The number of edges is checked first; few enough go through one task, any more through the steps above.
    """
    cur = scratch.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    if cur.count() <= one_task:
        return scratch.table(cur.coalesce(1).mapInArrow(_union_find, "node long, root long"), f"{name}-roots")
    step, seen = 0, None
    while True:
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, step = now, step + 1
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-{step}a")
        # An edge (u > v) becomes (u, least neighbour of v).
        large = scratch.table(cur.join(least.select(F.col("u").alias("v"), "m"), "v").select("u", F.col("m").alias("v")).distinct(), f"{name}-{step}b")
        least = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-{step}c")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        cur = scratch.table(small.where("u <> v").distinct(), f"{name}-{step}")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
