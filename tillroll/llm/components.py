"""Connected components of a link table: union-find within partitions, then star contraction across them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import cut_lineage, release


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for every node of the edges that isn't that smallest node."""
    nodes, idx = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = len(a)
    for x, y in zip(idx[:n].tolist(), idx[n:].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            if x < y:
                parent[y] = x
            else:
                parent[x] = y
    roots = np.fromiter((root(x) for x in range(len(nodes))), dtype=np.int64, count=len(nodes))
    moved = roots != np.arange(len(nodes))
    return nodes[moved], nodes[roots[moved]]


def _local_forest(batches):
    for batch in batches:
        if batch.num_rows:
            u, v = union_find(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every linked node ``u`` but the smallest of its component, and that smallest node ``v``.

    ``edges`` has columns u, v (long). Each Arrow batch of edges is first
    reduced to a forest by union-find; what remains is contracted by large-star
    and small-star rounds until the edges stay the same (about log n rounds).
    Every round is a partial aggregation and a join on the node, so a hub with
    any number of links is no task of its own, and is written, so a lost
    executor repeats one round.
    """
    now = cut_lineage(edges.where("u <> v").mapInArrow(_local_forest, "u long, v long").where("u <> v"))
    while not _is_forest_of_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"))
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(lower.select("u", F.col("m").alias("v"))).distinct())
        after = cut_lineage(small)
        release(now)
        now = after
    return now


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to its smaller end, and no such end has one itself.

    Large-star and small-star rounds end in this form. One aggregation by node
    tells it: no node may start two edges, or both start and end one.
    """
    roles = edges.select("u", F.lit(True).alias("start")).union(edges.select(F.col("v"), F.lit(False)))
    bad = roles.groupBy("u").agg(F.count_if("start").alias("starts"), F.count_if(~F.col("start")).alias("ends"))
    return bad.where("starts > 1 or (starts > 0 and ends > 0)").isEmpty()
