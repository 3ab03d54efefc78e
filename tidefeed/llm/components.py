"""Connected components of an edge list: tasks contract the edges they hold, then large and small stars alternate; nothing but
counts reaches the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, total: int, own: bool, pick, name: str) -> DataFrame:
    """pick(edges with m, the least neighbour of a; a itself included if own), written; a hub's edges meet their row by broadcast."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n"))
    if own:
        least = least.withColumn("m", F.least("a", "m"))
    least = least.persist()
    out = common.written(pick(common.join_groups(edges, least, "a", "_n", total)).where("a <> b").distinct(), name)
    least.unpersist()
    return out


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), in order, and the least node that each reaches: roots hook to lesser ones, paths are halved."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        if not open_.any():
            return nodes, nodes[root]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]


def _contracted(batches):
    """A task's edges to stars around the least node of each of its components: at most one row a node."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    if held:
        nodes, least = least_reachable(*(np.concatenate(c) for c in zip(*held)))
        far = nodes != least
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(least[far])], names=["a", "b"])


def connected(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """edges (a, b: long) to (node, root: the smallest node reachable), for nodes of edges with a <> b only.

    Edges are dealt to tasks of at most some `most`, each of which returns its components as stars; they are done if there was one.
    """
    edges = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    parts = max(1, -(-edges.count() // most))
    edges = common.written(edges.coalesce(parts).mapInArrow(_contracted, "a long, b long"), "stars")
    if parts > 1:
        edges = _joined_stars(edges.distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _joined_stars(edges: DataFrame) -> DataFrame:
    """edges with a > b to one star for each component, by alternating large and small stars."""
    edges = common.written(edges, "edges")
    total, state = edges.count(), None
    pair = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
    while total:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both, 2 * total, True, lambda j: j.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        edges = _star(large, total, False, lambda j: j.select(pair).select("e.*"), "small")
        now = tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())
        if now == state:
            break
        state, total = now, now[0]
    return edges
