"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import join_hot, shared

#: Edges of a task, at least: few edges are not spread over all of the session's shuffle partitions.
TASK_EDGES = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes but the roots, by union-find over all edges."""
    some = [np.empty((2, 0), np.int64), *(np.stack([b.column(c).to_numpy() for c in ("u", "v")]) for b in batches)]
    nodes, places = np.unique(np.concatenate(some, 1), return_inverse=True)
    top = list(range(len(nodes)))
    for a, b in places.reshape(2, -1).T.tolist():
        while top[a] != a:
            top[a] = a = top[top[a]]
        while top[b] != b:
            top[b] = b = top[top[b]]
        # places are in the order of the nodes, so that the least one stays on top
        top[max(a, b)] = min(a, b)
    root = np.array(top, np.int64)
    while (root[root] != root).any():
        root = root[root]
    under = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[under]), pa.array(nodes[root[under]])], ["node", "root"])


def components(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """(node, root) for each node of the edges (u, v): root is the least node that can be reached.

    Nodes are longs; roots themselves may be left out.  Up to ``at_once`` edges are counted and joined by one task, which costs the driver
    two jobs; more are joined in rounds, each of which costs it some twelve.  Each round keeps as many edges as there are nodes outside the roots, at most; it groups by node with
    partial minima, and is written to the shared checkpoint folder.  Edges with a null end and loops are ignored.
    """
    if at_once:
        edges = shared(edges.where("u <> v").select("u", "v"))
        if edges.count() <= at_once:
            return shared(edges.coalesce(1).mapInArrow(_at_once, "node long, root long"))
    edges = shared(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        tasks = 4 + state[0] // TASK_EDGES
        edges = edges.coalesce(tasks)
        # large star: each larger neighbour of a node points at the least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = shared(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")).coalesce(tasks))
        large = join_hot(edges.select(F.col("v").alias("u"), F.col("u").alias("w")), least.coalesce(tasks), "u", "n", 2 * state[0])
        large = shared(large.select(F.col("w").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks))
        # small star: a node and its smaller neighbours point at the least of them
        least = shared(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).coalesce(tasks))
        moved = join_hot(large, least, "u", "n", state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = shared(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(tasks))
        if (now := _state(edges)) == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
