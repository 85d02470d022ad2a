"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import native
from .store import Scratch

#: About the most edges that a task holds at once.
HELD = 1 << 20


def contracted(edges: DataFrame) -> DataFrame:
    """u, v: the edges of ``edges`` (two of long) as each task's nodes with the least node that its edges reach, themselves left out.

    Edges of a task are taken in turns of about HELD, so that its memory is bounded; nodes that
    edges of several turns or tasks share stay for others to join.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in (0, 1)])
            n += batch.num_rows
            if n >= HELD:
                yield _stars(held)
                held, n = [], 0
        if n:
            yield _stars(held)

    return edges.mapInArrow(rows, "u long, v long")


def _stars(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    """Each node with the least that it reaches: labels run along the edges, each halving its way to the least, until none changes."""
    a, b = (np.concatenate(x) for x in zip(*held))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    out = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.record_batch([pa.array(nodes[out]), pa.array(nodes[root[out]])], ["u", "v"])


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (least node reachable) of every node of edges a, b (long).

    Each task contracts its own edges first, which settles what lies in one task at once.
    Alternates large-star and small-star steps: each step points a node's neighbours at its
    least neighbour, so the diameter halves about every round. Nodes of the most neighbours
    are joined by broadcast of their least neighbour, so that no hub's edges meet in one task;
    towards lesser neighbours there are no hubs. The other joins are not left to broadcasts,
    as the driver would hold one for each round.
    Ends when every node has one lesser neighbour, which has none. Each round's table takes
    the place of the one before.
    """
    pairs = scratch.written(contracted(edges.select("a", "b")).distinct())
    while not _settled(pairs):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = native.join_split(both, least, "u", "n").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, pairs = pairs, scratch.written(small)
        scratch.drop(before)
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _settled(pairs: DataFrame) -> bool:
    """Whether every node has one lesser neighbour, which has none: asked of all nodes at once, as nodes and as neighbours."""
    ends = pairs.select("u", F.lit(1).alias("lesser"), F.lit(0).alias("greater")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(0).alias("lesser"), F.lit(1).alias("greater")))
    each = ends.groupBy("u").agg(F.sum("lesser").alias("lesser"), F.max("greater").alias("greater"))
    return each.filter("lesser > 1 OR lesser > 0 AND greater > 0").isEmpty()
