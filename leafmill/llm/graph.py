"""Connected components by contraction, with the edges in tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_salted, materialize, release


#: Up to so many nodes (16 bytes each) are broadcast to relabel others; more are joined by shuffling.
BROADCAST_NODES = 500_000
#: Up to so many edges (16 bytes each) are joined up on the driver.
DRIVER_EDGES = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the component's smallest node.

    Every round each node hooks to its smallest neighbour, hooks are followed to their ends
    by doubling, and the edges are relabelled, so that they shrink quickly; a star takes
    one round.  The edges of a node of many are dealt to several tasks.  Few edges are
    joined up on the driver.
    """
    if edges.count() <= min(DRIVER_EDGES, BROADCAST_NODES):
        some = edges.select("a", "b").toArrow()
        node, root = _joined_up(some["a"].to_numpy(), some["b"].to_numpy())
        found = pa.table({"node": pa.array(node, pa.int64()), "root": pa.array(root, pa.int64())})
        return materialize(edges.sparkSession.createDataFrame(found), "labels")
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both(edges.filter("a <> b")).distinct(), "edges")
    labels: DataFrame | None = None
    while n := edges.count():
        hook = edges.groupBy("a").agg(F.min("b").alias("p"), F.count("*").alias("c")).select("a", F.least("a", "p").alias("p"), "c")
        hook = _followed(materialize(hook, "hooks"))
        own = hook.select(F.col("a").alias("node"), F.col("p").alias("root"))
        if labels is None:
            labels = materialize(own, "labels")
        else:
            moved = own.select(F.col("node").alias("root"), F.col("root").alias("r")).filter("root <> r")
            new = materialize(_relabelled(labels, moved, "root", "r"), "labels")
            release(labels)
            labels = new
        # an edge is there in both directions, so a node is as often an end as a start
        ends = lambda x, y: hook.select(F.col("a").alias(x), F.col("p").alias(y), "c")
        if hook.count() <= BROADCAST_NODES:
            moved = edges.join(F.broadcast(ends("a", "p").drop("c")), "a").join(F.broadcast(ends("b", "q").drop("c")), "b")
        else:
            moved = join_salted(edges, ends("a", "p"), ["a"], "c", n, ["b"])
            moved = join_salted(moved, ends("b", "q"), ["b"], "c", n, ["p"])
        moved = moved.select(F.col("p").alias("a"), F.col("q").alias("b"))
        left = materialize(moved.filter("a <> b").distinct(), "edges")
        release(edges, hook)
        edges = left
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    release(edges)
    return labels


def _joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges between different nodes, and the smallest node of each one's component."""
    a, b = a[a != b], b[a != b]
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, up = places[: len(a)], places[len(a) :], np.arange(len(nodes))
    while len(x):
        # each root hooks to the smallest that an edge shows it, so that roots only get smaller
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(up, hi, lo)
        while (up[up] != up).any():
            up = up[up]
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[up]


def _relabelled(rows: DataFrame, moved: DataFrame, old: str, new: str) -> DataFrame:
    """``rows`` with the values of ``old`` that ``moved`` (old, new) holds replaced."""
    moved = F.broadcast(moved) if moved.count() <= BROADCAST_NODES else moved
    return rows.join(moved, old, "left").withColumn(old, F.coalesce(new, old)).select(*rows.columns)


def _followed(hook: DataFrame) -> DataFrame:
    """``hook`` (a, p, c), materialized, with every p an end of hooks.

    Only the parents are looked up, each once, and only those that have parents of their
    own move; in stars there are none.
    """
    while True:
        up = hook.filter("a <> p").select(F.col("a").alias("p"), F.col("p").alias("q"))
        moving = materialize(hook.select("p").distinct().join(up, "p"), "moving")
        if moving.isEmpty():
            release(moving)
            return hook
        nxt = materialize(_relabelled(hook, moving, "p", "q"), "hooks")
        release(hook, moving)
        hook = nxt
