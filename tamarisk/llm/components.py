"""Connected components.

Up to ``ONE_TASK`` links are joined by a union-find in one executor task, whose memory that number
bounds. More are joined by alternating large-star and small-star steps, with the same result.

Every step is a grouped minimum and a join on a node, both of which Spark can split for a node
of very high degree; no neighbour list is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Links (16 bytes each) that one task may hold.
ONE_TASK = 1_000_000


def _stars(edges: DataFrame, both: DataFrame, larger: bool) -> DataFrame:
    """Links each node's neighbours (only its larger, or only its smaller ones) with the least of them all."""
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    linked = both.join(least, "u")
    if larger:
        return linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    down = linked.where("v < u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return down.unionByName(own).where("a <> b")


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking positions a and b; a label is the least position of its component."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nxt := label[label], label):
            label = nxt


def _in_one_task(batches):
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held)
        nodes, place = np.unique(np.concatenate((t.column("a").to_numpy(), t.column("b").to_numpy())), return_inverse=True)
        label = merge(np.arange(len(nodes)), place[: t.num_rows], place[t.num_rows :])
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def connected_components(edges: DataFrame, rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """``edges``: columns a, b (long, not null). Result: node, root, where root is the component's
    least node; a root is in the result too.

    Nodes without an edge to another node are not in the result. Repeated edges and loops are
    allowed. The number of rounds grows with the logarithm of the longest path; running out of
    rounds is an error, never a partial result.
    """
    edges = materialise(edges.where("a <> b").select("a", "b"), "links")
    if edges.count() <= one_task:
        return materialise(edges.coalesce(1).mapInArrow(_in_one_task, "node long, root long"), "components")
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = materialise(_stars(now, both, True), "large")
        small = materialise(
            _stars(large, large.select(F.col("a").alias("u"), F.col("b").alias("v")), False).distinct(), "small"
        )
        discard(now)
        discard(large)
        now, before = small, state
        state = _state(now)
        if state == before:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
