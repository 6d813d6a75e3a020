"""Connected components by contraction and pointer jumping; each round is a stashed table.

A round deals edges out by their larger node, joins what is connected inside a task to the smallest node there, and then lets every node
point to what its parent points to. The state is stable once every node points to its component's smallest node. Many edges into one node
meet in no task: the contraction deals by the other end, and the jump is a plain join, which Spark splits where a key is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges -> (node, smallest connected node) for all nodes that are not smallest themselves."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        u, v = contract(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.record_batch({"u": pa.array(u), "v": pa.array(v)})


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long) -> node, comp: the smallest node that it reaches; nodes without an edge do not appear.

    Loops and repeated edges are allowed. The result is a stashed table.
    """
    now, state = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None
    while True:
        star = now.repartition("u").mapInArrow(_local, "u long, v long")
        parent = star.groupBy(F.col("u").alias("p")).agg(F.min("v").alias("pv"))
        jumped = stash(star.join(parent, star["v"] == parent["p"], "left").select("u", F.coalesce("pv", "v").alias("v")), "edges")
        then, state = state, tuple(jumped.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        unstash(now)
        now = jumped
        if state == then or not state[0]:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
