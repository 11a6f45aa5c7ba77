"""Connected components: by alternating large and small stars (Kiveris et al. 2014) until what is left fits one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import checkpoint, forget, tidy

#: Edges that one task joins at most (about 100 bytes each there); more go through rounds of stars.
ALONE = 1 << 20


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours move to the least of its neighbourhood; edges are (u, v) with u > v."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node of each one's component) of the edges (u, v)."""
    names, number = np.unique(np.concatenate([u, v]), return_inverse=True)
    up, a, b = np.arange(len(names)), number[: len(u)], number[len(u) :]
    while len(a):
        np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))  # roots move to lesser roots
        while True:
            over = up[up]
            if np.array_equal(over, up):
                break
            up = over
        a, b = up[a], up[b]
        a, b = a[a != b], b[a != b]
    return names, names[up]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(np.asarray(x.column("u")), np.asarray(x.column("v"))) for x in batches]
    if got:
        nodes, least = joined(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, alone: int = ALONE) -> DataFrame:
    """(node, component) of all nodes with an edge; a component's name is its least node.

    At most ``alone`` edges are joined in one task, without a round.  A round is a few joins on nodes
    whose rows shrink to one edge a node; lineage is
    cut by checkpoint() after each, and the files of the round before are removed.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    edges = checkpoint(edges)
    state = None
    for _ in range(max_rounds):
        now = tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first())
        if now[0] <= alone:
            return edges.coalesce(1).mapInArrow(tidy(_joined), "node long, component long").repartition("node")  # of bounded rows
        if now == state:
            break
        state = now
        before, edges = edges, checkpoint(_stars(_stars(edges, True), False))
        forget(before)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct().toDF("node", "component"))
