"""Connected components by repeated contraction of a graph's edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``edges`` (``a, b bigint``).

    Each round maps a node to the smallest of itself and its neighbours and
    keeps the edges between different images, so every round at least halves
    the nodes that still have edges.  Rounds are written to the shared folder;
    the driver only counts the edges left.  Self-loops, repeated edges and an
    empty table are fine; rows with a null end are ignored.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        image = stored(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), "images")
        if label is None:
            label = image.withColumnRenamed("to", "component")
        else:
            label = label.alias("l").join(image.alias("i"), F.col("l.component") == F.col("i.node"), "left").select("l.node", F.coalesce("i.to", "l.component").alias("component"))
        label = stored(label, "labels")
        left = stored(
            left.join(image.select(F.col("node").alias("a"), F.col("to").alias("c")), "a")
            .join(image.select(F.col("node").alias("b"), F.col("to").alias("d")), "b")
            .where("c <> d").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).distinct(), "edges")
    return label if label is not None else left.select(F.col("a").alias("node"), F.col("b").alias("component"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node reachable) that connect what the links ``a[i] - b[i]`` connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = np.minimum(new, new[new])
        if np.array_equal(new, low):
            break
        low = new
    away = low != np.arange(len(nodes))
    return nodes[away], nodes[low[away]]
