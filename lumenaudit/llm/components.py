"""Connected components of an edge table, by repeated minimum over neighbours with pointer jumping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the edges at hand, for nodes that are not the smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = ends[: len(a)], ends[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def connected_components(edges: DataFrame, tag: str) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b: long, both ways implied).

    Each partition first shrinks its edges to a forest. Then every node takes the smallest label among its own and its neighbours', and the
    label of that label, until nothing changes; each round is written, so that a lost executor costs one round at most.
    """

    def shrink(it):
        for pdf in it:
            n, r = forest(pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64))
            yield pd.DataFrame({"a": n, "b": r})

    # Each way once; a loop keeps a node in its own neighbourhood.
    small = materialize(edges.select("a", "b").where(F.col("a") != F.col("b")).mapInPandas(shrink, "a long, b long").distinct(), f"{tag}-edges")
    both = small.unionAll(small.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), f"{tag}-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("j_node"), F.col("component").alias("j_component"))
        new = materialize(
            stepped.join(jump, F.col("next") == F.col("j_node")).select("node", F.col("component").alias("was"), F.least("next", "j_component").alias("component")),
            f"{tag}-labels",
        )
        changed = new.where(F.col("was") != F.col("component")).limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(small)
            out = labels.select("node", "component")
            out._scratch = labels._scratch
            return out
