"""Connected components of a graph of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import written

#: Links that one task contracts, about 50 MB with their nodes.
TASK_LINKS = 500_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) by rounds of least labels and pointer jumping on arrays."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        apart = low < high
        x, y = x[apart], y[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _contracted(links: DataFrame) -> DataFrame:
    """(node, label): the components of each task's links by themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            nodes, label = least_labels(*(np.concatenate(p) for p in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], names=["node", "label"])

    return links.mapInArrow(run, "node long, label long")


def components(links: DataFrame, a: str = "a", b: str = "b", task_links: int = TASK_LINKS) -> DataFrame:
    """(node, label) of every node in `links`; label is the least node that links reach.

    Links are dealt to tasks of about `task_links` each, which contract theirs
    to stars. These are joined then: each round a node takes the least label
    among its own and its neighbours', and the label of that label's node,
    which halves what is left of long paths, until nothing changes. Rounds
    are written to the shared folder. Links between a node and itself, twice
    told links and links in either direction are the same as one; no links
    give no nodes.
    """
    once = written(links.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct(), "links")
    tasks = max(1, -(-once.count() // task_links))
    stars = written(_contracted(once.repartition(tasks, "x")), "stars")
    both = written(stars.select(F.col("node").alias("x"), F.col("label").alias("y")).union(stars.select("label", "node")).distinct(), "links")
    labels = written(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels, both.y == labels.node).groupBy("x").agg(F.min("label").alias("near"))
        taken = labels.join(near, labels.node == near.x).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        of = taken.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = written(taken.join(of, taken.label == of._n).select("node", F.col("_l").alias("label"), (F.col("_l") != F.col("was")).alias("moved")), "labels")
        labels = jumped.select("node", "label")
        if not jumped.where("moved").limit(1).count():
            return labels
