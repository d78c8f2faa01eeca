"""Connected components by contraction; nothing is gathered on the driver but counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import forget, stored

#: So many links or fewer are labelled by one task, in some hundred kB; more are contracted first.
FEW = 1 << 14


def rooted(parents: DataFrame) -> DataFrame:
    """node, label: the root of each node of a stored forest parents(node, label), by pointer doubling."""
    while True:
        above = parents.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = stored(parents.join(above, "label").select("node", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")), "parents")
        forget(parents)
        parents = jumped
        if not jumped.where("moved").limit(1).count():
            return parents


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links (a, b), and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        for end in (label[x], label[y]):
            np.minimum.at(label, end, low)
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    none = np.zeros(0, np.int64)
    node, label = smallest(*(np.concatenate([none, *(h[k] for h in held)]) for k in (0, 1)))
    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(label, pa.int64())], ["node", "label"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """node, label (the smallest node reachable) of every end of edges(a long, b long).

    Repeated edges, either direction and loops are fine; rows with a null end are left out. In each round
    every node joins the smallest of its neighbours, the trees that this makes become one node each, and
    only links between different ones go on: nodes that have links are halved at least. The last `few` links
    are one task's. Rounds are stored, so none is computed again.
    """
    known = edges.where("a IS NOT NULL AND b IS NOT NULL")
    links = stored(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds = []
    while (left := links.count()) > few:
        ends = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label"))
        parents = rooted(stored(parents, "parents"))
        rounds.append(parents)
        tops = parents.select("node", "label")
        apart = links.join(tops.toDF("a", "la"), "a").join(tops.toDF("b", "lb"), "b").where("la <> lb")
        rest = stored(apart.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "links")
        forget(links)
        links = rest
    if left or not rounds:
        rounds.append(stored(links.coalesce(1).mapInArrow(_labelled, "node long, label long"), "few"))
    forget(links)
    labels = rounds.pop().select("node", "label")
    while rounds:
        labels = rounds.pop().select("node", "label").join(labels.toDF("label", "further"), "label", "left").select("node", F.coalesce("further", "label").alias("label"))
    return labels
