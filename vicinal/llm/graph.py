"""Connected components of an undirected edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Up to this many edges (16 MB) one executor task closes them all; beyond it, rounds over the cluster do.
LOCAL_EDGES = 1_000_000


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) for each id in ``edges(a, b)``; component is the least id reachable.

    Self-loops and repeated edges are harmless; an empty edge table gives no rows. Both ways give the same rows; only a
    count reaches the driver.
    """
    edges = table(edges.select("a", "b"), "edges")
    if edges.count() <= local:
        return table(edges.coalesce(1).mapInArrow(_close, "id long, component long"), "labels")
    return _rounds(edges)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:  # hook the larger root to the smaller, then shorten paths
        x, y = label[a], label[b]
        if (x == y).all():
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["id", "component"])


def _rounds(edges: DataFrame) -> DataFrame:
    """Each round takes the least label among neighbours, then the label's own label, so paths halve."""
    both = table(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = table(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("c").alias("m"))
        )
        step = table(labels.join(near, "id").select("id", F.least("component", "m").alias("component"), F.col("component").alias("was")), "step")
        own = step.select(F.col("id").alias("component"), F.col("component").alias("next"))
        labels = table(step.join(own, "component").select("id", F.least("component", "next").alias("component"), "was"), "labels")
        if not labels.where(F.col("component") != F.col("was")).limit(1).count():
            return labels.select("id", "component")
