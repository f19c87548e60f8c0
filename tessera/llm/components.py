"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable by these edges), by hooking and jumping."""
    nodes, flat = np.unique(np.r_[a, b], return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, root = roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        far = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], ["a", "b"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """``edges`` (``a``, ``b`` long, not null) → ``node``, ``comp`` (the smallest
    node reachable) for every node with an edge to another.

    Batches of edges are first replaced by stars around their smallest nodes.
    Then each round takes the smallest label among a node and its neighbours
    and follows labels once (pointer jumping), until a round changes nothing.
    Each round is a written table.  The largest node only adds rows to joins
    that Spark may split; minima are pre-aggregated.
    """
    stars = edges.where("a <> b").mapInArrow(_contracted, "a long, b long")
    both = staged(stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    label = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                   .select("node", F.least("node", "m").alias("comp")), f"{name}-labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        low = label.join(near, "node").select("node", "comp", F.least("comp", "m").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("comp").alias("next"))
        new = staged(low.join(jump, "low").select("node", F.least("low", "next").alias("comp"), F.col("comp").alias("old")), f"{name}-labels")
        label = new.select("node", "comp")
        if new.where("comp <> old").isEmpty():
            return label
