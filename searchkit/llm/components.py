"""Connected components of a graph that may be too large for one machine.

Defined cases: loops and repeated edges change nothing; a graph without edges has no
nodes; of a component the smallest node is the root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchkit.llm.common import checkpoint


#: Edges up to which one task settles them, which saves rounds of small jobs.
FEW = 10_000


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = [np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]) for b in batches]
    nodes, ends = np.unique(np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64), return_inverse=True)
    ends = ends.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        low = label[ends].min(axis=1)
        new = label.copy()
        for side in (0, 1):
            np.minimum.at(new, ends[:, side], low)
            np.minimum.at(new, label[ends[:, side]], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, root) for every node of an edge, root the smallest node it reaches.

    Alternating large-star and small-star steps: each replaces a node's links by
    links to its smallest neighbour, so the edges shrink to stars in a number of
    rounds that grows with the logarithm of the graph. A hub's neighbours are
    reduced with a partial minimum and joined as rows, never gathered in a list;
    each step is checkpointed, so its lineage is short and its joins have plain
    shuffles on both sides, which adaptive execution splits where they are skewed.
    """
    now = checkpoint(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct())
    if now.count() <= few:
        return now.coalesce(1).mapInArrow(_settle, "node long, root long")
    before = None
    for _ in range(max_rounds):
        # Large star: larger neighbours move to the smallest of the node and its neighbours.
        both = now.union(now.select("v", "u"))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        now = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        now = checkpoint(now)
        least = checkpoint(now.groupBy("u").agg(F.min("v").alias("m")))
        moved = now.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = checkpoint(moved.union(least).distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
