"""Connected components of a sparse link table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.llm.common import cut, salted_join


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the links of a partition by stars with the same components: at most one link a node."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def stars() -> pa.RecordBatch:
        found = [(x, find(x)) for x in parent]
        return pa.record_batch({"u": pa.array([a for a, b in found if a != b], pa.int64()), "v": pa.array([b for a, b in found if a != b], pa.int64())})

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > 2_000_000:
            yield stars()
            parent.clear()
    yield stars()


def components(links: DataFrame) -> DataFrame:
    """Labels each node of ``links(u long, v long)`` with the smallest node that it reaches.

    Smallest labels spread along links and then along labels (pointer jumping), so the rounds
    needed grow with the logarithm of the diameter. Before, links are contracted in their tasks and once more
    by node, so that a dense group has few. A node in very many links is dealt to several tasks. Returns ``node, label`` of linked nodes only;
    an empty link table gives an empty result. Self links and repeated links don't matter.
    """
    stars = links.mapInArrow(forest, "u long, v long").repartition("u").mapInArrow(forest, "u long, v long")
    both = cut(stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    while True:
        near = salted_join(both, labels.withColumnRenamed("node", "v"), "v", "u").groupBy("u").agg(F.min("label").alias("seen"))
        spread = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        target = labels.select(F.col("node").alias("label"), F.col("label").alias("onward"))
        moved = cut(salted_join(spread, target, "label", "node").select("node", "old", F.least("label", "onward").alias("label")))
        done = moved.where("label <> old").isEmpty()
        labels = moved.select("node", "label")
        if done:
            return labels
