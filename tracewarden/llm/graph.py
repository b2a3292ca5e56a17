"""Connected components of an edge table, in rounds of joins (no driver-side graph)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b longs).

    Each round gives a node the least label among its own and its neighbours', then follows the label's label (pointer
    jumping), so the number of rounds grows with the logarithm of a component's diameter.
    """
    both = C.stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = C.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.least("component", "near").alias("next"), "component")
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = C.stored(least.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("next"), "component"), "labels")
        if moved.where("next <> component").isEmpty():
            return labels
        labels = moved.select("node", F.col("next").alias("component"))
