"""Connected components of an edge table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, root): the least node of each component, for nodes with an edge.

    Every round takes the least label among a node's neighbours and then
    jumps to that label's label, so labels halve their way to the root. Each
    round is written, and the next one reads it.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        least = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("least"))
        jump = labels.select(F.col("node").alias("least"), F.col("root").alias("beyond"))
        moved = least.join(jump, "least").select(
            "node", F.least("least", "beyond").alias("root"), (F.col("root") > F.least("least", "beyond")).alias("moved")
        )
        moved = materialise(moved, "labels")
        labels = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return labels
