"""Connected components of an edge list, without gathering edges anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplace.shared import drop, materialise


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges(a, b): least labels of neighbours, then pointer jumps.

    Each round takes the least label around a node and follows the label's own
    label, so chains halve. Rounds end when no label changes. Aggregates combine
    before they shuffle; labels are written between rounds, which cuts lineage.
    """
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    old = labels
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        near = labels.join(around, "node").select("node", "component", F.least("component", "m").alias("m"))
        jump = near.join(labels.select(F.col("node").alias("m"), F.col("component").alias("j")), "m", "left")
        after = materialise(jump.select("node", F.least("m", F.coalesce("j", "m")).alias("component"), (F.col("component") != F.least("m", F.coalesce("j", "m"))).alias("moved")), "labels")
        drop(old)
        old, labels = after, after.select("node", "component")
        if after.filter("moved").isEmpty():
            drop(both)
            return labels
