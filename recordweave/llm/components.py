"""Connected components of a link table, by minimum labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node of ``links``; the label is the smallest node that is reachable.

    A round takes the least label among a node and its neighbours, then the label of that label, so paths halve.
    Labels and links stay distributed; the driver sees one count per round.
    """
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        step = step.join(jump, F.col("label") == F.col("n2"), "left")
        new = cut(step.select("node", F.least("label", F.coalesce("l2", "label")).alias("label"), "was"))
        changed = new.where("label <> was").count()
        labels = new.select("node", "label")
        if not changed:
            return labels
