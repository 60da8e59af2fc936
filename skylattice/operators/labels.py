"""Components of a graph by rounds of smallest labels with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, kept


def propagate(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b): the smallest node each can reach.

    Every round a node takes the smallest label among its neighbours and then its
    label's label, until nothing changes; paths shrink by half a round or better.
    Each round's labels are written to shared storage, and those before them go.
    """
    both, _ = kept(links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    total = before = None
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels, path = kept(low.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component")), "labels")
        if before is not None:
            dropped(labels.sparkSession, before)
        before = path
        found = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if found == total:
            return labels
        total = found
