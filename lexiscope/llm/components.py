"""Connected components of a graph of any size, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.sources.shared import write_and_reread


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for all nodes of ``a, b``.

    Every round takes the smallest label among neighbours and then the label of that label, so
    long chains shorten by powers; labels are stored each round. Nodes without edges don't appear.
    """
    both = edges.select("a", "b").unionAll(edges.select("b", "a")).filter("a <> b").distinct()
    links = write_and_reread(both, "links")
    labels = links.groupBy(F.col("a").alias("node")).agg(
        F.least(F.col("a"), F.min("b")).alias("label")
    )
    labels = write_and_reread(labels, "labels")
    before = None
    while True:
        near = (
            links.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"))
        lower = write_and_reread(lower, "labels")
        target = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = lower.join(target, "label").select("node", F.col("further").alias("label"))
        labels = write_and_reread(jumped, "labels")
        state = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return labels
        before = state
