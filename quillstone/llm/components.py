"""Connected components of an edge table by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: bigint) to (node, label): the smallest node of each component.

    Every round takes the smallest label among a node's neighbours, then the label of
    that label, so the rounds grow with the logarithm of a chain's length. Each round's
    labels are written; rounds end when no label changes.

    Before the rounds all edges of one ``a`` are led to the smallest of its ``b`` (a star keeps
    what it joins together), so many ties of one group become few. Edges of one ``a`` must be
    bounded in number; those of one ``b`` need not be.
    """
    stars = edges.groupBy("a").agg(F.collect_set("b").alias("near")).select(F.array_distinct(F.array_append("near", F.col("a"))).alias("near"))
    led = stars.select(F.explode("near").alias("a"), F.array_min("near").alias("b")).where("a <> b").distinct()
    both = scratch.keep(led.union(led.select("b", "a")), "edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        of_label = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = lower.join(of_label, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        written = scratch.keep(jumped, "labels")
        labels = written.select("node", "label")
        if written.where("label <> old").isEmpty():
            return labels
