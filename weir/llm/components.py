"""Connected components of a graph held as an edge table.

Smallest-label propagation with pointer jumping: each round gives a node the
smallest label among itself and its neighbours, then the label of its label.
Only sums come to the driver. Labels live in written tables, so a lost executor
costs a reread and lineage stays one round long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm._scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b longs): comp is the least node that it reaches."""
    both = scratch.write(edges.select("a", "b").union(edges.select("b", "a").toDF("a", "b")).filter("a <> b").distinct(), "both")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    total = None
    while True:
        low = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        near = labels.join(low, "node").select("node", F.least("comp", "low").alias("comp"))
        near = scratch.write(near, "near")
        jump = near.join(near.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp").select("node", F.least("comp", "up").alias("comp"))
        old, labels = labels, scratch.write(jump, "labels")
        # labels only fall, so equal sums mean no change
        now = labels.agg(F.sum(F.col("comp").cast("decimal(38,0)"))).first()[0]
        scratch.drop(old, near)
        if now == total:
            scratch.drop(both)
            return labels
        total = now
