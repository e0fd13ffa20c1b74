"""Connected components of a graph whose edges no task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.durable import checkpoint


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, label)``: the least node of each node's component; nodes of any orderable type.

    Every round takes the least label among a node's neighbours and itself (an aggregation with a map-side
    part, so a node of very many edges is no hot group) and then the label's own label, which halves the
    paths that are left. Each round is checkpointed; it ends when no label changes. Null ends are ignored.
    """
    both = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other")))).alias("e")).select("e.node", "e.other")
    labels = checkpoint(both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        offered = both.join(labels.select(F.col("node").alias("other"), "label"), "other").select("node", "label")
        least = offered.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        jumped = least.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.least("label", F.coalesce("next", "label")).alias("label"))
        before = labels
        labels = checkpoint(jumped)
        moved = labels.join(before.withColumnRenamed("label", "was"), "node").where("label <> was").limit(1).count()
        if not moved:
            return labels
