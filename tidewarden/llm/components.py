"""Connected components of a graph given as pairs, with its state in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewarden.sources.staging import stage


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and root (smallest node of its component), for every node of a pair.

    Each round takes the smallest label among neighbours, offers it to the node and to its present
    root, then jumps one step up. Labels only fall, so an unchanged sum ends the rounds.
    Nodes are whole numbers. Null ends, loops and repeated pairs change nothing; no pairs give no rows.
    """
    ends = pairs.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node is not null and other is not null")
    edges = stage(ends.union(ends.select("other", "node")).distinct(), "edges")
    labels = edges.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root"))
    labels, last = stage(labels, "labels"), None
    while True:
        total = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == last:
            return labels
        last = total
        near = labels.select(F.col("node").alias("other"), F.col("root").alias("seen"))
        offer = edges.join(near, "other").groupBy("node").agg(F.min("seen").alias("seen")).join(labels, "node")
        low = F.least("seen", "root")
        offers = offer.select(F.explode(F.array(F.struct("node", low.alias("root")), F.struct(F.col("root").alias("node"), low.alias("root")))).alias("x"))
        lower = stage(offers.select("x.*").groupBy("node").agg(F.min("root").alias("root")), "lower")
        up = lower.select(F.col("node").alias("root"), F.col("root").alias("above"))
        labels = stage(lower.join(up, "root").select("node", F.col("above").alias("root")), "labels")
