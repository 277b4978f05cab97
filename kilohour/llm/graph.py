"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kilohour.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node it reaches) of every node that has a link (columns a, b).

    Each round a node takes the smallest label among itself and its neighbours, then the label of its label, so paths
    halve; stored tables cut the lineage. The rounds end when nothing changes. Only counts reach the driver.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        stepped = stored(labels.join(near, "node").select("node", F.least("label", "low").alias("label"), F.col("label").alias("old")))
        jump = stepped.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stored(stepped.join(jump, "label").select("node", F.least("label", "next").alias("label"), (F.least("label", "next") < F.col("old")).alias("moved")))
        for done in (labels, stepped):
            discard(done)
        labels = after
        if after.where("moved").isEmpty():
            discard(both)
            return labels.select("node", "label")
