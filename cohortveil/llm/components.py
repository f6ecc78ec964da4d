"""Connected components of a link table, by label passing and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import stored


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node that it reaches) for the nodes of links (a, b).

    Each round a node takes the least label of its neighbours, then the label
    of its label, so paths halve.  Tables between rounds are written to the
    shared folder.  Labels stay distributed; the driver sees a count a round.
    """
    both = stored(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(near, "node").select("node", F.least("component", "near").alias("label"), F.col("component").alias("before"))
        jump = labels.select(F.col("node").alias("label"), F.col("component").alias("further"))
        new = stored(stepped.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("component"), "before"))
        done = new.where("component < before").isEmpty()
        labels = new.select("node", "component")
        if done:
            return labels
