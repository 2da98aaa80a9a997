"""Connected components of a link table, by minimum labels with pointer jumping; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b): label is the smallest node that links reach.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so that a chain of
    n links takes about log n rounds.  Every round is written to the shared folder; an empty table gives an empty one.
    """
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("to")).union(links.select("b", "a")).filter("node <> to").distinct(), "edges")
    label = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")), "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "to"), "to").groupBy("node").agg(F.min("label").alias("near"))
        least = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        new = stored(least.join(up, "low").select("node", "old", F.least("low", "jump").alias("label")), "labels")
        discard(label)
        if new.filter("label <> old").isEmpty():
            discard(both)
            return new.select("node", "label")
        label = new.drop("old")
        label.stored_at = new.stored_at
