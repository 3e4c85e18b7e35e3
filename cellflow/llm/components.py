"""Connected components as DataFrame joins: minimum labels travel along links and then jump to the label of their label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep


def components(links: DataFrame) -> DataFrame:
    """From links (a, b: long) the table (node, component: its smallest node). Nodes without links are not in it.

    A node takes the minimum over its neighbours by a partial aggregate, so a hub with a third of all links is no large group. Labels are
    written to the shared folder after each round, and rounds go on until none changes.
    """
    with Scratch(links.sparkSession) as scratch:
        return keep(_labels(links, scratch), "components")


def _labels(links: DataFrame, scratch: Scratch) -> DataFrame:
    both = scratch.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = scratch.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        # The label of a label: one more step towards the root, which halves long chains.
        target = labels.select(F.col("node").alias("t"), F.col("component").alias("tc"))
        after = scratch.keep(lower.join(target, F.col("component") == F.col("t"), "left").select("node", "old", F.least("component", F.coalesce("tc", "component")).alias("component")), "labels")
        labels = after.select("node", "component")
        if after.where("old <> component").isEmpty():
            return labels
