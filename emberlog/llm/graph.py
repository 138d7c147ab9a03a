"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached. Every round takes the least label of neighbours and then the
    label of that label, so that long chains need few rounds; each round's labels are a table in the shared folder.

    Null ends and loops are dropped; no links give an empty table.
    """
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = written(both.union(both.select("b", "a")).distinct(), "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    while True:
        sent = edges.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "component", F.lit(None).cast("long").alias("was"))
        least = sent.union(labels.select("node", "component", F.col("component").alias("was"))).groupBy("node").agg(F.min("component").alias("component"), F.min("was").alias("was"))
        ahead = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = written(least.join(ahead, "component", "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component"), "was"), "labels")
        if labels.filter("component <> was").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
