"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.operators.staging import staged


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of a link.

    Labels spread along links and then jump to their label's label, until none changes; each round is
    written once in the shared folder. Only a count comes to the driver.
    """
    e = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    e = staged(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = staged(e.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("component")), "labels")
    while True:
        heard = e.join(labels.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "component")
        lower = labels.unionByName(heard).groupBy("node").agg(F.min("component").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        moved = lower.join(jump, "component").join(labels.withColumnRenamed("component", "_old"), "node")
        moved = staged(moved.select("node", F.least("component", "_next").alias("component"), "_old"), "labels")
        labels = moved.select("node", "component")
        if moved.where("component <> _old").isEmpty():
            return labels
