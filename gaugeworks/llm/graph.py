"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.shared import staged


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the smallest node that links reach.

    Each round points every node to the smallest of its neighbours and itself, follows that pointer once
    more, and contracts the links: those inside a group vanish, the rest become links of groups. So the
    links shrink from round to round, and the rounds are about the logarithm of a component's width.
    The tables of a round are staged; only whether links are left comes to the driver. A group's smallest
    node never points elsewhere, so it is the root that remains.

    Links with a null end and links of a node to itself are ignored; an empty table gives an empty one.
    """
    known = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = staged(known.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "links")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("root"))
        then = first.select(F.col("node").alias("root"), F.col("root").alias("next"))
        hop = staged(first.join(then, "root").select("node", F.col("next").alias("root")), "pointers")
        if labels is None:
            labels = hop
        else:
            moved = labels.join(hop.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            labels = staged(moved.select("node", F.coalesce("next", "root").alias("root")), "labels")
        ends = edges.join(hop.select(F.col("node").alias("u"), F.col("root").alias("p")), "u")
        ends = ends.join(hop.select(F.col("node").alias("v"), F.col("root").alias("q")), "v").where("p <> q")
        edges = staged(ends.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct(), "links")
        if edges.isEmpty():
            return labels
