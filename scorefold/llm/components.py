"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scorefold.session import cut_lineage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them: the larger ones, or the smaller ones and the node."""
    if large:
        sides = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = sides.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
    joined = sides.join(lowest, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            lowest.select("a", F.col("low").alias("b"))
        )
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); a component is named by its smallest node.

    Alternates large and small stars until every link ends in a node that links no
    further, about log2(n) times. Each round is written to the shared folder, so a lost
    executor repeats one round. Groups of any size stay rows: only minima are taken
    per node, no list of neighbours.
    """
    now = edges.select("a", "b").where("a <> b")
    while True:
        now = cut_lineage(_stars(_stars(now, True), False), "stars")
        ends = now.select(F.col("b").alias("end")).distinct()
        if not now.join(ends, now["a"] == ends["end"], "left_semi").limit(1).count():
            break
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())
