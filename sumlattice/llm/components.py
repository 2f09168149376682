"""Connected components of a graph of links, by alternating star contractions.

The links stay a distributed table.  Each round writes it, so that no round
repeats another and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage


def components(stage: Stage, links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link, from (a, b) rows; root is the smallest node reachable."""
    edges = stage.write(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        # Each node hands its larger neighbours to its smallest one, then its smaller ones.
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        made = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = stage.write(made.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = small.agg(F.count("*"), F.sum("v"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        stage.drop(edges)
        edges = small
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select("v", "v").distinct())
        state = now
