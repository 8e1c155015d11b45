"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailgrain.sources.workspace import stored


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node it can reach, for every node of links (a, b).

    Every round hangs the larger neighbours of a node to its smallest one, then
    the node itself; rounds end when every node hangs on its root.  The minima
    are aggregated before they are shuffled; the joins are on one narrow table.
    """
    edges = stored(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            edges.select("a", "b").join(low, "a").select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            least.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        edges = stored(small, "links")
        now = edges.agg(
            F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if (now.n, now.h) == state:
            break
        state = (now.n, now.h)
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct())
