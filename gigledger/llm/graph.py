"""Connected components of an edge table, by joins and minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import cut


def fewer_links(edges: DataFrame) -> DataFrame:
    """Links (a, b) with the same components as those given, where many left ends share few right ends.

    A left end keeps the link to its smallest right end, and its right ends are linked to that one:
    stars over one group from several blocks come down to one link a member. A left end has at
    most as many right ends as there are blocks that hold it.
    """
    stars = edges.where("a <> b").groupBy("a").agg(F.min("b").alias("low"), F.collect_set("b").alias("ends"))
    hubs = stars.where("size(ends) > 1").select(F.explode("ends").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
    return stars.select("a", F.col("low").alias("b")).unionAll(hubs)


def components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) -> (node, root): root is the smallest node reachable.

    Each round a node and its present root both take the smallest root among the node's
    neighbours, then every pointer is shortened by one jump; rounds grow with the logarithm of
    the diameter. Hubs are safe: minima are pre-aggregated and joins read checkpointed sides, so
    adaptive execution can split a hot key. Loops and repeated edges don't matter; no edges give
    no rows.
    """
    both = cut(edges.where("a <> b").select("a", "b").unionAll(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    found = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        near = cut(both.join(found, both.b == found.node).groupBy("a").agg(F.min("root").alias("low")))
        told = near.join(found, near.a == found.node).select(F.explode(F.array("node", "root")).alias("node"), "low")
        hooked = cut(
            found.join(told.groupBy("node").agg(F.min("low").alias("low")), "node", "left")
            .select("node", F.col("root").alias("was"), F.least("root", F.coalesce("low", "root")).alias("root"))
        )
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = cut(hooked.join(up, "root").select("node", "was", F.least("root", "top").alias("root")))
        found = after.select("node", "root")
        if after.where("was <> root").isEmpty():
            return found
