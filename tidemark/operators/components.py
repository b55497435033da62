"""Connected components over a table of links, without a hub in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.tables import written


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links (a, b) reach, for each node that has a link.

    Rounds of: every node takes the smallest root among its neighbours (a
    pre-aggregated minimum), then the root of its root. Each round is a table
    in the shared folder; the loop ends when nothing changes. All joins merge:
    a broadcast in each round would add up in the driver.
    """
    both = written(spark, links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a != b").distinct(), "links")
    roots = written(spark, both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "roots")
    while True:
        near = both.join(roots.hint("merge"), both.b == roots.node).groupBy("a").agg(F.min("root").alias("m"))
        hooked = roots.join(near.hint("merge"), roots.node == near.a, "left").select("node", F.least("root", F.coalesce("m", "root")).alias("r"), F.col("root").alias("old"))
        up = roots.select(F.col("node").alias("r"), F.col("root").alias("rr"))
        new = written(spark, hooked.join(up.hint("merge"), "r", "left").select("node", F.least("r", F.coalesce("rr", "r")).alias("root"), "old"), "roots")
        if not new.where("root != old").limit(1).count():
            return new.select("node", "root")
        roots = new.select("node", "root")
