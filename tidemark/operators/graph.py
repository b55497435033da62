"""Property-graph steps and entity linking as joins of vertex, edge and support tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.operators.components import components
from tidemark.operators.ordering import numbered
from tidemark.operators.similarity import matched_ratio
from tidemark.sources.tables import written


def supported(nodes: DataFrame, support: DataFrame, key: str = "id") -> DataFrame:
    """Nodes that have evidence."""
    return nodes.join(support.select(key).distinct(), key, "left_semi")


def orphans(nodes: DataFrame, support: DataFrame, key: str = "id") -> DataFrame:
    """Nodes without evidence, to be deleted."""
    return nodes.join(support.select(key), key, "left_anti")


def degree(edges: DataFrame, n: int | None = None) -> DataFrame:
    """(id, degree), busiest first, then by id. The counts are summed before they are shuffled."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst")))
    counts = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return counts if n is None else counts.orderBy(F.desc("degree"), "id").limit(n)


def hop(states: DataFrame, edges: DataFrame, max_neighbors: int = 20, max_relations: int = 100) -> DataFrame:
    """One hop both ways from states (seed, node, path, hops): per direction the first neighbours by id, of each the first relations; no vertex twice on a path."""
    ways = []
    for way, a, b in (("forward", "src", "dst"), ("reverse", "dst", "src")):
        step = states.join(edges.select(F.col(a).alias("node"), F.col(b).alias("next"), "rel"), "node")
        near = Window.partitionBy("seed", "path").orderBy("next")
        own = Window.partitionBy("seed", "path", "next").orderBy("rel")
        ways.append(step.withColumn("nth", F.dense_rank().over(near)).where(F.col("nth") <= max_neighbors).withColumn("m", F.row_number().over(own)).where(F.col("m") <= max_relations).withColumn("way", F.lit(way)))
    both = ways[0].unionByName(ways[1]).where(~F.array_contains("path", F.col("next")))
    return both.select("seed", F.col("next").alias("node"), F.concat("path", F.array("next")).alias("path"), (F.col("hops") + 1).alias("hops"), "rel", "way")


def walk(seeds: DataFrame, edges: DataFrame, hops: int = 2, **caps) -> DataFrame:
    """States reached within ``hops``, seeds included."""
    state = seeds.select(F.col("id").alias("seed"), F.col("id").alias("node"), F.array("id").alias("path"), F.lit(0).alias("hops"), F.lit(None).cast("long").alias("rel"), F.lit("").alias("way"))
    every = state
    for _ in range(hops):
        state = hop(state.select("seed", "node", "path", "hops"), edges, **caps)
        every = every.unionByName(state)
    return every


def prefix_pairs(entities: DataFrame, window: int = 16, prefix: int = 2) -> DataFrame:
    """(a, b), a < b: entities within ``window`` places in their prefix's order of labels.

    Places are numbered over ranges of labels, so no prefix is sorted in one
    task; a pair meets where one place is at most ``window`` after the other, by an
    equi-join on shifted places. Null labels are of no prefix.
    """
    spark = entities.sparkSession
    known = entities.where("label IS NOT NULL").select("id", "label", F.substring("label", 1, prefix).alias("p"))
    placed = written(spark, numbered(spark, known, "p", "label", "id").select("p", "id", "place"), "places")
    left = placed.select("p", F.col("id").alias("x"), F.explode(F.sequence(F.col("place") + 1, F.col("place") + window)).alias("place"))
    near = left.join(placed.select("p", "place", F.col("id").alias("y")), ["p", "place"])
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def label_classes(entities: DataFrame) -> DataFrame:
    """(label, n, least): the entities of each label, counted."""
    return entities.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("least"))


def blocking_pairs(entities: DataFrame, window: int = 16, prefix: int = 2, most: int = 64) -> DataFrame:
    """(a, b), a < b: entities of equal label, and those of ``prefix_pairs``.

    Up to ``most`` entities of a label meet all with all. More of them are each
    tied to the smallest one (``label_classes`` tells how many there are), so pairs
    never grow with the square of a label.
    """
    sized = entities.join(label_classes(entities), "label")
    few = sized.where(F.col("n") <= most)
    same = few.select(F.col("id").alias("a"), "label").join(few.select(F.col("id").alias("b"), "label"), "label").where("a < b").select("a", "b")
    many = sized.where((F.col("n") > most) & (F.col("id") != F.col("least"))).select(F.col("least").alias("a"), F.col("id").alias("b"))
    return same.union(many).union(prefix_pairs(entities, window, prefix)).distinct()


def decide(pairs: DataFrame, entities: DataFrame, least: float = 0.72) -> DataFrame:
    """NO_LINK for other types or little likeness, else UNCERTAIN; never a link by itself."""
    own = lambda s: entities.select(F.col("id").alias(s), F.col("label").alias(f"{s}_label"), F.col("type").alias(f"{s}_type"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").withColumn("similarity", matched_ratio("a_label", "b_label"))
    return both.withColumn("decision", F.when(F.col("a_type") != F.col("b_type"), "NO_LINK").when((F.col("a_label") != F.col("b_label")) & (F.col("similarity") < least), "NO_LINK").otherwise("UNCERTAIN"))


def canonical(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, root) of the clusters of accepted links, of two members at least."""
    return components(spark, links)
