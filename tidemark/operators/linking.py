"""Candidates for linking entities: blocks of bounded size, pairs within them, signals of each pair.

Entities: id, kb, doc, name, aliases (array), type. Entities of one kb meet in
exact blocks (a name or alias they share) and prefix blocks (the first two
characters of the name). A block of more than ``MAX_BLOCK`` entities says
nothing and is skipped, but told; so no block, and no task, grows with the
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.functions.text import linking_label
from tidemark.operators.similarity import matched_ratio
from tidemark.sources.tables import written

# The size of a block, the pairs of a knowledge base, neighbours within a prefix, and their least likeness.
MAX_BLOCK, MAX_PAIRS, WINDOW, LEAST = 64, 200, 16, 0.72


def labelled(spark: SparkSession, entities: DataFrame) -> DataFrame:
    """Entities with normalised name, aliases and type; blank aliases go, null ones too."""
    rows = entities.select("id", "kb", "doc", linking_label("name").alias("name"), linking_label("type").alias("type"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    each = rows.select("id", F.explode("aliases").alias("alias")).where("alias IS NOT NULL").select("id", linking_label("alias").alias("alias")).where("alias <> ''")
    own = each.groupBy("id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    none = F.array().cast("array<string>")
    return written(spark, rows.drop("aliases").join(own, "id", "left").withColumn("aliases", F.coalesce("aliases", none)).withColumn("terms", F.array_sort(F.array_distinct(F.filter(F.concat(F.array("name"), "aliases"), lambda t: t != "")))), "labels")


def blocks(entities: DataFrame, prefix: bool = True) -> DataFrame:
    """(kb, kind, value, id): the blocks that labelled entities are in."""
    every = entities.select("kb", F.lit("exact").alias("kind"), F.explode("terms").alias("value"), "id")
    if prefix:
        every = every.unionByName(entities.where(F.char_length("name") >= 2).select("kb", F.lit("prefix").alias("kind"), F.substring("name", 1, 2).alias("value"), "id"))
    return every.distinct()


def block_sizes(entities: DataFrame, max_block: int = MAX_BLOCK, prefix: bool = True) -> DataFrame:
    """(kb, kind, value, n, least, skipped_pairs) of each block: those that are too large lose all their pairs, which are counted."""
    n = F.count("*")
    return blocks(entities, prefix).groupBy("kb", "kind", "value").agg(n.alias("n"), F.min("id").alias("least"), F.when(n > max_block, F.expr("count(*) * (count(*) - 1) div 2")).otherwise(F.lit(0)).alias("skipped_pairs"))


def candidates(spark: SparkSession, entities: DataFrame, max_block: int = MAX_BLOCK, max_pairs: int | None = MAX_PAIRS, window: int = WINDOW, prefix: bool = True) -> DataFrame:
    """Pairs a < b of labelled entities with their signals, the first ``max_pairs`` of each kb.

    Pairs come in the order of their first block (kind, value) and of their ids. In an
    exact block all meet, in a prefix block those within ``window`` places by id whose
    names' likeness is ``LEAST`` or more. The cut by kb is made on each task's own pairs first.
    """
    members = blocks(entities, prefix)
    small = members.join(block_sizes(entities, max_block, prefix).where(F.col("n") <= max_block).select("kb", "kind", "value"), ["kb", "kind", "value"])
    placed = small.withColumn("at", F.row_number().over(Window.partitionBy("kb", "kind", "value").orderBy("id")))
    left, right = placed.select("kb", "kind", "value", F.col("id").alias("a"), F.col("at").alias("x")), placed.select("kb", "kind", "value", F.col("id").alias("b"), F.col("at").alias("y"))
    pairs = left.join(right, ["kb", "kind", "value"]).where("x < y").where((F.col("kind") == "exact") | (F.col("y") <= F.col("x") + window))
    first = pairs.groupBy("kb", "a", "b").agg(F.min(F.struct("kind", "value")).alias("block"))
    own = lambda s: entities.select(F.col("id").alias(s), F.struct("name", "aliases", "terms", "type", "doc").alias(f"of_{s}"))
    both = first.join(own("a"), "a").join(own("b"), "b").withColumn("similarity", F.round(matched_ratio(F.col("of_a.name"), F.col("of_b.name")), 6))
    both = both.where((F.col("block.kind") == "exact") | (F.col("similarity") >= LEAST))
    if max_pairs is not None:
        order = Window.partitionBy("kb").orderBy("block.kind", "block.value", "a", "b")
        both = both.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max_pairs)
    shared = lambda c: F.array_sort(F.array_intersect(f"of_a.{c}", f"of_b.{c}"))
    return both.select(
        "kb", "a", "b", (F.col("of_a.name") == F.col("of_b.name")).alias("name_match"), shared("terms").alias("mention_overlap"), shared("aliases").alias("alias_overlap"),
        F.col("of_a.type").eqNullSafe(F.col("of_b.type")).alias("compatible_type"), "similarity", F.col("of_a.doc").eqNullSafe(F.col("of_b.doc")).alias("same_document"),
    )
