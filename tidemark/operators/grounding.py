"""Grounding of extracted entities and relations in the chunk they were extracted from: the first reason against each is kept.

entities: chunk, name, kind, aliases; relations: chunk, source, target, kind,
evidence; chunks: chunk, text. Labels are compared normalised. Every step is
a join or a group by chunk and label, so no chunk's output meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.text import linking_label
from tidemark.sources.tables import small_batches, written

# Why something is not taken.
NOT_GROUNDED, NO_ENDPOINT, NO_EVIDENCE, NO_SOURCE, NO_TARGET, DUPLICATE = "entity_mention_not_grounded", "relation_endpoint_not_in_output", "relation_evidence_not_in_chunk", "relation_source_not_grounded", "relation_target_not_grounded", "duplicate"
_NONE = "array<string>"


def _in(part: Column, whole: Column) -> Column:
    return F.coalesce(F.contains(whole, part), F.lit(False))


def _labelled(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """chunk, _t: the label of each text, made once, so that what joins it runs no Python beside it."""
    return written(spark, chunks.select("chunk", linking_label("text").alias("_t")), "labels")


def grounded_entities(spark: SparkSession, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk, key, kind, name, aliases (labels, sorted), n, reason: entities of one label and kind as one (n of them).

    Every alias has to stand in the chunk, and so has the name unless an alias does. Blank names and aliases are none; an entity of an unknown chunk is not grounded.
    """
    small_batches(spark)  # labels of whole texts in Python
    own = entities.select("chunk", "name", "kind", linking_label("name").alias("key"), F.coalesce("aliases", F.array().cast(_NONE)).alias("aliases")).where("key <> ''")
    own = written(spark, own, "named")
    first = own.groupBy("chunk", "key", "kind").agg(F.min("name").alias("name"), F.count("*").alias("n"))
    each = own.select("chunk", "key", "kind", F.explode("aliases").alias("alias")).select("chunk", "key", "kind", linking_label("alias").alias("alias")).where("alias <> '' AND alias <> key").distinct()
    texts = _labelled(spark, chunks)
    told = each.join(texts, "chunk", "left").groupBy("chunk", "key", "kind").agg(F.array_sort(F.collect_list("alias")).alias("aliases"), F.bool_and(_in(F.col("alias"), F.col("_t"))).alias("_all"))
    both = first.join(told, ["chunk", "key", "kind"], "left").join(texts, "chunk", "left")
    some = F.col("aliases").isNotNull()
    ok = F.when(some, F.col("_all")).otherwise(_in(F.col("key"), F.col("_t")))
    return both.select("chunk", "key", "kind", "name", F.coalesce("aliases", F.array().cast(_NONE)).alias("aliases"), "n", F.when(~ok, NOT_GROUNDED).alias("reason"))


def grounded_relations(spark: SparkSession, relations: DataFrame, entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk, source, target, kind, evidence, n, source_id, target_id, reason: relations of equal labels and kind as one, over the taken of ``grounded_entities``.

    An end is a label that exactly one taken entity of the chunk has. The evidence has to stand in the chunk, and a mention of either end in the evidence. Of
    relations that lead to the same entities the first by labels is taken.
    """
    small_batches(spark)
    taken = written(spark, entities.where("reason IS NULL").select("chunk", F.concat_ws("|", "key", "kind").alias("id"), F.array_distinct(F.concat(F.array("key"), "aliases")).alias("mentions")), "entities")
    ends = taken.select("chunk", "id", "mentions", F.explode("mentions").alias("label")).groupBy("chunk", "label").agg(F.count("*").alias("n"), F.min(F.struct("id", "mentions")).alias("e")).where("n = 1")
    own = relations.withColumn("s", linking_label("source")).withColumn("t", linking_label("target")).withColumn("_e", linking_label("evidence"))
    own = written(spark, own, "relations")
    one = own.groupBy("chunk", "s", "t", "kind").agg(F.min(F.struct("source", "target", "evidence", "_e")).alias("r"), F.count("*").alias("n"))
    side = lambda c: ends.select("chunk", F.col("label").alias(c), F.col("e.id").alias(f"{c}_id"), F.col("e.mentions").alias(f"{c}_mentions"))
    both = one.join(side("s"), ["chunk", "s"], "left").join(side("t"), ["chunk", "t"], "left").join(_labelled(spark, chunks), "chunk", "left")
    says = lambda c: F.exists(f"{c}_mentions", lambda m: _in(m, F.col("r._e")))
    reason = F.when(F.col("s_id").isNull() | F.col("t_id").isNull(), NO_ENDPOINT).when(~_in(F.col("r._e"), F.col("_t")), NO_EVIDENCE).when(~says("s"), NO_SOURCE).when(~says("t"), NO_TARGET)
    told = both.withColumn("reason", reason)
    nth = F.row_number().over(Window.partitionBy("chunk", "s_id", "t_id", "kind", F.col("reason").isNull()).orderBy("s", "t"))
    return told.withColumn("_n", nth).select("chunk", "r.source", "r.target", "kind", "r.evidence", "n", F.col("s_id").alias("source_id"), F.col("t_id").alias("target_id"), F.when(F.col("reason").isNull() & (F.col("_n") > 1), DUPLICATE).otherwise(F.col("reason")).alias("reason"))
