"""Mixing sources to target weights by systematic sampling.

Sources share all words by weight, but none more than ``cap`` times its own;
what is over goes to the others by weight. A source's documents each have
target / size expected copies. They stand in order of size; the prefix sums of
the expected copies, plus one random offset, cross an integer boundary as often
as the document is taken.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import written

_SALTS = 61


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def offset(seed: int) -> float:
    """The one random offset of a mix, in (0, 1)."""
    return random.Random(seed).random()


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3) -> DataFrame:
    """(source, source_size) -> also target. Sources stand by code point, null last; weights repeat.

    Filled to a common level: a source is at its cap if, with the level at its
    cap over its weight, all sources together would not be over the total.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    up_to = Window.orderBy("level", F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), nth + 1)
    found = sizes.select("source", "source_size", w.alias("w")).withColumn("most", F.col("source_size") * float(cap)).withColumn("level", F.col("most") / F.col("w"))
    found = found.select(
        "*", F.sum("source_size").over(every).cast("double").alias("total"), F.sum("most").over(up_to).alias("most_to"), (F.sum("w").over(every) - F.sum("w").over(up_to)).alias("w_after")
    ).withColumn("full", F.col("most_to") + F.col("level") * F.col("w_after") <= F.col("total"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0))
    free = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    return found.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(rest * F.col("w") / free).alias("target"))


def mix(spark: SparkSession, docs: DataFrame, seed: int = 20, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, size: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (words taken).

    docs has doc_id, source and text (or ``size`` says how large a row is).
    A null text or one without words has size 0. A null doc_id counts as the
    smallest. No row is dropped: copies says how often it is in the mix, never
    over ``cap``. A rerun with the seed gives the same. Columns of docs by the
    new names give way. Only sums by source meet in one place.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    size = words(F.col("text")) if size is None else size
    named = docs.withColumn("_size", size).drop(*new).withColumn("_salt", F.coalesce(F.pmod("doc_id", F.lit(_SALTS)), F.lit(-1)))
    named = named.withColumn("_none", F.col("source").isNull()).withColumn("_key", F.coalesce("source", F.lit("")))
    group = ["_none", "_key", "_size", "_salt"]
    counts = written(spark, named.groupBy(*group).agg(F.count("*").alias("n")), "mix-counts")
    sizes = counts.groupBy("_none", "_key").agg(F.sum(F.col("n") * F.col("_size")).alias("source_size"))
    goals = targets(sizes.select(F.when(~F.col("_none"), F.col("_key")).alias("source"), "source_size"), weights, cap)
    goals = goals.select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_key"), "source_size", "target")
    by_size = counts.groupBy("_none", "_key", "_size").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("_none", "_key").orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    salted = Window.partitionBy("_none", "_key", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_size.select("_none", "_key", "_size", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("a"))
    firsts = counts.select(*group, F.coalesce(F.sum("n").over(salted), F.lit(0)).alias("b")).join(bases, ["_none", "_key", "_size"]).select(*group, (F.col("a") + F.col("b")).alias("_first"))
    firsts = written(spark, firsts.join(goals, ["_none", "_key"]), "mix-places")
    tie = [F.xxhash64("text")] if "text" in named.columns else []
    within = Window.partitionBy(*group).orderBy("doc_id", *tie)
    placed = named.withColumn("_nth", F.row_number().over(within)).join(firsts, group)
    i, u = F.col("_first") + F.col("_nth"), F.lit(offset(seed))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(i * rate + u) - F.floor((i - 1) * rate + u)
    kept = [c for c in docs.columns if c not in new]
    return placed.select(*kept, F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("_size")).alias("taken"))


def oracle(seed: int = 20) -> str:
    """DuckDB SQL for doc_id, size, source_size, target, taken of ``documents``."""
    u = repr(offset(seed))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
l AS (SELECT *, source_size * 3.0::DOUBLE AS most, source_size * 3.0::DOUBLE / w AS level FROM w),
c AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total,
  sum(most) OVER (ORDER BY level, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) AS most_to,
  sum(w) OVER () - sum(w) OVER (ORDER BY level, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) AS w_after FROM l),
f AS (SELECT *, most_to + level * w_after <= total AS filled FROM c),
t AS (SELECT source, source_size, CASE WHEN filled THEN most ELSE (total - coalesce(sum(CASE WHEN filled THEN most END) OVER (), 0)) * w / sum(CASE WHEN NOT filled THEN w END) OVER () END AS target FROM f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, coalesce(d.doc_id % {_SALTS}, -1), d.doc_id) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(i * rate + {u}) - floor((i - 1) * rate + {u})) * size AS BIGINT) AS taken FROM p"""
