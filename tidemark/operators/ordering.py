"""Places in an order without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.sources.tables import written


def numbered(spark: SparkSession, rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with place, from 1 within their key (never null) by ``order`` (nulls first).

    Spark deals ranges of (key, order) to tasks, so a common key is spread over
    many; only the row counts of key and range are added up in one place.
    """
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_id", F.monotonically_increasing_id())
    placed = written(spark, ranged.withColumn("_part", F.shiftright("_id", 33)), "ordered")
    counts = placed.groupBy(key, "_part").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(key, "_part", (F.col("_first") - before).alias("_from"))
    return placed.join(starts, [key, "_part"]).select(*rows.columns, (F.col("_id") - F.col("_from") + 1).alias("place"))
