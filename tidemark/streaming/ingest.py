"""Incremental ingestion: file streams into keyed state, each batch published once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.sources.tables import shared_dir


def ingest_available(spark: SparkSession, source: str, schema, key: str, names: str = "*", root: str | None = None) -> DataFrame:
    """Takes all new files of ``source`` whose names match in as micro-batches and returns the published rows, one of each key.

    A rerun with the same ``root`` goes on where it stopped (without one a new
    folder is taken); a batch writes its own folder anew, so a repeated batch
    does not repeat rows.
    """
    root = root or shared_dir(spark, "ingested")
    out, checkpoint = f"{root}/rows", f"{root}/checkpoint"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", names).parquet(source)

    def publish(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch").dropDuplicates([key])


def tumbling(events: DataFrame, minutes: int = 5, late: str | None = None) -> DataFrame:
    """Events and distinct users by type in UTC buckets of ``minutes``, floored within the hour.

    A stream has a watermark of ``late``, windows that divide the hour and users to 1 %.
    """
    users = F.count_distinct("user_id")
    if events.isStreaming:  # a stream keeps no set of users, and its time needs a zone
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late or "0 seconds")
        return events.groupBy(F.window("ts", f"{minutes} minutes").alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.approx_count_distinct("user_id", 0.01).alias("users"))
    bucket = F.date_trunc("hour", "ts") + F.make_dt_interval(mins=(F.floor(F.minute("ts") / minutes) * minutes).cast("int"))
    return events.groupBy(bucket.alias("bucket"), "event_type").agg(F.count("*").alias("n"), users.alias("users"))
