"""Readers for the input tables and the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below the one that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only where that is unset in a local
    session a temporary folder of this machine takes its place; on a cluster
    that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidemark.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidemark/{what}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = 1024, size: int = 1 << 24) -> None:
    """Bounds an Arrow batch by rows and bytes: documents are long, the default of 10,000 rows is not for them.

    Spark has no such setting for one plan, so the session's is lowered; never raised.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        own = int(spark.conf.get(name).rstrip("bB"))
        if own > most or own <= 0:
            spark.conf.set(name, str(most))


def written(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, outlives executors."""
    path = shared_dir(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
