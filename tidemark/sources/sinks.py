"""Sinks that readers never see half written: generations behind a pointer, keyed replacement, resumable builds.

A generation is a folder of its own. What readers see is named by one small
pointer file that takes its place by a rename, after the rows are counted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class CommitError(RuntimeError):
    """What was written is not what was meant; the pointer stays where it was."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, fingerprint. Equal for equal bags of rows, whatever their order; added up without gathering them."""
    own = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]), 256)
    limb = lambda i: F.sum(F.conv(F.substring(own, 1 + 12 * i, 12), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    sums = df.agg(F.count("*").alias("rows"), *[limb(i).alias(f"l{i}") for i in range(5)])
    return sums.select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[F.coalesce(F.col(f"l{i}").cast("string"), F.lit("0")) for i in range(5)]), 256).alias("fingerprint"))


def active(spark: SparkSession, root: str) -> dict | None:
    """The pointer: generation, rows; None before the first commit."""
    fs, path = _fs(spark, f"{root}/active.json")
    if not fs.exists(path):
        return None
    return json.loads(spark.read.text(f"{root}/active.json", wholetext=True).first()[0])


def commit(df: DataFrame, root: str, by: list[str] = ()) -> str:
    """Writes a generation named by its content, counts what was written, then points to it. Returns its name.

    The same rows give the same name and are not written again. A failure
    leaves the pointer, and so every reader, where it was.
    """
    spark = df.sparkSession
    mark = fingerprint(df).first()
    name = mark["fingerprint"][:24]
    place = f"{root}/generation={name}"
    fs, done = _fs(spark, f"{place}/_SUCCESS")
    if not fs.exists(done):
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(place)
    written = spark.read.schema(df.schema).parquet(place).count() if mark["rows"] else 0
    if written != mark["rows"]:
        raise CommitError(f"{written} rows of {mark['rows']} were written")
    point(spark, root, {"generation": name, "rows": mark["rows"]})
    return name


def point(spark: SparkSession, root: str, pointer: dict) -> None:
    fs, part = _fs(spark, f"{root}/active.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(pointer, sort_keys=True).encode()))
    out.close()
    _, path = _fs(spark, f"{root}/active.json")
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()) if path.toUri().getScheme() else spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    flags = spark.sparkContext._gateway.new_array(options, 1)
    flags[0] = options.OVERWRITE
    context.rename(part, path, flags)


def read(spark: SparkSession, root: str, schema) -> DataFrame:
    """The rows of the active generation; none before the first commit."""
    pointer = active(spark, root)
    if pointer is None or not pointer["rows"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/generation={pointer['generation']}")


def roll_back(spark: SparkSession, root: str, generation: str) -> None:
    """Points to an earlier generation, which must still be there."""
    fs, path = _fs(spark, f"{root}/generation={generation}/_SUCCESS")
    if not fs.exists(path):
        raise CommitError(f"no generation {generation}")
    point(spark, root, {"generation": generation, "rows": spark.read.parquet(f"{root}/generation={generation}").count()})


def prune(spark: SparkSession, root: str) -> int:
    """Deletes generations that nothing points to; returns how many."""
    pointer, n = active(spark, root), 0
    fs, path = _fs(spark, root)
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("generation=") and (pointer is None or name != f"generation={pointer['generation']}"):
            fs.delete(status.getPath(), True)
            n += 1
    return n


def replaced(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``current`` with all rows of the keys that ``changes`` has given way to those of ``changes``."""
    return current.join(changes.select(key).distinct(), key, "left_anti").select(current.columns).unionByName(changes.select(current.columns))


def deleted(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key).distinct(), key, "left_anti").select(current.columns)


def quarantined(current: DataFrame, keys: DataFrame, key: str, state: Column | str = "quarantined") -> DataFrame:
    """Rows with ``state``: searchable, or as given where the key is among ``keys``; nothing is deleted, so it can be taken back."""
    own = F.lit(state) if isinstance(state, str) else state
    marked = current.drop("state").join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.withColumn("state", F.when(F.col("_hit"), own).otherwise("searchable")).drop("_hit")


def build_missing(spark: SparkSession, todo: DataFrame, path: str, key: str, step, stamp: str) -> DataFrame:
    """A resumable build: ``step`` is applied to rows of ``todo`` whose key has no result under this ``stamp``, and all results are returned.

    ``stamp`` names the configuration; results of another one do not count.
    Each call appends one folder, written whole or not at all.
    """
    place = f"{path}/stamp={stamp}"
    fs, root = _fs(spark, place)
    schema = step(todo).schema
    done = None
    if fs.exists(root):
        done = spark.read.schema(schema).parquet(f"{place}/run=*")
    missing = todo if done is None else todo.join(done.select(key).distinct(), key, "left_anti").select(todo.columns)
    step(missing).write.parquet(f"{place}/run={uuid.uuid4().hex}")
    return spark.read.schema(schema).parquet(f"{place}/run=*")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines; nulls are written, so that every line has all fields."""
    df.write.option("ignoreNullFields", "false").json(path)


def result_json(df: DataFrame, order: list[str]) -> Column:
    """A row as JSON text with its keys sorted."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
