"""Ingestion tasks as a stream: losses between stages, repeats, late events, one publication."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidemark.sources import sinks
from tidemark.streaming import tasks as K

SCHEMA = "doc long, seq long, ts timestamp, kind string, kb long, force boolean, code string"
T0 = datetime.datetime(2024, 1, 1)


def event(doc, seq, kind, kb=1, force=False, code=None):
    return (doc, seq, T0 + datetime.timedelta(minutes=seq), kind, kb, force, code)


def folded(rows):
    """The states of events in order, without a stream."""
    states = {}
    for doc, seq, _, kind, kb, force, code in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if doc is not None:
            K.advance(states.setdefault(doc, dict(K._NEW)), kind, kb, force, code)
    return {d: tuple(s[f] for f in ("status", "stage", "ready", "attempts", "interruptions", "error_stage", "error_code", "rejected", "published", "compensations")) for d, s in states.items()}


def states_of(df):
    return {r.doc: tuple(r[f] for f in ("status", "stage", "ready", "attempts", "interruptions", "error_stage", "error_code", "rejected", "published", "compensations")) for r in df.collect()}


def run(*kinds, kb=1):
    s = dict(K._NEW)
    for k in kinds:
        kind, *rest = k.split(":")
        K.advance(s, kind, int(rest[0]) if rest and rest[0].isdigit() else kb, "force" in rest, "boom")
    return s


def test_a_task_goes_through_its_stages():
    done = ["done"] * 9
    s = run("enqueue", "start", *done)
    assert (s["status"], s["ready"], s["attempts"], s["published"]) == ("completed", 511, 1, True)
    assert run("enqueue", "start", *done, "enqueue:force")["rejection"] == K.NO_REBUILD
    assert run("enqueue", "enqueue:2")["rejection"] == K.CONFLICT
    assert run("retry")["rejection"] == K.NOT_FOUND and run("retry")["status"] is None
    s = run("enqueue", "start", *done[:6], "fail")  # the publication fails and is taken back
    assert (s["status"], s["error_stage"], s["error_code"], s["compensations"], s["published"]) == ("failed", "publish", K.PUBLISH_FAILED, 1, False)
    s = run("enqueue", "start", *done[:4], "restart", "start", "done")  # parse is done again, chunks and indexes are kept
    assert (s["status"], K.STAGES[s["stage"]], s["attempts"], s["interruptions"]) == ("running", "multimodal_index", 2, 1)
    s = run("enqueue", *["start", "restart"] * 3)
    assert (s["status"], s["error_code"], s["attempts"]) == ("failed", K.INTERRUPTED, 3)
    s = run("enqueue", *["start", "restart"] * 3, "retry", "start")
    assert (s["status"], s["attempts"], s["ready"], s["error_code"]) == ("running", 1, 0, None)


def test_a_stream_that_is_killed_goes_on(spark, tmp_path):
    rng = random.Random(4)
    rows = [event(d, seq, rng.choice(["enqueue", "start", "start", "done", "done", "done", "done", "done", "fail", "restart", "retry"]), kb=rng.choice([1, 1, 1, 2]), force=rng.random() < 0.3, code="boom") for seq in range(60) for d in (*range(12), None)]
    source, root = f"{tmp_path}/in", f"file://{tmp_path}/root"
    for k in range(6):  # six files, six batches
        spark.createDataFrame([r for r in rows if r[1] // 10 == k], SCHEMA).coalesce(1).write.mode("append").parquet(f"{source}/f{k}")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    calls = []

    def publish(batch, number):
        calls.append(number)
        if calls.count(3) == 1 and number == 3:
            raise RuntimeError("killed")
        sinks.commit(batch.where("published").select("doc", "kb"), f"{root}/index{number}")

    with pytest.raises(Exception, match="killed"):
        K.run_tasks(spark, stream(), root, published=publish)
    got = states_of(K.run_tasks(spark, stream(), root, published=publish))
    assert got == folded(rows) and calls.count(3) == 2 and max(calls) >= 5
    assert states_of(K.run_tasks(spark, stream(), root)) == got  # nothing new: nothing changes
    spark.createDataFrame([event(0, 5, "fail"), event(0, 59, "fail")], SCHEMA).coalesce(1).write.parquet(f"{source}/f9")
    again = K.run_tasks(spark, stream(), root)
    assert states_of(again) == got and again.where("doc = 0").first().late == 2


def test_silence_counts_as_a_loss(spark, tmp_path):
    rows = [event(1, 0, "enqueue"), event(1, 1, "start"), event(2, 0, "enqueue"), event(2, 500, "start"), event(3, 0, "enqueue"), event(3, 1, "start"), *[event(3, 2 + k, "done") for k in range(9)]]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    got = K.run_tasks(spark, stream, f"file://{tmp_path}/root", patience_ms=3_600_000).withColumn("stage", K.stage_name(F.col("stage")))
    assert sorted((r.doc, r.status, r.interruptions, r.stage) for r in got.collect()) == [(1, "queued", 1, "parse"), (2, "running", 0, "parse"), (3, "completed", 0, None)]
