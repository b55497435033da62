"""Ingestion in stages: one keyed state for each document's task, each batch published once.

Events of a task (doc, seq, ts, kind, kb, force, code) come as a stream; Spark
keeps the task's state by document and its checkpoint is what a restart goes on from.
Kinds are enqueue, retry, start, done and fail (the stage at hand), restart (its
process was lost). A task that says nothing for some time counts as lost too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState

from tidemark.sources import sinks

# The stages in their order, the most runs, and the codes of refusals and losses.
STAGES = ("parse", "chunk", "text_index", "sparse_index", "multimodal_index", "visual_index", "publish", "verify", "graph")
MAX_ATTEMPTS = 3
CONFLICT, NO_REBUILD, NOT_FOUND, INTERRUPTED, PUBLISH_FAILED = "ingestion_task_conflict", "rebuild_not_supported", "ingestion_task_not_found", "ingestion_interrupted", "publish_failed"
#: Stages that a run after a loss does not repeat if they were done: what they prepared is kept.
KEPT = frozenset(("chunk", "text_index", "sparse_index", "multimodal_index", "visual_index", "graph"))

STATE = "kb long, status string, stage int, ready int, attempts int, interruptions int, error_stage string, error_code string, rejected int, rejection string, published boolean, compensations int, late int, seq long, ts long"
_FIELDS = [f.split()[0] for f in STATE.split(", ")]
_NEW = dict.fromkeys(_FIELDS) | {"stage": 0, "ready": 0, "attempts": 0, "interruptions": 0, "rejected": 0, "published": False, "compensations": 0, "late": 0}


def _next_stage(ready: int, after: int) -> int:
    """The first stage after ``after`` that a run has to do."""
    return next((k for k in range(after + 1, len(STAGES)) if not (STAGES[k] in KEPT and ready >> k & 1)), len(STAGES))


def _queued(s: dict) -> None:
    s.update(status="queued", stage=0, ready=0, error_stage=None, error_code=None, published=False)


def _lost(s: dict) -> None:
    """The process is gone: the task waits again with what its stages prepared, or is given up."""
    if s["status"] in ("queued", "running"):
        s["interruptions"] += 1
        if s["attempts"] >= MAX_ATTEMPTS:
            s.update(status="failed", error_code=INTERRUPTED)
        else:
            s.update(status="queued")


def advance(s: dict, kind: str, kb: int | None, force: bool, code: str | None) -> None:
    """A task after one event. What is not allowed is counted as rejected, what has no meaning in this state does nothing."""
    status, refused = s["status"], None
    if kind == "enqueue":
        if status is None:
            s["kb"] = kb
            _queued(s)
        elif kb != s["kb"]:
            refused = CONFLICT
        elif status == "completed" and force:
            refused = NO_REBUILD
        elif status == "failed" and force:
            _queued(s)
    elif kind == "retry":
        if status is None:
            refused = NOT_FOUND
        elif status == "completed":
            refused = NO_REBUILD
        elif status == "failed":
            _queued(s)
            s["attempts"] = 0
    elif kind == "start" and status == "queued":
        s.update(status="running", attempts=s["attempts"] + 1, stage=_next_stage(s["ready"], -1))
    elif kind == "done" and status == "running":
        s["ready"] |= 1 << s["stage"]
        s["published"] |= STAGES[s["stage"]] == "publish"
        s["stage"] = _next_stage(s["ready"], s["stage"])
        if s["stage"] == len(STAGES):
            s["status"] = "completed"
    elif kind == "fail" and status == "running":
        publishing = STAGES[s["stage"]] == "publish"  # what was written of it is taken back
        s.update(status="failed", error_stage=STAGES[s["stage"]], error_code=PUBLISH_FAILED if publishing else code, compensations=s["compensations"] + publishing)
        s["published"] = s["published"] and not publishing
    elif kind == "restart":
        _lost(s)
    if refused:
        s["rejected"] += 1
        s["rejection"] = refused


def _step(patience: int | None, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """All events of a task in one batch, by seq; repeats and those before the last one seen are late and change nothing."""
    s = dict(zip(_FIELDS, state.get)) if state.exists else dict(_NEW)
    if state.hasTimedOut:
        _lost(s)
    else:
        events = pd.concat(frames).sort_values("seq", kind="stable")
        for seq, ts, kind, kb, force, code in zip(*(events[c].astype(object).where(events[c].notna(), None) for c in ("seq", "ts", "kind", "kb", "force", "code"))):
            if s["seq"] is not None and seq <= s["seq"]:
                s["late"] += 1
                continue
            s["seq"], s["ts"] = seq, int(ts)
            advance(s, kind, kb, bool(force), code)
    state.update(tuple(s[f] for f in _FIELDS))
    if patience is not None and not state.hasTimedOut and s["status"] in ("queued", "running"):
        state.setTimeoutTimestamp(max(s["ts"] + patience, state.getCurrentWatermarkMs() + 1))
    row = pd.DataFrame([{"doc": key[0], **s}])
    yield row.astype({f: "Int64" for f in ("kb", "seq", "ts")} | {f: "Int32" for f in ("stage", "ready", "attempts", "interruptions", "rejected", "compensations", "late")})


def task_states(events: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """The state of each task that a batch of the stream changed: doc and the fields of STATE.

    A task that is queued or running and had no event for ``patience_ms`` of
    event time counts as lost. A document's events of one batch are sorted in
    one task: a batch's files bound them. Null documents have no task.
    """
    known = events.where("doc IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    if patience_ms is not None:
        known = known.withWatermark("ts", "0 seconds")
    told = known.select("doc", "seq", F.unix_millis("ts").alias("at"), "kind", "kb", "force", "code", *(["ts"] if patience_ms is not None else []))
    told = told.withColumnRenamed("ts", "event_time").withColumnRenamed("at", "ts")
    return told.groupBy("doc").applyInPandasWithState(partial(_step, patience_ms), f"doc long, {STATE}", STATE, "update", "NoTimeout" if patience_ms is None else "EventTimeTimeout")


def run_tasks(spark: SparkSession, events: DataFrame, root: str, patience_ms: int | None = None, published: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Takes all events that are there and returns the last state of each task.

    ``root`` keeps checkpoint and states: a call with the same one goes on where
    the last stopped, wherever that was. A batch writes its own folder anew and
    ``published`` gets it with its number (for one commit of what it published), so a
    batch that is repeated after a loss counts once.
    """
    out = f"{root}/states"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if published:
            published(spark.read.schema(batch.schema).parquet(f"{out}/batch={number}"), number)

    states = task_states(events, patience_ms)
    states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    fs, path = sinks._fs(spark, out)
    if not fs.exists(path):
        return spark.createDataFrame([], states.schema)
    last = Window.partitionBy("doc").orderBy(F.desc("batch"))
    rows = spark.read.schema(f"doc long, {STATE}, batch long").parquet(out)
    return rows.withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth", "batch")


def stage_name(stage: Column) -> Column:
    """The name of a stage by its number; null past the last."""
    return F.get(F.array(*map(F.lit, STAGES)), stage)
