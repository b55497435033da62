"""Queries over streams of the input tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.catalog import query
from tidemark.sources.tables import shared_dir, table
from tidemark.streaming import tasks as K

_PATIENCE = 12 * 3_600_000

_NEXT = "list_min(list_filter(range(0, 10), lambda t: t > {after} AND (t IN (0, 6, 7, 9) OR ({ready} >> t) % 2 = 0)))"

# The events of a document (user) in order, folded one by one into its task's state.
_TASKS = f"""RECURSIVE ev AS (SELECT user_id AS doc, event_id AS seq, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
  CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 6 = 1 THEN 'retry' WHEN event_id % 2 = 0 THEN 'enqueue' ELSE 'start' END WHEN 'view' THEN 'start'
    WHEN 'error' THEN CASE event_id % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'restart' ELSE 'done' END ELSE 'done' END AS kind,
  user_id % 7 + CASE WHEN event_id % 29 = 0 THEN 1 ELSE 0 END AS kb, event_id % 4 = 0 AS forced, 'code_' || (event_id % 3) AS code FROM events),
fold AS (
  SELECT DISTINCT doc, 0::BIGINT AS i, NULL::BIGINT AS kb, NULL::VARCHAR AS status, 0::BIGINT AS stage, 0::BIGINT AS ready, 0 AS attempts, 0 AS interruptions, NULL::VARCHAR AS error_stage, NULL::VARCHAR AS error_code, 0 AS rejected, NULL::VARCHAR AS rejection, false AS published, 0 AS compensations FROM ev
  UNION ALL
  SELECT doc, i, CASE WHEN fresh THEN own ELSE kb END, new_status, CASE WHEN anew THEN 0 WHEN starts OR steps THEN new_stage ELSE stage END, new_ready,
    CASE WHEN starts THEN attempts + 1 WHEN anew AND kind = 'retry' THEN 0 ELSE attempts END, interruptions + CAST(loses AS INTEGER),
    CASE WHEN anew THEN NULL WHEN fails THEN stages[stage + 1] ELSE error_stage END,
    CASE WHEN anew THEN NULL WHEN fails THEN CASE WHEN stage = 6 THEN 'publish_failed' ELSE code END WHEN loses AND attempts >= 3 THEN 'ingestion_interrupted' ELSE error_code END,
    rejected + CAST(refused IS NOT NULL AS INTEGER), coalesce(refused, rejection),
    CASE WHEN anew THEN false WHEN steps AND stage = 6 THEN true WHEN fails AND stage = 6 THEN false ELSE published END, compensations + CAST(fails AND stage = 6 AS INTEGER)
  FROM (SELECT *, CASE WHEN anew THEN 'queued' WHEN starts THEN 'running' WHEN steps AND new_stage = 9 THEN 'completed' WHEN fails THEN 'failed' WHEN loses THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS new_status
    FROM (SELECT *, CASE WHEN starts THEN {_NEXT.format(after='-1', ready='new_ready')} WHEN steps THEN {_NEXT.format(after='stage', ready='new_ready')} END AS new_stage
      FROM (SELECT *, fresh OR again AS anew, CASE WHEN fresh OR again THEN 0 WHEN steps THEN ready | (1 << stage) ELSE ready END AS new_ready
        FROM (SELECT f.doc, e.i, f.kb, f.status, f.stage, f.ready, f.attempts, f.interruptions, f.error_stage, f.error_code, f.rejected, f.rejection, f.published, f.compensations, e.kb AS own, e.kind, e.code,
          ['parse', 'chunk', 'text_index', 'sparse_index', 'multimodal_index', 'visual_index', 'publish', 'verify', 'graph'] AS stages,
          kind = 'enqueue' AND status IS NULL AS fresh,
          coalesce(status = 'failed' AND (kind = 'retry' OR kind = 'enqueue' AND e.kb = f.kb AND forced), false) AS again,
          coalesce(kind = 'start' AND status = 'queued', false) AS starts, coalesce(kind = 'done' AND status = 'running', false) AS steps, coalesce(kind = 'fail' AND status = 'running', false) AS fails,
          coalesce(kind = 'restart' AND status IN ('queued', 'running'), false) AS loses,
          CASE WHEN kind = 'enqueue' AND status IS NOT NULL AND e.kb <> f.kb THEN 'ingestion_task_conflict' WHEN kind = 'retry' AND status IS NULL THEN 'ingestion_task_not_found'
            WHEN status = 'completed' AND (kind = 'retry' OR kind = 'enqueue' AND forced) THEN 'rebuild_not_supported' END AS refused
        FROM fold f JOIN ev e ON e.doc = f.doc AND e.i = f.i + 1))))),
ends AS (SELECT f.*, e.ms FROM fold f JOIN ev e ON e.doc = f.doc AND e.i = f.i QUALIFY row_number() OVER (PARTITION BY f.doc ORDER BY f.i DESC) = 1),
fin AS (SELECT *, coalesce(status IN ('queued', 'running') AND ms + {_PATIENCE} < (SELECT max(ms) FROM ev), false) AS silent FROM ends)"""


def task_events(events):
    """Tasks of documents from the table of events: a user is a document, what happens to it follows from an event's type and id."""
    at = F.col("event_id")
    signup = F.when(at % 6 == 1, "retry").when(at % 2 == 0, "enqueue").otherwise("start")
    error = F.when(at % 4 == 0, "fail").when(at % 4 == 1, "restart").otherwise("done")
    kind = F.when(F.col("event_type") == "signup", signup).when(F.col("event_type") == "view", "start").when(F.col("event_type") == "error", error).otherwise("done")
    kb = F.col("user_id") % 7 + F.when(at % 29 == 0, 1).otherwise(0)
    return events.select(F.col("user_id").alias("doc"), at.alias("seq"), "ts", kind.alias("kind"), kb.alias("kb"), (at % 4 == 0).alias("force"), F.concat(F.lit("code_"), (at % 3).cast("string")).alias("code"))


@query(f"""WITH {_TASKS} SELECT doc, kb, CASE WHEN silent THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS status, CASE WHEN status = 'completed' THEN NULL ELSE ['parse', 'chunk', 'text_index', 'sparse_index', 'multimodal_index', 'visual_index', 'publish', 'verify', 'graph'][stage + 1] END AS stage,
ready, attempts, interruptions + CAST(silent AS INTEGER) AS interruptions, error_stage, CASE WHEN silent AND attempts >= 3 THEN 'ingestion_interrupted' ELSE error_code END AS error_code, rejected, rejection, published, compensations FROM fin""")
def ingestion_tasks(spark, sf_dir):
    """The last states of all tasks, from a stream of the table's files."""
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    last = K.run_tasks(spark, task_events(stream), shared_dir(spark, "tasks"), _PATIENCE)
    return last.select("doc", "kb", "status", K.stage_name(F.col("stage")).alias("stage"), "ready", "attempts", "interruptions", "error_stage", "error_code", "rejected", "rejection", "published", "compensations")
