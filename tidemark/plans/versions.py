"""Queries over keyed tables with versions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.catalog import query
from tidemark.sources.keyed import POINTS, KeyedTable
from tidemark.sources.tables import shared_dir, table

_TOXIC = "doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"


class Lost(RuntimeError):
    """Stands for a writer that is gone."""


def _lost_at(point: str):
    def passed(name: str) -> None:
        if name == point:
            raise Lost(name)

    return passed


def _documents(spark, sf_dir, passed=None):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.lit(False).alias("quarantined"))
    held = KeyedTable(spark, shared_dir(spark, "keyed"), d.schema, "doc_id", 32, passed)
    return d, held, table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")


@query(f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS lang FROM documents),
s AS (SELECT 'first' AS state, doc_id, lang FROM documents UNION ALL SELECT 'replaced', * FROM r UNION ALL SELECT 'deleted', * FROM r WHERE NOT ({_TOXIC})
UNION ALL SELECT 'after_loss', * FROM r WHERE NOT ({_TOXIC}) UNION ALL SELECT 'restored', doc_id, lang FROM documents)
SELECT state, lang, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM s GROUP BY 1, 2""")
def keyed_replace(spark, sf_dir):
    """A table through replacement, deletion, a replacement that is lost half way, and back to its first version."""
    d, held, toxic = _documents(spark, sf_dir)
    versions = {"first": held.create(d)}
    versions["replaced"] = held.replace(d.where("doc_id % 10 = 0").withColumn("lang", F.lit("xx")))
    versions["deleted"] = held.delete(toxic)
    held.passed = _lost_at("manifest")
    try:
        held.replace(d.withColumn("lang", F.lit("lost")))
    except Lost:
        held.recover()
    versions["after_loss"] = held.version()
    held.restore(versions["first"])
    versions["restored"] = held.version()
    every = None
    for state, version in versions.items():
        rows = held.read(version).select(F.lit(state).alias("state"), "doc_id", "lang")
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("state", "lang").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(f"""WITH s AS (SELECT 'hidden' AS state, source, {_TOXIC} OR doc_id % 50 = 0 AS quarantined, lang FROM documents
UNION ALL SELECT 'shown', source, doc_id % 50 = 0, CASE WHEN doc_id % 3 = 0 THEN 'yy' ELSE lang END FROM documents)
SELECT state, source, quarantined, count(*) AS n, count(*) FILTER (WHERE lang = 'yy') AS changed FROM s GROUP BY 1, 2, 3""")
def quarantine_restore(spark, sf_dir):
    """Toxic documents hidden, other columns changed meanwhile, and the visibility of before restored: what was hidden then stays hidden, the change stays."""
    d, held, toxic = _documents(spark, sf_dir)
    before = held.create(d.withColumn("quarantined", F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))))
    hidden = held.update(toxic, quarantined=F.lit(True))
    held.update(d.where("doc_id % 3 = 0"), lang=F.lit("yy"))
    shown = held.restore_columns(before, toxic.join(d, "doc_id", "left_semi"), "source", "quarantined")
    rows = [held.read(v).withColumn("state", F.lit(s)) for s, v in (("hidden", hidden), ("shown", shown))]
    return rows[0].unionByName(rows[1]).groupBy("state", "source", "quarantined").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "yy").alias("changed"))


@query("""SELECT p.point, p.found, s.step, count(*) AS n, count(*) FILTER (WHERE d.quarantined) AS quarantined
FROM (VALUES ('pending', 'dropped'), ('data', 'dropped'), ('manifest', 'dropped'), ('pointer', 'kept')) p(point, found) CROSS JOIN (VALUES ('lost'), ('recovered'), ('again')) s(step)
CROSS JOIN LATERAL (SELECT doc_id % 2 = 0 AND (p.point = 'pointer' OR s.step = 'again') AS quarantined FROM documents) d GROUP BY 1, 2, 3""")
def commit_recovery(spark, sf_dir):
    """What readers see of a change whose writer is lost at each of its points: right after, after recovery, and after the change was made again."""
    every = None
    for point in POINTS:
        d, held, _ = _documents(spark, sf_dir)
        held.create(d)
        held.passed = _lost_at(point)
        even = d.where("doc_id % 2 = 0").withColumn("quarantined", F.lit(True))
        try:
            held.replace(even)
        except Lost:
            seen = [("lost", held.version())]
        found = held.recover()
        seen.append(("recovered", held.version()))
        held.passed = lambda _: None
        seen.append(("again", held.replace(even)))
        for step, version in seen:
            rows = held.read(version).select(F.lit(point).alias("point"), F.lit(found).alias("found"), F.lit(step).alias("step"), "quarantined")
            every = rows if every is None else every.unionByName(rows)
    return every.groupBy("point", "found", "step").agg(F.count("*").alias("n"), F.count_if("quarantined").alias("quarantined"))
