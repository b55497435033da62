"""Queries over evidence, attribution, coverage and cost, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evidence
from tidemark.plans.catalog import query
from tidemark.sources.tables import table


@query("""WITH b AS (SELECT o_custkey, l_suppkey, l_extendedprice AS score, l_orderkey * 8 + l_linenumber AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
g AS (SELECT o_custkey AS query_id, l_suppkey AS evidence_id, max(score) AS score, count(*) AS hits FROM b GROUP BY 1, 2),
t AS (SELECT o_custkey AS query_id, l_suppkey AS evidence_id, p, row_number() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY score DESC, p) AS n FROM b)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS rank, evidence_id, score, p AS point_id, hits FROM g JOIN t USING (query_id, evidence_id) WHERE n = 1
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) <= 5""")
def evidence_groups(spark, sf_dir):
    hits = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return evidence.group_hits(hits.select(F.col("o_custkey").alias("query_id"), F.col("l_suppkey").alias("evidence_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"), F.col("l_extendedprice").alias("score")), 5)


@query("SELECT conv_id, turn, right(lag(text) OVER w, 80) AS before, left(lead(text) OVER w, 80) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbour_context(spark, sf_dir):
    return evidence.context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 80).select("conv_id", "turn", "before", "after")


@query("""WITH b AS (SELECT conv_id, turn, text, role = 'user' AS title, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations),
t AS (SELECT conv_id, n, list(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS p FROM b WHERE title)
SELECT b.conv_id, b.turn, array_to_string(t.p, ' > ') AS path FROM b LEFT JOIN t ON b.conv_id = t.conv_id AND b.n = t.n""")
def running_title_path(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    blocks = c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("at"), F.when(F.col("role") == "user", "title").otherwise("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))
    return evidence.title_path(blocks).select(F.col("document_id").alias("conv_id"), F.col("at").alias("turn"), "path")


@query("SELECT conv_id, max(turn) + 1 AS next_turn, count(*) AS n FROM conversations GROUP BY 1")
def next_position(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT l_suppkey AS node, l_partkey AS neighbour, l_orderkey * 8 + l_linenumber AS edge FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY node, neighbour ORDER BY edge) AS nth FROM e)
SELECT node, neighbour, edge, row_number() OVER (PARTITION BY node ORDER BY nth, neighbour) AS turn FROM n QUALIFY turn <= 20""")
def neighbour_round_robin(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_partkey").alias("neighbour"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge"))
    return evidence.neighbour_turns(edges, 20).select("node", "neighbour", "edge", F.col("turn").cast("long"))


@query("""WITH o AS (SELECT l_orderkey AS k, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), p AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS c FROM orders)
SELECT CASE WHEN a IS NULL THEN 'unknown' WHEN a <> b THEN 'ambiguous' WHEN c IS NULL THEN 'null' WHEN c = a THEN 'correct' ELSE 'conflict' END AS state, count(*) AS n FROM p LEFT JOIN o USING (k) GROUP BY 1""")
def point_attribution(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("c"))
    owners = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"))
    return evidence.attribute(points, owners, "k", "c", "s").groupBy("state").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT DISTINCT doc_id FROM labels)
SELECT lang, source, count(*) AS expected, count(l.doc_id) AS found, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id GROUP BY 1, 2""")
def coverage_buckets(spark, sf_dir):
    return evidence.coverage(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels"), "doc_id", ["lang", "source"])


@query("""WITH h AS (SELECT o_custkey AS q, o_orderkey AS d, min(l_returnflag) AS a, max(l_returnflag) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45 GROUP BY 1, 2)
SELECT CASE WHEN a IS NULL THEN 'none' WHEN a = b THEN a ELSE 'multiple' END AS found_by, count(*) AS n FROM orders LEFT JOIN h ON o_custkey = q AND o_orderkey = d WHERE o_orderpriority = '1-URGENT' GROUP BY 1""")
def branch_recovery(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), "o_orderpriority")
    hits = table(spark, sf_dir, "lineitem").where("l_quantity > 45").join(o, F.col("l_orderkey") == F.col("doc_id")).select("query_id", "doc_id", F.col("l_returnflag").alias("branch"))
    return evidence.recovery(hits, o.where("o_orderpriority = '1-URGENT'").select("query_id", "doc_id"), ["A", "N", "R"]).groupBy("found_by").agg(F.count("*").alias("n"))


@query("""SELECT role, count(*) AS calls, round(CAST(sum(CAST(length(text) AS DECIMAL(12,0)) * CAST(0.5 AS DECIMAL(4,2)) + CAST(turn AS DECIMAL(12,0)) * CAST(1.25 AS DECIMAL(4,2))) AS DOUBLE) / 1000, 6) AS cost FROM conversations GROUP BY 1""")
def usage_cost(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    price = evidence.cost(F.char_length("text"), F.col("turn"), F.lit("0.5"), F.lit("1.25"))
    return c.groupBy("role").agg(F.count("*").alias("calls"), F.round(F.sum(price).cast("double"), 6).alias("cost"))


@query(r"""WITH t AS (SELECT doc_id, [CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])data([^a-z0-9_]|$)') THEN 'data' END, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])license([^a-z0-9_]|$)') THEN 'terms' END] AS h FROM documents),
u AS (SELECT list_filter(h, lambda x: x IS NOT NULL) AS h FROM t) SELECT CASE WHEN len(h) = 0 THEN 'unclassified' WHEN len(h) = 1 THEN h[1] ELSE 'ambiguous' END AS subject, count(*) AS n FROM u GROUP BY 1""")
def subject_classes(spark, sf_dir):
    return evidence.classify(table(spark, sf_dir, "documents"), "text", {"data": "data", "terms": "license"}).groupBy("subject").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_custkey AS q, o_orderkey AS d, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r1, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r2 FROM orders),
m AS (SELECT q, d, CASE WHEN r1 <= 3 THEN r1 ELSE 1000 + r2 END AS k FROM a WHERE r1 <= 3 OR r2 <= 6), n AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY k, d) AS r FROM m)
SELECT q AS query_id, d AS doc_id, r AS rank, 'C' || r AS marker FROM n WHERE r <= 6""")
def candidate_merge(spark, sf_dir):
    from pyspark.sql import Window

    o, w = table(spark, sf_dir, "orders"), Window.partitionBy("o_custkey")
    ranked = lambda *order: o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(w.orderBy(*order)).alias("rank"))
    return evidence.merge_candidates(ranked(F.desc("o_totalprice"), F.col("o_orderkey")).where("rank <= 3"), ranked("o_orderdate", "o_orderkey").where("rank <= 6"), 6)


@query("SELECT p_type AS kind, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, kind LIMIT 20")
def type_options(spark, sf_dir):
    return evidence.options(table(spark, sf_dir, "part").withColumnRenamed("p_type", "kind"), "kind").withColumnRenamed("count", "n")
