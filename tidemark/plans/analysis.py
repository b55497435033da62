"""Queries over tables in HTML, questions and evaluation, and their SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Window, functions as F

from tidemark.functions import questions as Q, text as T
from tidemark.operators import evaluation as E, similarity, tables
from tidemark.plans.catalog import query
from tidemark.sources import html_tables
from tidemark.sources.tables import table, written

# ---- tables: the suppliers of a nation as one HTML table --------------------------------------

_ROWS = """t AS (SELECT s_nationkey AS k, s_suppkey, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 1 AS r FROM supplier)"""


def _html(spark, d):
    v = F.col("s_acctbal").cast("decimal(12,2)")
    money = F.when(F.col("s_suppkey") % 9 == 0, "N/A").when(v < 0, F.concat(F.lit("("), F.format_number(-v, 2), F.lit(")"))).otherwise(F.format_number(v, 2))
    share = F.when(F.col("s_suppkey") % 7 == 0, "-").otherwise(F.concat((F.col("s_suppkey") % 50).cast("string"), F.lit(".5 %")))
    note = F.when(F.col("s_suppkey") % 5 == 0, "12").otherwise("see  note")
    row = F.concat(F.lit("<tr><td>"), "s_name", F.lit("</td><td>"), money, F.lit("</td><td>"), share, F.lit("</td><td>"), note, F.lit("</td></tr>"))
    head = "<table><tr><th rowspan=2>Supplier</th><th colspan=2>2023</th><th rowspan=2>Remark<script>x()</script></th></tr><tr><th>Balance (USD)</th><th>Share (%)</th></tr>"
    rows = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("h")))), lambda x: x["h"]), "").alias("h"))
    return rows.select("k", F.concat(F.lit("<p>before</p>" + head), "h", F.lit("</table><table><tr><td>9</td></tr></table>")).alias("html"))


@query(f"""WITH {_ROWS} SELECT k, CAST(r AS INTEGER) AS row, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE v END AS balance, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey % 50 + 0.5::DOUBLE END AS share FROM t""")
def table_html_values(spark, sf_dir):
    cells = html_tables.cells(_html(spark, sf_dir), "k", "html").where("row >= 2")
    return cells.groupBy("k", "row").agg(F.max(F.when(F.col("col") == 1, F.col("value"))).cast("double").alias("balance"), F.max(F.when((F.col("col") == 2) & F.col("percent"), F.col("value"))).cast("double").alias("share"))


@query(f"""WITH {_ROWS}, g AS (SELECT k, count(*) FILTER (s_suppkey % 9 > 0) AS a, count(*) FILTER (s_suppkey % 7 > 0) AS b, count(*) FILTER (s_suppkey % 5 = 0) AS c, count(*) AS n, min(CASE WHEN (s_suppkey % 9 > 0)::INT + (s_suppkey % 7 > 0)::INT + (s_suppkey % 5 = 0)::INT >= 2 THEN r END) AS start FROM t GROUP BY 1),
d AS (SELECT g.k, g.start, count(*) FILTER (s_suppkey % 9 > 0) AS a, count(*) FILTER (s_suppkey % 7 > 0) AS b, count(*) FILTER (s_suppkey % 5 = 0) AS c, count(*) AS n FROM g JOIN t ON t.k = g.k AND t.r >= g.start GROUP BY 1, 2)
SELECT k, col, CASE col WHEN 1 THEN 'USD' WHEN 2 THEN '%' END AS unit, CASE WHEN col IN (1, 2) THEN 2023 END AS year, CAST(start AS INTEGER) AS data_start,
CASE col WHEN 0 THEN 'text' WHEN 1 THEN CASE WHEN a = 0 THEN 'text' ELSE 'number' END WHEN 2 THEN CASE WHEN b = 0 THEN 'text' ELSE 'percent' END ELSE CASE WHEN c = 0 THEN 'text' WHEN c < n THEN 'mixed' ELSE 'number' END END AS kind
FROM d, (SELECT unnest([0, 1, 2, 3])::INTEGER AS col)""")
def table_html_columns(spark, sf_dir):
    cells = html_tables.cells(_html(spark, sf_dir), "k", "html")
    return html_tables.columns(cells, "k").select("k", "col", "unit", "year", "data_start", "kind")


@query(f"""WITH {_ROWS} SELECT k, CAST(r - 1 AS INTEGER) AS row, v AS balance FROM t""")
def table_markdown_values(spark, sf_dir):
    row = F.concat(F.lit("| "), "s_name", F.lit(" | "), F.col("s_acctbal").cast("decimal(12,2)").cast("string"), F.lit(" |"))
    rows = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("h")))), lambda x: x["h"]), "\n").alias("h"))
    text = rows.select("k", F.concat(F.lit("Balances\n\n| Supplier | Balance |\n|:---|---:|\n"), "h", F.lit("\n\nDone | no.")).alias("text"))
    return html_tables.cells(text, "k", "text", markdown=True).where("row > 0 AND col = 1").select("k", "row", F.col("value").cast("double").alias("balance"))


@query("SELECT s_suppkey AS row, s_name, s_nationkey, CASE s_suppkey WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 7 THEN 2 END AS request FROM supplier WHERE s_suppkey IN (3, 1, 7) UNION ALL SELECT s_suppkey, s_name, s_nationkey, 3 FROM supplier WHERE s_suppkey = 3")
def table_select_labels(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), "s_name", "s_nationkey", "s_acctbal")
    return tables.select(df, [0, "  S_NATIONKEY", "s_name"], [3, "supplier#000000001 ", 7, " SUPPLIER#000000003"], labels="s_name").withColumn("request", F.col("request").cast("int"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) <> 'small ring' AND contains(lower(p_type), 'eco')")
def table_filter_text(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return tables.filter_text(tables.filter_text(p, F.concat(F.lit(" "), F.upper("p_name")), "ne", "Small   Ring"), F.col("p_type"), "contains", " ECO").select("p_partkey")


@query("SELECT p_partkey AS row, p_name FROM part ORDER BY lower(p_name) DESC, p_partkey DESC LIMIT 50")
def table_sort_text(spark, sf_dir):
    return tables.sort(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"), "p_name"), "p_name", descending=True, text=True)


@query("""WITH g AS (SELECT o_custkey, CAST(sum(CASE WHEN year(o_orderdate) = 1996 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS a, CAST(sum(CASE WHEN year(o_orderdate) = 1997 THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DECIMAL(18,2)) AS b FROM orders GROUP BY 1)
SELECT o_custkey, CAST(b - a AS DOUBLE) AS delta, CASE WHEN a <> 0 THEN round(CAST(b - a AS DOUBLE) / CAST(a AS DOUBLE) * 100, 4) END AS relative FROM g""")
def table_growth_across(spark, sf_dir):
    of = lambda y: F.sum(F.when(F.year("o_orderdate") == y, F.col("o_totalprice").cast("decimal(18,2)")).otherwise(F.lit(Decimal("0.00"))))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(of(1996).alias("a"), of(1997).alias("b"))
    return tables.growth_across(g, "a", "b").select("o_custkey", F.col("delta").cast("double"), F.col("relative").cast("double").alias("relative"))


# ---- questions: the turns of conversations, made into questions -------------------------------

_Q = """q AS (SELECT conv_id, turn, lower(regexp_extract(text, '[A-Za-z]+ [A-Za-z]+', 0)) AS s, turn % 6 AS m FROM conversations WHERE text IS NOT NULL),
asked AS (SELECT *, CASE m WHEN 0 THEN 'Please delete ' || s WHEN 1 THEN s || '?' WHEN 2 THEN 'compare ' || s || ', then stop' WHEN 3 THEN '  Hello, ' || s || '! ' WHEN 4 THEN 'How many ' || s || ' are there in all of it' ELSE '请问' || s || '的图是多少呢' END AS question FROM q)"""


def _asked(spark, d):
    c = table(spark, d, "conversations").where("text IS NOT NULL")
    s, m = F.lower(F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0)), F.col("turn") % 6
    text = F.when(m == 0, F.concat(F.lit("Please delete "), s)).when(m == 1, F.concat(s, F.lit("?"))).when(m == 2, F.concat(F.lit("compare "), s, F.lit(", then stop"))).when(m == 3, F.concat(F.lit("  Hello, "), s, F.lit("! "))).when(m == 4, F.concat(F.lit("How many "), s, F.lit(" are there in all of it"))).otherwise(F.concat(F.lit("请问"), s, F.lit("的图是多少呢")))
    return c.select("conv_id", "turn", s.alias("s"), text.alias("question"), "text")


@query(f"""WITH {_Q} SELECT conv_id, turn, CASE m WHEN 0 THEN 'please delete ' || s WHEN 1 THEN s WHEN 2 THEN 'compare ' || s || ', then stop' WHEN 3 THEN s WHEN 4 THEN 'how many ' || s || ' are there in all of it' ELSE s || '的图是多少' END AS stripped, m = 0 AS writes, CASE m WHEN 5 THEN 'explicit' ELSE 'plain' END AS intent FROM asked WHERE s <> ''""")
def question_rules(spark, sf_dir):
    q = _asked(spark, sf_dir).where("s <> ''")
    return q.select("conv_id", "turn", Q.stripped(F.col("question")).alias("stripped"), Q.writes(F.col("question")).alias("writes"), Q.visual_intent(F.col("question")).alias("intent"))


@query(f"""WITH {_Q}, p AS (SELECT *, s <> '' AND NOT (contains(s, 'list') OR contains(s, 'steps') OR contains(s, 'process') OR contains(s, 'across') OR contains(s, 'compare') OR contains(s, 'overview')) AS plain FROM asked)
SELECT conv_id, turn, CASE m WHEN 0 THEN plain AND (length(s) + 14 <= 24 OR (length(s) + 14 <= 40 AND (contains(s, 'who') OR contains(s, 'when') OR contains(s, 'where') OR contains(s, 'which')))) WHEN 1 THEN plain AND (length(s) <= 24 OR (length(s) <= 40 AND (contains(s, 'who') OR contains(s, 'when') OR contains(s, 'where') OR contains(s, 'which')))) WHEN 3 THEN plain AND (length(s) <= 24 OR (length(s) <= 40 AND (contains(s, 'who') OR contains(s, 'when') OR contains(s, 'where') OR contains(s, 'which'))))
  WHEN 4 THEN plain AND length(s) + 32 <= 40 WHEN 5 THEN plain AND length(s) + 5 <= 40 ELSE false END AS simple FROM p WHERE s <> ''""")
def question_simple(spark, sf_dir):
    return _asked(spark, sf_dir).where("s <> ''").select("conv_id", "turn", Q.simple(F.col("question")).alias("simple"))


@query("""WITH b AS (SELECT item_id, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) >= 2)) AS terms, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) >= 2)[1] AS f, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS own FROM benchmark),
d AS (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS hay FROM documents),
j AS (SELECT item_id, doc_id, terms, f, hay FROM b JOIN d ON doc_id % 40 = item_id % 40)
SELECT item_id, doc_id, round(len(list_filter(terms, lambda t: contains(hay, t) OR (length(t) >= 3 AND contains(hay, substr(t, 1, 2)))))::DOUBLE / len(terms), 6) AS coverage,
trim(hay, ' ') = '' OR NOT (contains(hay, f) OR (length(f) >= 3 AND contains(hay, substr(f, 1, 2)))) OR len(list_filter(terms, lambda t: contains(hay, t) OR (length(t) >= 3 AND contains(hay, substr(t, 1, 2)))))::DOUBLE / len(terms) < 0.5 AS escalates FROM j WHERE len(terms) > 0""")
def question_coverage(spark, sf_dir):
    asked = written(spark, table(spark, sf_dir, "benchmark").select("item_id", Q.content_terms(F.col("text")).alias("terms"), (F.col("item_id") % 40).alias("k")), "terms")
    docs = table(spark, sf_dir, "documents").select("doc_id", Q.flat(F.col("text")).alias("flat"), (F.col("doc_id") % 40).alias("k"))
    pairs = asked.where(F.size("terms") > 0).join(docs, "k")
    return pairs.select("item_id", "doc_id", F.round(Q.coverage(F.col("terms"), F.col("flat")), 6).alias("coverage"), Q.escalates(F.col("terms"), F.col("flat")).alias("escalates"))


# A picture of each event: captions, texts around it, sizes and neighbours of every kind.
@query("""WITH e AS (SELECT event_id,
  CASE event_id % 4 WHEN 1 THEN '图 3.' WHEN 2 THEN 'A bird' WHEN 3 THEN CASE WHEN event_id % 13 = 0 THEN '趋势 of the birds above the river' ELSE 'A bird above the river at dawn' END END AS caption,
  CASE WHEN event_id % 7 = 0 THEN '统计 ' ELSE '' END AS detail, CASE event_id % 3 WHEN 0 THEN 14 WHEN 1 THEN 9 ELSE 12 END AS n,
  CASE WHEN event_id % 5 > 0 THEN value * 10000 END AS pixels, CASE WHEN event_id % 11 > 0 THEN 1 + CAST(user_id % 3 = 2 AS INTEGER) END AS images, user_id % 5 = 1 AS has_table FROM events),
f AS (SELECT *, n * 8 - 1 + length(detail) AS chars, pixels IS NULL OR pixels > 600000 AS large FROM e),
r AS (SELECT event_id, CASE
  WHEN caption IS NULL AND chars >= 100 AND coalesce(images = 1, false) AND NOT has_table AND coalesce(pixels <= 600000, true) AND detail = '' THEN 'no_caption_but_context'
  WHEN caption IS NULL THEN 'no_caption' WHEN caption = '图 3.' THEN 'generic_caption' WHEN length(caption) < 15 THEN 'short_caption' WHEN chars < 80 THEN 'short_context' WHEN has_table THEN 'table_on_page'
  WHEN images IS NULL OR images > 1 THEN 'several_images' WHEN large THEN 'large_image' WHEN contains(caption, '趋势') THEN 'caption_detail' WHEN detail <> '' THEN 'context_detail' ELSE 'text_suffices' END AS reason FROM f)
SELECT event_id, CASE WHEN reason IN ('no_caption_but_context', 'text_suffices') THEN 'text_only' ELSE 'text_and_visual' END AS mode, reason FROM r""")
def visual_policy(spark, sf_dir):
    at = F.col("event_id")
    described = F.when(at % 13 == 0, "趋势 of the birds above the river").otherwise("A bird above the river at dawn")
    caption = F.when(at % 4 == 1, "图 3.").when(at % 4 == 2, "A bird").when(at % 4 == 3, described)
    context = F.concat(F.when(at % 7 == 0, "统计 ").otherwise(""), F.repeat(F.lit("context "), F.when(at % 3 == 0, 14).when(at % 3 == 1, 9).otherwise(12)))
    pixels = F.when(at % 5 > 0, F.col("value") * 10000)
    images = F.when(at % 11 > 0, 1 + (F.col("user_id") % 3 == 2).cast("int"))
    told = Q.visual_policy(caption, context, pixels, images, F.col("user_id") % 5 == 1)
    return table(spark, sf_dir, "events").select("event_id", told.alias("p")).select("event_id", "p.mode", "p.reason")


@query(r"""SELECT o_orderkey, 1 + CAST(o_orderkey % 3 > 0 AS INTEGER) + CAST(o_orderkey % 5 > 0 AS INTEGER) AS n, 'In ' || year(o_orderdate) || ' sales of #' || CASE WHEN o_orderkey % 3 > 0 THEN ', up #' ELSE ', up in ' || (1990 + o_orderkey % 30) END || CASE WHEN o_orderkey % 5 > 0 THEN ', by #.' ELSE '.' END AS masked FROM orders""")
def numeric_claims(spark, sf_dir):
    key = F.col("o_orderkey")
    up = F.when(key % 3 > 0, F.concat(F.lit(", up "), (key % 90).cast("string"), F.lit("%"))).otherwise(F.concat(F.lit(", up in "), (1990 + key % 30).cast("string")))
    by = F.when(key % 5 > 0, F.concat(F.lit(", by +"), (F.col("o_custkey") % 7).cast("string"), F.lit(".5."))).otherwise(F.lit("."))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("In "), F.year("o_orderdate"), F.lit(" sales of "), F.format_number("o_totalprice", 2), up, by).alias("t"))
    return o.select("o_orderkey", F.size(Q.numeric_claims(F.col("t"))).alias("n"), Q.without_claims(F.col("t"), "#").alias("masked"))


@query("""SELECT c_custkey, 'rag:context:v2:' || sha256('{"document_id":null,"knowledge_base_id":"' || c_nationkey || '","query":"orders of ' || lower(c_name) || '","retrieval_mode":"auto","version":"v2"}') AS key FROM customer""")
def retrieval_cache_keys(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", Q.cache_key(F.col("c_nationkey"), F.lit(None), F.lit("auto"), F.concat(F.lit("  Orders\t of "), "c_name")).alias("key"))


@query("""WITH c AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER w AS back, coalesce(sum(length(text)) OVER w, 0) AS chars FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, CASE WHEN back <= 8 AND chars <= 4000 THEN 'recent' ELSE 'older' END AS part FROM c""")
def history_split(spark, sf_dir):
    from tidemark.operators.evidence import split_history

    return split_history(table(spark, sf_dir, "conversations").where("text IS NOT NULL"), "conv_id", "turn", "text").select("conv_id", "turn", "part")


# ---- evaluation: orders of a customer as ranked results, urgent ones as gold ------------------

_RUN = """o AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_orderpriority = '1-URGENT' AS good, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS ra, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rb FROM orders)"""


def _runs(spark, d):
    o, w = table(spark, d, "orders"), Window.partitionBy("o_custkey")
    ranked = lambda *order: o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(w.orderBy(*order)).alias("rank"))
    gold = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))
    return ranked(F.desc("o_totalprice"), F.col("o_orderkey")), ranked("o_orderdate", "o_orderkey"), gold


@query(f"""WITH {_RUN} SELECT query_id, round(1.0::DOUBLE / min(ra) FILTER (good), 6) AS evidence_mrr, CAST(count(*) FILTER (good AND ra <= 3) > 0 AS INTEGER) AS evidence_hit_3, round(count(*) FILTER (good AND ra <= 5)::DOUBLE / count(*) FILTER (good), 6) AS evidence_recall_5 FROM o GROUP BY 1 HAVING bool_or(good)""")
def evidence_metrics(spark, sf_dir):
    a, _, gold = _runs(spark, sf_dir)
    named = lambda df: df.withColumnRenamed("doc_id", "evidence_id")
    return E.evidence_metrics(named(a), named(gold)).select("query_id", "evidence_mrr", "evidence_hit_3", "evidence_recall_5")


@query(f"""WITH {_RUN}, p AS (SELECT query_id, bool_and((CASE WHEN ra <= 10 THEN ra END) IS NOT DISTINCT FROM (CASE WHEN rb <= 10 THEN rb END)) AS same, count(*) FILTER (ra <= 10 AND rb <= 10)::DOUBLE / greatest(count(*) FILTER (ra <= 10), count(*) FILTER (rb <= 10)) AS overlap FROM o WHERE ra <= 10 OR rb <= 10 GROUP BY 1)
SELECT count(*) AS queries, round(avg(same::INTEGER), 6) AS same_order, round(avg(overlap), 6) AS overlap FROM p""")
def ranking_agreement(spark, sf_dir):
    a, b, _ = _runs(spark, sf_dir)
    return E.agreement(a, b, 10)


@query(f"""WITH {_RUN} SELECT query_id, count(*) FILTER (ra <= 5 AND rb <= 5) AS shared, count(*) FILTER (ra <= 5 AND rb > 5) AS only_a, count(*) FILTER (rb <= 5 AND ra > 5) AS only_b, count(*) FILTER (ra <= 5 AND rb > 5 AND good) AS gold_only_a, count(*) FILTER (rb <= 5 AND ra > 5 AND good) AS gold_only_b FROM o WHERE ra <= 5 OR rb <= 5 GROUP BY 1""")
def branch_diagnostic(spark, sf_dir):
    a, b, gold = _runs(spark, sf_dir)
    return E.diagnostic(a.where("rank <= 5"), b.where("rank <= 5"), gold)


@query(f"""WITH {_RUN}, p AS (SELECT query_id, count(*) FILTER (good AND rb <= 5) - count(*) FILTER (good AND ra <= 5) AS d FROM o GROUP BY 1 HAVING bool_or(good))
SELECT count(*) FILTER (d > 0) AS improved, count(*) FILTER (d = 0) AS unchanged, count(*) FILTER (d < 0) AS regressed, CAST(sum(greatest(d, 0)) AS BIGINT) AS recovered FROM p""")
def graph_contribution(spark, sf_dir):
    a, b, gold = _runs(spark, sf_dir)
    return E.contribution(a, b, gold, 5)


@query(f"""WITH {_RUN}, p AS (SELECT query_id, min(ra) FILTER (good AND ra <= 5) AS x, min(rb) FILTER (good AND rb <= 5) AS y FROM o GROUP BY 1 HAVING bool_or(good))
SELECT query_id, concat_ws(',', CASE WHEN x IS NULL THEN 'absent_from_first' END, CASE WHEN x IS NOT NULL AND y IS NULL THEN 'lost_by_rerank' END, CASE WHEN y > x THEN 'moved_down' END, CASE WHEN y > 1 THEN 'not_first' END) AS categories FROM p WHERE x IS NULL OR y IS NULL OR y > x OR y > 1""")
def bad_cases(spark, sf_dir):
    a, b, gold = _runs(spark, sf_dir)
    return E.bad_cases(a.where("rank <= 5"), b.where("rank <= 5"), gold).select("query_id", F.array_join("categories", ",").alias("categories"))


@query(f"""WITH {_RUN} SELECT query_id, CASE WHEN count(*) FILTER (good AND ra <= 3) = 0 THEN 'none' WHEN count(*) FILTER (good AND ra <= 3) < count(*) FILTER (good) THEN 'partial' ELSE 'complete' END AS class FROM o GROUP BY 1 HAVING bool_or(good)""")
def coverage_class(spark, sf_dir):
    a, _, gold = _runs(spark, sf_dir)
    return E.coverage_class(a.where("rank <= 3"), gold, ["doc_id"])


@query(f"""WITH {_RUN}, p AS (SELECT query_id, coalesce(1.0::DOUBLE / min(ra) FILTER (good), 0) AS x, coalesce(1.0::DOUBLE / min(rb) FILTER (good), 0) AS y FROM o GROUP BY 1 HAVING bool_or(good))
SELECT count(*) FILTER (round(y, 6) > round(x, 6)) AS improved, count(*) FILTER (round(y, 6) = round(x, 6)) AS unchanged, count(*) FILTER (round(y, 6) < round(x, 6)) AS regressed FROM p""")
def paired_runs(spark, sf_dir):
    from tidemark.operators import metrics

    a, b, gold = _runs(spark, sf_dir)
    return metrics.paired(metrics.ranking_metrics(a, gold), metrics.ranking_metrics(b, gold), "query_id", "mrr").select("improved", "unchanged", "regressed")


@query("""WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) SELECT doc_id, source FROM s WHERE n > 5 AND n <= 25""")
def subject_sample(spark, sf_dir):
    return E.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 20, 5)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_orderkey // 3 AS s FROM orders WHERE o_totalprice > 350000), l AS (SELECT DISTINCT x.a, y.a AS b FROM e x JOIN e y USING (s)),
r AS (SELECT a AS item, a AS b FROM l UNION SELECT r.item, l.b FROM r JOIN l ON r.b = l.a) SELECT c_custkey AS item, coalesce((SELECT min(b) FROM r WHERE r.item = c_custkey), c_custkey) AS "group" FROM customer""")
def leakage_groups(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("item"), F.floor(F.col("o_orderkey") / 3).alias("signature"))
    return E.leakage_groups(spark, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item")), o)


@query("SELECT text AS value, count(*) AS n, min(doc_id) AS least FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_audit(spark, sf_dir):
    return E.duplicates(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query("SELECT p_size AS shape, count(DISTINCT p_type) AS splits, count(*) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def split_crossing(spark, sf_dir):
    return E.crossing(table(spark, sf_dir, "part"), "p_type", F.col("p_size"))


@query("SELECT source, count(*) AS rows, count(n_chars) AS known, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 6) AS mean, round(quantile_cont(n_chars, 0.5), 3) AS p50, round(quantile_cont(n_chars, 0.95), 3) AS p95 FROM documents GROUP BY 1")
def numeric_summary(spark, sf_dir):
    return E.summary(table(spark, sf_dir, "documents"), "n_chars", ["source"])


@query("SELECT round(avg(l_quantity), 6) AS l_quantity, NULL::DOUBLE AS partly, round(avg(l_discount), 6) AS l_discount FROM lineitem")
def metric_means(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("partly", F.when(F.col("l_linenumber") > 1, F.col("l_tax")))
    return E.metric_means(rows, ["l_quantity", "partly", "l_discount"])


@query("""SELECT l_returnflag, count(*) AS runs, count(*) FILTER (l_linestatus = 'F') AS succeeded, count(*) FILTER (l_linestatus <> 'F') AS failed, round(sum(l_quantity) FILTER (l_linestatus = 'F') / sum(l_linenumber) FILTER (l_linestatus = 'F'), 6) AS pages_per_second, round(quantile_cont(CASE WHEN l_linestatus = 'F' THEN l_linenumber END, 0.5), 3) AS median_seconds FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def subject_rollup(spark, sf_dir):
    return E.rollup(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_linestatus") == "F", "l_quantity", "l_linenumber")


@query("SELECT round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE * 7524 / sum(o_orderkey % 5 + 1)::DOUBLE, 0) AS o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT'")
def cost_extrapolation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumn("units", F.col("o_orderkey") % 5 + 1)
    return E.extrapolated(o, 7524, "units", ["o_totalprice"]).select(F.round("o_totalprice", 0).alias("o_totalprice"))


@query("""WITH f AS (SELECT doc_id, lower(regexp_extract(text, '[A-Za-z]+', 0)) AS a, text, lang FROM documents WHERE text IS NOT NULL) SELECT doc_id, contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), a) AND contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), coalesce(lang, 'x')) AS met FROM f""")
def answer_facts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", E.facts_met(F.col("text"), F.array(F.concat(F.lit(" "), F.upper(F.regexp_extract("text", "[A-Za-z]+", 0))), F.coalesce("lang", F.lit("x")))).alias("met"))


@query("""SELECT l_orderkey * 8 + l_linenumber AS evidence_id, CASE WHEN o_orderkey IS NULL THEN 'unknown_chunk' WHEN l_linenumber > 5 THEN 'page_outside' WHEN l_suppkey % 10 > 6 THEN 'foreign_block' END AS problem FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL OR l_linenumber > 5 OR l_suppkey % 10 > 6""")
def lineage_conflicts(spark, sf_dir):
    evidence = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_orderkey").alias("chunk_id"), F.array("l_linenumber").alias("pages"), F.array((F.col("l_suppkey") % 10).cast("int")).alias("blocks"))
    chunks = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("chunk_id"), F.lit(1).alias("first"), F.lit(5).alias("last"), F.sequence(F.lit(0), F.lit(6)).alias("own_blocks"))
    return E.lineage_problems(evidence, chunks)


@query("""WITH c AS (SELECT min(doc_id) AS id, lower(text) AS t FROM documents WHERE text <> '' GROUP BY 2), g AS (SELECT DISTINCT id, unnest(list_transform(range(1, greatest(length(t) - 1, 2)), lambda i: substr(t, i, 3))) AS g FROM c),
n AS (SELECT id, count(*) AS n FROM g GROUP BY 1), p AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.id < y.id GROUP BY 1, 2)
SELECT a, b, round(k / (p.n + q.n - k)::DOUBLE, 6) AS similarity FROM (SELECT pr.*, n.n FROM p pr JOIN n ON n.id = a) p JOIN n q ON q.id = b WHERE k / (p.n + q.n - k)::DOUBLE >= 0.9""")
def ngram_similarity(spark, sf_dir):
    """Pairs of whole texts, cases aside, that share 0.9 of their character trigrams; equal ones under the smallest doc_id."""
    held, _ = similarity.classes(table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.lower("text").alias("t")), "doc_id", "t")
    pairs = similarity.jaccard_join(spark, similarity.char_gram_sets(held.withColumnRenamed("value", "text")), 0.9)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))
