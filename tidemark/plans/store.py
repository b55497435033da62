"""Queries over scans and sinks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.catalog import NAMES, query
from tidemark.sources import artifacts as A, sinks as S
from tidemark.sources.tables import shared_dir, table

# Conversations as parser output: every turn an item of a page, of a type that follows from its place.
_BLOCKS = """it AS (SELECT conv_id, turn, coalesce(text, '') AS text, turn // 4 + 1 AS page, turn % 7 AS m FROM conversations),
bl AS (SELECT *, CASE m WHEN 0 THEN 'title' WHEN 1 THEN 'text' WHEN 2 THEN 'table' WHEN 3 THEN 'image' WHEN 4 THEN 'formula' WHEN 5 THEN 'text' END AS type,
  CASE WHEN m = 6 THEN 'unsupported_type' WHEN m IN (0, 1, 4, 5) AND trim(text) = '' THEN 'no_content' WHEN m = 5 THEN 'box_clamped' END AS warning FROM it WHERE turn % 11 <> 10),
bk AS (SELECT *, coalesce(warning, '') IN ('', 'box_clamped') AS kept FROM bl),
nb AS (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY conv_id, page ORDER BY turn) AS nth FROM bk)"""


def _output(spark, d):
    c = table(spark, d, "conversations")
    text, m = F.coalesce("text", F.lit("")), F.col("turn") % 7
    kind = F.when(F.col("turn") % 11 == 10, "footer").when(m == 2, "table").when(m == 3, "image").when(m == 4, "equation").when(m == 6, "chart").otherwise("text")
    item = F.struct(
        F.col("turn"), kind.alias("type"), F.when(~m.isin(2, 3), text).alias("text"), F.when(m == 0, F.lit(1)).alias("text_level"), F.when(m == 2, F.concat(F.lit("<table>"), text, F.lit("</table>"))).alias("table_body"),
        F.when(m == 2, F.array(F.lit(" a "), F.lit(""), F.lit("b"))).alias("table_caption"), F.when(m == 3, F.lit("images/x.png")).alias("img_path"), F.when(m == 3, F.array(F.lit("figure"))).alias("image_caption"),
        F.floor(F.col("turn") / 4).cast("int").alias("page_idx"), F.array(F.lit(0.0), F.when(m == 5, -3.0).otherwise(10.0), F.lit(500.0), F.lit(1000.0)).alias("bbox"))
    return c.groupBy(F.col("conv_id").alias("document_id")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("items"))


def _blocks(spark, d):
    return A.parser_blocks(_output(spark, d))


@query(f"""WITH {_BLOCKS} SELECT conv_id AS document_id, CASE WHEN kept THEN 'p' || page || '-b' || nth END AS block_id, CAST(page AS BIGINT) AS page, CASE WHEN kept THEN nth - 1 END AS reading_order, CASE WHEN kept THEN type END AS type,
CASE WHEN m = 2 THEN 'a' || chr(10) || 'b' WHEN m = 3 THEN 'figure' END AS caption, CASE WHEN m = 3 THEN 'images/x.png' END AS asset, CASE WHEN m = 5 THEN 0.0 ELSE 0.01 END::DOUBLE AS y0, warning FROM nb""")
def parser_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("document_id", "block_id", F.col("page").cast("long"), "reading_order", "type", "caption", "asset", F.col("box")[1].alias("y0"), "warning")


@query(f"""WITH {_BLOCKS} SELECT conv_id AS document_id, count(*) FILTER (kept) AS blocks, count(*) FILTER (kept AND type = 'title') AS titles, count(*) FILTER (kept AND type = 'text') AS texts, count(*) FILTER (kept AND type = 'table') AS tables,
count(*) FILTER (kept AND type = 'image') AS images, count(*) FILTER (kept AND type = 'formula') AS formulas, count(warning) AS warnings FROM nb GROUP BY 1""")
def parser_stats(spark, sf_dir):
    return A.parser_stats(_blocks(spark, sf_dir))


@query(f"""WITH {_BLOCKS}, ev AS (SELECT conv_id, 'p' || page || '-b' || nth AS block_id, m, text FROM nb WHERE kept)
SELECT conv_id || ':' || block_id AS evidence_id, CASE m WHEN 2 THEN 'table' WHEN 3 THEN 'image' WHEN 4 THEN 'formula' ELSE 'text' END AS modality, CASE m WHEN 2 THEN 3 ELSE CASE m WHEN 3 THEN 2 ELSE 1 END END - CASE m WHEN 2 THEN 1 ELSE 0 END AS n,
sha256(concat_ws('|', conv_id, block_id, CASE m WHEN 0 THEN 'title' WHEN 2 THEN 'table' WHEN 3 THEN 'image' WHEN 4 THEN 'formula' ELSE 'text' END, CASE m WHEN 2 THEN '<table>' || text || '</table>' WHEN 3 THEN '' ELSE text END, CASE m WHEN 2 THEN 'a' || chr(10) || 'b' WHEN 3 THEN 'figure' ELSE '' END)) AS fingerprint FROM ev""")
def evidence_build(spark, sf_dir):
    return A.evidence(_blocks(spark, sf_dir)).select("evidence_id", "modality", F.size("representations").alias("n"), "fingerprint")


@query(f"""WITH {_BLOCKS}, ev AS (SELECT conv_id || ':p' || page || '-b' || nth AS e, m, text FROM nb WHERE kept),
r AS (SELECT e, m, unnest(CASE m WHEN 2 THEN ['table', 'caption'] WHEN 3 THEN ['caption'] WHEN 4 THEN ['latex'] ELSE ['text'] END) AS kind, text FROM ev)
SELECT e || '#' || kind AS point_id, e AS evidence_id, CASE m WHEN 2 THEN 'table' WHEN 3 THEN 'image' WHEN 4 THEN 'formula' ELSE 'text' END AS modality, kind,
CASE WHEN kind = 'caption' AND m = 2 THEN 'a' || chr(10) || 'b' WHEN kind = 'caption' THEN 'figure' WHEN kind = 'table' THEN '<table>' || text || '</table>' ELSE text END AS content FROM r""")
def index_payload(spark, sf_dir):
    return A.payload(A.evidence(_blocks(spark, sf_dir))).select("point_id", "evidence_id", "modality", "kind", "content")


@query(f"""WITH {_BLOCKS}, ev AS (SELECT conv_id, m, text, turn FROM nb WHERE kept), n AS (SELECT CASE WHEN turn = 0 THEN 'missing' WHEN conv_id % 10 = 3 AND m IN (0, 1, 4, 5) THEN 'stale' WHEN conv_id % 10 = 3 AND m = 2 THEN 'stale' ELSE 'valid' END AS state FROM ev) SELECT state, count(*) AS n FROM n GROUP BY 1""")
def evidence_validation(spark, sf_dir):
    fresh = A.evidence(_blocks(spark, sf_dir))
    changed = A.evidence(_blocks(spark, sf_dir).where("at > 0 OR block_id IS NULL").withColumn("text", F.when(F.col("document_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    return A.stale(changed, fresh).groupBy("state").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id IN (SELECT doc_id FROM labels ORDER BY quality DESC, doc_id LIMIT 100)")
def corpus_scan(spark, sf_dir):
    manifest = table(spark, sf_dir, "labels").select("doc_id", (F.col("doc_id") - F.col("quality") * 10_000_000_000).alias("position"))
    found = A.corpus(table(spark, sf_dir, "documents"), manifest, "doc_id", 100)
    return found.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_scan(spark, sf_dir):
    c, path = table(spark, sf_dir, "conversations"), shared_dir(spark, "jsonl")
    S.write_jsonl(c, path)
    return A.read_jsonl(spark, path, c.schema).select("conv_id", "turn", "role", "text")


@query("SELECT table_name, column_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY column_index) AS INTEGER) AS position FROM duckdb_columns() WHERE table_name IN ('" + "', '".join(NAMES) + "')")
def catalog_scan(spark, sf_dir):
    for name in NAMES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return A.catalog(spark, NAMES).select("table_name", "column_name", "position")


@query("""WITH u AS (SELECT source AS kb, doc_id AS document_id, coalesce(text, '') AS t FROM documents), s AS (SELECT *, sha256(t) AS sha256, CAST(strlen(t) AS BIGINT) AS size FROM u)
SELECT kb, document_id, sha256, size, CASE WHEN size = 0 THEN 'empty' WHEN size > 20000 THEN 'too_large' WHEN document_id <> min(document_id) OVER (PARTITION BY kb, sha256) THEN 'conflict' ELSE 'registered' END AS state FROM s""")
def document_registration(spark, sf_dir):
    uploads = table(spark, sf_dir, "documents").select(F.col("source").alias("kb"), F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    return A.register(uploads, most_bytes=20_000)


@query("WITH p AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 256 AS page FROM embeddings) SELECT page, count(*) AS n, min(vec_id) AS first, max(vec_id) AS last FROM p GROUP BY 1")
def vector_scroll(spark, sf_dir):
    pages = A.scroll(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")
    return pages.groupBy("page").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE event_id % 5 WHEN 1 THEN 'no_json' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'duplicate_key' WHEN 4 THEN 'missing_field' END AS issue FROM events""")
def model_answers(spark, sf_dir):
    e, m = table(spark, sf_dir, "events"), F.col("event_id") % 5
    head = F.expr("substring(props, 1, length(props) - 1)")
    full = F.concat(head, F.lit(', "name": "x"}'))
    answer = F.when(m == 0, F.concat(F.lit("Here it is:\n```json\n"), full, F.lit("\n```\nDone."))).when(m == 1, F.lit("I do not know.")).when(m == 2, F.concat(head, F.lit(', "name": }'))).when(m == 3, F.concat(head, F.lit(', "name": "x", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))).otherwise(F.col("props"))
    told = A.parse_answer(e.select("event_id", answer.alias("answer")), "answer", "k long, name string", ["k", "name"])
    return told.select("event_id", F.when(F.col("issue").isin("no_json", "invalid_json"), None).otherwise(F.col("parsed.k")).alias("k"), "issue")


@query("""SELECT (SELECT count(*) FROM orders) AS before, count(*) AS after, true AS same_name, 1 AS pruned, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus <> 'P'""")
def generation_commit(spark, sf_dir):
    o, root = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), shared_dir(spark, "generations")
    S.commit(o, root)
    before = S.active(spark, root)["rows"]
    name = S.commit(o.where("o_orderstatus <> 'P'"), root)
    again = S.commit(o.where("o_orderstatus <> 'P'").repartition(3), root)
    pruned = S.prune(spark, root)
    return S.read(spark, root, o.schema).agg(F.lit(before).cast("long").alias("before"), F.count("*").alias("after"), F.lit(name == again).alias("same_name"), F.lit(pruned).alias("pruned"), F.sum("o_orderkey").alias("keys"))


@query("SELECT CASE WHEN doc_id % 10 = 0 THEN 'xx' ELSE lang END AS lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1")
def document_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    fresh = S.replaced(d, d.where("doc_id % 10 = 0").withColumn("lang", F.lit("xx")), "doc_id")
    return S.deleted(fresh, table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT source, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'quarantined' ELSE 'searchable' END AS state, count(*) AS n FROM documents GROUP BY 1, 2")
def quarantine(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return S.quarantined(d, table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").groupBy("source", "state").agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text) AS n FROM documents")
def resumable_build(spark, sf_dir):
    d, path = table(spark, sf_dir, "documents").select("doc_id", "text"), shared_dir(spark, "build")
    step = lambda rows: rows.select("doc_id", F.char_length("text").cast("long").alias("n"))
    S.build_missing(spark, d.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi"), path, "doc_id", step, "v1")
    return S.build_missing(spark, d, path, "doc_id", step, "v1")


@query("""WITH h AS (SELECT sha256(concat_ws(chr(31), coalesce(CAST(n_name AS VARCHAR), chr(0)), CAST(n_nationkey AS VARCHAR), CAST(n_regionkey AS VARCHAR))) AS h FROM nation),
l AS (SELECT count(*) AS n, sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS b, sum(CAST('0x' || substr(h, 25, 12) AS BIGINT)) AS c, sum(CAST('0x' || substr(h, 37, 12) AS BIGINT)) AS d, sum(CAST('0x' || substr(h, 49, 12) AS BIGINT)) AS e FROM h)
SELECT n AS rows, sha256(concat_ws('|', n, a, b, c, d, e)) AS fingerprint FROM l""")
def corpus_fingerprint(spark, sf_dir):
    return S.fingerprint(table(spark, sf_dir, "nation").repartition(5))


@query("""SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def result_json(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", S.result_json(n, []).alias("line"))
