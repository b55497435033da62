"""Queries over files and databases written from the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.catalog import query
from tidemark.sources import databases, files
from tidemark.sources.tables import shared_dir, table


@query("""SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(CAST(o_orderdate AS VARCHAR)[1:10]) AS first FROM orders
WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000 AND o_orderkey % 2 = 0 GROUP BY 1""")
def external_read(spark, sf_dir):
    """Orders in files of another database; it decides on priority and price, Spark on the rest."""
    databases.register(spark)
    path = shared_dir(spark, "databases")
    databases.write(table(spark, sf_dir, "orders").repartition(4), path, "orders")
    orders = spark.read.format("file_database").option("path", path).option("table", "orders").option("seconds", "120").load()
    found = orders.where("o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000 AND o_orderkey % 2 = 0")
    return found.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min(F.substring("o_orderdate", 1, 10)).alias("first"))


@query("""WITH f AS (SELECT page_id, 'page-' || page_id || CASE WHEN page_id % 7 = 0 THEN '.html' ELSE '.pdf' END AS name, CASE page_id % 5 WHEN 0 THEN 'blank' WHEN 1 THEN coalesce(html, '') WHEN 2 THEN '%PDF-1.7' || chr(10) || coalesce(html, '') ELSE '%PDF-1.7' || chr(10) || coalesce(html, '') || chr(10) || '%%EOF' END AS t FROM pages),
g AS (SELECT name, CAST(strlen(t) AS BIGINT) AS size, sha256(t) AS sha256, CASE WHEN name LIKE '%.html' THEN 'not_pdf' WHEN t = '' THEN 'empty' WHEN strlen(t) > 20000 THEN 'too_large' WHEN NOT starts_with(t, '%PDF-') THEN 'no_header' WHEN NOT ends_with(t, '%%EOF') THEN 'truncated' END AS own FROM f)
SELECT name, size, sha256, coalesce(own, CASE WHEN name <> min(name) FILTER (WHERE own IS NULL) OVER (PARTITION BY sha256) THEN 'conflict' ELSE 'registered' END) AS state FROM g""")
def pdf_registration(spark, sf_dir):
    """Pages written as files, some of them no PDF, equal, without header or end; the scan registers what is new."""
    at, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    head = F.concat(F.lit("%PDF-1.7\n"), html)
    text = F.when(at % 5 == 0, "blank").when(at % 5 == 1, html).when(at % 5 == 2, head).otherwise(F.concat(head, F.lit("\n%%EOF")))
    name = F.concat(F.lit("page-"), at.cast("string"), F.when(at % 7 == 0, ".html").otherwise(".pdf"))
    root = shared_dir(spark, "uploads")
    files.write_files(table(spark, sf_dir, "pages").select(name.alias("name"), F.encode(text, "UTF-8").alias("content")), root)
    return files.pdf_uploads(files.scan(spark, root), most_bytes=20_000)


@query("""WITH b AS (SELECT conv_id, turn, '{"block_id":"b' || turn || '","type":"' || CASE WHEN role = 'user' THEN 'title' ELSE 'text' END || '"}' AS b FROM conversations),
d AS (SELECT conv_id, count(*) AS n, '{"document_id":' || CASE WHEN conv_id % 10 = 3 THEN 'null' ELSE '"d' || conv_id || '"' END || ',"pages":[{"page_number":1,"blocks":[' || string_agg(b, ',' ORDER BY turn) || ']}]}' AS j FROM b GROUP BY 1),
f AS (SELECT *, CASE WHEN conv_id % 10 = 7 THEN j[:-2] ELSE j END AS t FROM d)
SELECT 'canonical-' || conv_id || '.json' AS name, sha256(t) AS sha256, CASE WHEN conv_id % 10 NOT IN (3, 7) THEN 'd' || conv_id END AS document_id, CASE WHEN conv_id % 10 NOT IN (3, 7) THEN 1 END AS pages, CASE WHEN conv_id % 10 NOT IN (3, 7) THEN CAST(n AS INTEGER) END AS blocks, CASE conv_id % 10 WHEN 7 THEN 'invalid' WHEN 3 THEN 'no_document' END AS problem FROM f""")
def canonical_scan(spark, sf_dir):
    """Conversations written as canonical documents, some cut short or without an id, read back with the hash of their bytes."""
    block = F.concat(F.lit('{"block_id":"b'), F.col("turn").cast("string"), F.lit('","type":"'), F.when(F.col("role") == "user", "title").otherwise("text"), F.lit('"}'))
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), ",").alias("b"))
    at = F.col("conv_id")
    text = F.concat(F.lit('{"document_id":'), F.when(at % 10 == 3, "null").otherwise(F.concat(F.lit('"d'), at.cast("string"), F.lit('"'))), F.lit(',"pages":[{"page_number":1,"blocks":['), "b", F.lit("]}]}"))
    rows = d.select(at, text.alias("t")).select(F.concat(F.lit("canonical-"), at.cast("string"), F.lit(".json")).alias("name"), F.encode(F.when(at % 10 == 7, F.expr("left(t, length(t) - 1)")).otherwise(F.col("t")), "UTF-8").alias("content"))
    root = shared_dir(spark, "canonical")
    files.write_files(rows, root)
    return files.canonical(files.scan(spark, root, "*.json"))
