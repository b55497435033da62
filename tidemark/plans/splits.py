"""Queries over splits of evaluation items, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evaluation as E, splits
from tidemark.plans.catalog import query
from tidemark.sources.tables import table, written


@query("""WITH q AS (SELECT c_mktsegment AS subject, count(*) AS n, count(*) // 3 AS quota FROM customer GROUP BY 1)
SELECT subject, 'dev' AS split, quota AS n, 0 AS shared_groups FROM q UNION ALL SELECT subject, 'test', n - quota, 0 FROM q""")
def quota_split(spark, sf_dir):
    """Customers by segment, a third of each to dev, those that share a pair of large orders on one side."""
    customers = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("item"), F.floor(F.col("o_orderkey") / 2).alias("signature"))
    groups = E.leakage_groups(spark, customers.select(F.col("c_custkey").alias("item")), o)
    items = written(spark, groups.join(customers.select(F.col("c_custkey").alias("item"), F.col("c_mktsegment").alias("subject")), "item"), "items")
    quotas = {r["subject"]: r["n"] // 3 for r in items.groupBy("subject").agg(F.count("*").alias("n")).collect()}  # a row for each subject
    told = written(spark, splits.quota_split(spark, items, quotas), "split")
    mixed = told.groupBy("group").agg(F.count_distinct("split").alias("sides")).where("sides > 1").select("group", F.lit(1).alias("m"))
    return told.join(mixed, "group", "left").groupBy("subject", "split").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("m") == 1, F.col("group"))).alias("shared_groups"))


# Documents of a subject are its years; sums that later ones can give are bits, the earliest choice is followed from the first on.
@query("""WITH RECURSIVE i AS (SELECT o_orderkey AS item, o_custkey AS subject, CAST(year(o_orderdate) AS INTEGER) AS document FROM orders),
d AS (SELECT subject, document, count(*) AS n, row_number() OVER (PARTITION BY subject ORDER BY document) AS j, count(*) OVER (PARTITION BY subject) AS m FROM i GROUP BY 1, 2),
s AS (SELECT subject, j, n, 1::BIGINT AS after FROM d WHERE j = m UNION ALL SELECT d.subject, d.j, d.n, (s.after | (s.after << least(s.n, 5))) & 31 FROM s JOIN d ON d.subject = s.subject AND d.j = s.j - 1),
p AS (SELECT subject, j, CASE WHEN ((after | (after << least(n, 5))) >> 4) & 1 = 1 THEN 4 END AS had, CASE WHEN ((after | (after << least(n, 5))) >> 4) & 1 = 1 THEN n <= 4 AND (after >> greatest(4 - n, 0)) & 1 = 1 END AS dev, n FROM s WHERE j = 1
  UNION ALL SELECT s.subject, s.j, p.had - CASE WHEN p.dev THEN p.n ELSE 0 END, CASE WHEN p.had IS NOT NULL THEN s.n <= p.had - CASE WHEN p.dev THEN p.n ELSE 0 END AND (s.after >> greatest(p.had - CASE WHEN p.dev THEN p.n ELSE 0 END - s.n, 0)) & 1 = 1 END, s.n FROM p JOIN s ON s.subject = p.subject AND s.j = p.j + 1)
SELECT item, i.subject, i.document, CASE WHEN coalesce(dev, row_number() OVER (PARTITION BY i.subject ORDER BY i.document, item) <= 4) THEN 'dev' ELSE 'test' END AS split, dev IS NOT NULL AS apart FROM i JOIN d USING (subject, document) JOIN p ON p.subject = i.subject AND p.j = d.j""")
def document_split(spark, sf_dir):
    """Four orders of each customer for dev, a year's orders on one side."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("subject"), F.year("o_orderdate").alias("document"))
    return splits.document_split(spark, o, 4)
