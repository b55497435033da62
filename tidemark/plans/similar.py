"""Queries over similarity joins, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import linking_label
from tidemark.operators import similarity as S
from tidemark.plans.catalog import query
from tidemark.sources.tables import table

# All pairs of distinct texts by their shared shingles of five words; no filter.
_SHINGLES = """cl AS (SELECT min(doc_id) AS id, text FROM documents WHERE text IS NOT NULL GROUP BY text),
wd AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM cl),
sh AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM wd),
sz AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pr AS (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
sm AS (SELECT a, b, shared / (p.n + q.n - shared)::DOUBLE AS similarity FROM pr JOIN sz p ON p.id = a JOIN sz q ON q.id = b),
lk AS (SELECT a, b, similarity FROM sm WHERE similarity >= 0.8)"""


def _similar(spark, sf_dir):
    held, rows = S.classes(table(spark, sf_dir, "documents"), "doc_id", "text")
    return S.jaccard_join(spark, S.word_shingle_sets(held.withColumnRenamed("value", "text"), 5), 0.8, rare=True), rows


@query(f"WITH {_SHINGLES} SELECT a, b, round(similarity, 6) AS similarity FROM lk")
def similar_documents(spark, sf_dir):
    """Pairs of different whole texts, each under its smallest doc_id, that share 0.8 of their shingles of five words."""
    return _similar(spark, sf_dir)[0].select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_SHINGLES}, n AS (SELECT id, count(*) AS links FROM (SELECT a AS id FROM lk UNION ALL SELECT b FROM lk) GROUP BY id)
SELECT doc_id, cl.id AS class, coalesce(links, 0) AS links FROM documents JOIN cl USING (text) LEFT JOIN n ON n.id = cl.id""")
def similar_document_classes(spark, sf_dir):
    """Every document with the class of its equal texts and that class's number of similar ones."""
    pairs, rows = _similar(spark, sf_dir)
    links = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("links"))
    return rows.join(links, "id", "left").select("doc_id", F.col("id").alias("class"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


@query()
def similar_questions(spark, sf_dir):
    """Pairs of different questions of a matcher's ratio of 0.92 or more: questions about parts, equal ones under the smallest key.

    The matcher can't be said in SQL; the tests compare all pairs.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", linking_label(F.concat(F.lit("How many  "), "p_name", F.lit(" of type "), "p_type", F.lit(" has "), "p_brand", F.lit("?"))).alias("question"))
    held, _ = S.classes(parts, "p_partkey", "question")
    return S.ratio_join(spark, held.select("id", F.col("value").alias("text")), None, 0.92).select("a", "b", F.round("ratio", 6).alias("ratio"))
