"""Queries over candidates for linking, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import linking as L
from tidemark.plans.catalog import query
from tidemark.sources.tables import table

# Parts are entities of six knowledge bases; their aliases are their name with the brand's number and the brand with the size; every seventh has no alias.
_ENTITIES = """en AS (SELECT p_partkey AS id, p_partkey % 6 AS kb, p_size AS doc, lower(p_name) AS name, lower(p_type) AS type,
  CASE WHEN p_partkey % 7 = 0 THEN [] ELSE list_sort(list_distinct([lower(p_name) || ' ' || substr(p_brand, 7), lower(p_brand) || ' no. ' || p_size])) END AS aliases FROM part),
te AS (SELECT *, list_sort(list_distinct(list_prepend(name, aliases))) AS terms FROM en),
bl AS (SELECT DISTINCT kb, 'exact' AS kind, unnest(terms) AS value, id FROM te UNION ALL SELECT kb, 'prefix', substr(name, 1, 2), id FROM te)"""


def _entities(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    aliases = F.array(F.concat("p_name", F.lit("  "), F.substring("p_brand", 7, 9)), F.concat("p_brand", F.lit(" No. "), F.col("p_size").cast("string")), F.lit(" "), F.lit(None).cast("string"))
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 6).alias("kb"), F.col("p_size").alias("doc"), F.upper("p_name").alias("name"), F.when(F.col("p_partkey") % 7 > 0, aliases).alias("aliases"), F.col("p_type").alias("type"))


@query(f"WITH {_ENTITIES} SELECT kb, kind, value, count(*) AS n, min(id) AS least, CASE WHEN count(*) > 10 THEN count(*) * (count(*) - 1) // 2 ELSE 0 END AS skipped_pairs FROM bl GROUP BY 1, 2, 3")
def linking_blocks(spark, sf_dir):
    return L.block_sizes(L.labelled(spark, _entities(spark, sf_dir)), 10)


@query(f"""WITH {_ENTITIES}, ok AS (SELECT kb, value FROM bl WHERE kind = 'exact' GROUP BY 1, 2 HAVING count(*) <= 64),
pr AS (SELECT x.kb, x.id AS a, y.id AS b, min(x.value) AS value FROM bl x JOIN bl y ON x.kb = y.kb AND x.value = y.value AND x.id < y.id JOIN ok ON ok.kb = x.kb AND ok.value = x.value WHERE x.kind = 'exact' AND y.kind = 'exact' GROUP BY 1, 2, 3),
fi AS (SELECT *, row_number() OVER (PARTITION BY kb ORDER BY value, a, b) AS nth FROM pr)
SELECT fi.kb, a, b, p.name = q.name AS name_match, list_sort(list_intersect(p.terms, q.terms)) AS mention_overlap, list_sort(list_intersect(p.aliases, q.aliases)) AS alias_overlap, p.type = q.type AS compatible_type, p.doc = q.doc AS same_document
FROM fi JOIN te p ON p.id = a JOIN te q ON q.id = b WHERE nth <= 200""")
def linking_exact(spark, sf_dir):
    """Pairs of exact blocks alone, with what the names and aliases tell."""
    return L.candidates(spark, L.labelled(spark, _entities(spark, sf_dir)), prefix=False).drop("similarity")


@query()
def linking_candidates(spark, sf_dir):
    """Pairs of exact and prefix blocks with all signals; the likeness can't be said in SQL, the tests compare with plain loops."""
    return L.candidates(spark, L.labelled(spark, _entities(spark, sf_dir)))
