"""Queries over grounding, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import grounding as G
from tidemark.plans.catalog import query
from tidemark.sources.tables import table, written

# A document's first four words as entities and relations, some of them made up.
_MADE = """d AS (SELECT doc_id AS chunk, doc_id % 8 AS m, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS txt, substr(text, 1, 60) AS head, list_transform(regexp_extract_all(text, '[A-Za-z]+')[1:4], lambda w: lower(w)) AS w FROM documents),
k AS (SELECT * FROM d WHERE len(w) = 4),
en AS (SELECT chunk, w[1] AS key, 'A' AS kind, CASE WHEN m = 2 THEN [w[2], 'zzz unknown'] ELSE [w[2]] END AS aliases, 1 AS n FROM k
  UNION ALL SELECT chunk, w[3], 'B', CASE WHEN m = 3 THEN [w[4]] ELSE [] END, CASE WHEN m = 3 THEN 2 ELSE 1 END FROM k UNION ALL SELECT chunk, 'zzq' || chunk, 'A', [], 1 FROM k WHERE m = 1),
e1 AS (SELECT chunk, key, kind, list_sort(list_filter(aliases, lambda a: a <> key)) AS aliases, n FROM en),
e2 AS (SELECT e.*, CASE WHEN NOT (CASE WHEN len(aliases) > 0 THEN len(list_filter(aliases, lambda a: NOT contains(txt, a))) = 0 ELSE contains(txt, key) END) THEN 'entity_mention_not_grounded' END AS reason FROM e1 e JOIN k USING (chunk))"""


def _made(spark, sf_dir):
    words = F.slice(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1)), 1, 4)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), (F.col("doc_id") % 8).alias("m"), "text", words.alias("w")).where("size(w) = 4")
    d = written(spark, d, "words")
    w, m, none = F.col("w"), F.col("m"), F.array().cast("array<string>")
    entity = lambda name, kind, aliases, when=F.lit(True): d.where(when).select("chunk", name.alias("name"), F.lit(kind).alias("kind"), aliases.alias("aliases"))
    entities = entity(w[0], "A", F.when(m == 2, F.array(w[1], F.lit("ZZZ  unknown"))).otherwise(F.array(w[1], F.lit(" "))))
    entities = entities.union(entity(F.upper(w[2]), "B", none)).union(entity(F.lower(w[2]), "B", F.array(F.upper(w[3])), m == 3)).union(entity(F.concat(F.lit("Zzq"), F.col("chunk").cast("string")), "A", none, m == 1))
    head = F.substring("text", 1, 60)
    relation = lambda s, t, e: d.select("chunk", s.alias("source"), t.alias("target"), F.lit("r").alias("kind"), e.alias("evidence"))
    evidence = F.when(m == 4, F.lit("is not there at all")).when(m == 5, w[0]).when(m == 6, w[2]).otherwise(head)
    relations = relation(F.when(m == 7, F.lit("Nobody")).otherwise(F.upper(w[0])), w[2], evidence).union(relation(w[1], w[2], head))
    return entities, relations, d.select("chunk", "text")


@query(f"WITH {_MADE} SELECT chunk, key, kind, aliases, n, reason FROM e2")
def entity_grounding(spark, sf_dir):
    entities, _, chunks = _made(spark, sf_dir)
    return G.grounded_entities(spark, entities, chunks).select("chunk", "key", "kind", "aliases", "n", "reason")


@query(f"""WITH {_MADE}, tk AS (SELECT chunk, key || '|' || kind AS id, list_distinct(list_prepend(key, aliases)) AS ms FROM e2 WHERE reason IS NULL),
eu AS (SELECT chunk, label, min(id) AS id, any_value(ms) AS ms FROM (SELECT chunk, id, ms, unnest(ms) AS label FROM tk) GROUP BY 1, 2 HAVING count(*) = 1),
r0 AS (SELECT chunk, CASE WHEN m = 7 THEN 'nobody' ELSE w[1] END AS s, w[3] AS t, CASE m WHEN 4 THEN 'is not there at all' WHEN 5 THEN w[1] WHEN 6 THEN w[3] ELSE lower(trim(regexp_replace(head, '\\s+', ' ', 'g'))) END AS e FROM k UNION ALL SELECT chunk, w[2], w[3], lower(trim(regexp_replace(head, '\\s+', ' ', 'g'))) FROM k),
r1 AS (SELECT chunk, s, t, count(*) AS n, min(e) AS e, count(DISTINCT e) AS es FROM r0 GROUP BY 1, 2, 3),
r2 AS (SELECT r.*, a.id AS source_id, b.id AS target_id, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'relation_endpoint_not_in_output' WHEN NOT contains(txt, e) THEN 'relation_evidence_not_in_chunk' WHEN len(list_filter(a.ms, lambda x: contains(e, x))) = 0 THEN 'relation_source_not_grounded' WHEN len(list_filter(b.ms, lambda x: contains(e, x))) = 0 THEN 'relation_target_not_grounded' END AS why
  FROM r1 r JOIN k USING (chunk) LEFT JOIN eu a ON a.chunk = r.chunk AND a.label = r.s LEFT JOIN eu b ON b.chunk = r.chunk AND b.label = r.t)
SELECT chunk, s, t, n, source_id, target_id, reason FROM (SELECT *, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY chunk, source_id, target_id, why IS NULL ORDER BY s, t) > 1 THEN 'duplicate' ELSE why END AS reason FROM r2) WHERE es = 1""")
def relation_grounding(spark, sf_dir):
    """Relations whose repeats have one evidence (which of several is kept goes by case, which the SQL does not see)."""
    from tidemark.functions.text import linking_label

    entities, relations, chunks = _made(spark, sf_dir)
    one = relations.groupBy("chunk", linking_label("source").alias("s"), linking_label("target").alias("t")).agg(F.count_distinct(linking_label("evidence")).alias("es")).where("es = 1").drop("es")
    found = G.grounded_relations(spark, relations, G.grounded_entities(spark, entities, chunks), chunks).withColumn("s", linking_label("source")).withColumn("t", linking_label("target"))
    return found.join(one, ["chunk", "s", "t"], "left_semi").select("chunk", "s", "t", "n", "source_id", "target_id", "reason")
