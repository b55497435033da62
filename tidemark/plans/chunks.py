"""Queries over chunks, and their SQL: the packing as a recursion over the blocks of each section."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import chunking as C
from tidemark.plans.catalog import query
from tidemark.sources.tables import table


def _blocks(spark, sf_dir):
    """The lines of documents as blocks of all types: short lines without a full stop are titles, some of the others formulas, tables and pictures (every second one without a caption)."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    k, n = F.col("document_id") * 7 + F.col("at"), F.char_length("line")
    kind = F.when((n <= 40) & ~F.col("line").endswith("."), "title").when((k % 6 == 0) & (n <= 300), "formula").when(k % 11 == 3, "table").when(k % 17 == 5, "image").otherwise("text")
    blocks = lines.withColumn("type", kind).withColumn("page", F.floor(F.col("at") / 10).cast("int") + 1)
    return blocks.select("document_id", "at", "page", "type", F.when((F.col("type") != "image") | (k % 2 == 1), F.col("line")).alias("text"))


def _glue(a: str, b: str) -> str:
    """The length of two texts joined; an empty one needs nothing between."""
    return f"({a} + {b} + CASE WHEN {a} > 0 AND {b} > 0 THEN 2 ELSE 0 END)"


def _sql(target: int, most: int, least: int) -> str:
    sec, marks = "document_id, section", C.MARKS.replace("\n", "' || chr(10) || '")
    head = "substr(rest, 1, room)"
    cut = f"CASE WHEN length(rest) <= room THEN length(rest) WHEN regexp_matches({head}, '[{marks}]') THEN length(regexp_extract({head}, '(?s)^.*[{marks}]')) WHEN regexp_matches({head}, '\\s') THEN length(regexp_extract({head}, '(?s)^.*\\s')) ELSE room END"
    return f"""RECURSIVE ln AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
ty AS (SELECT *, pos // 10 + 1 AS page, CASE WHEN length(line) <= 40 AND NOT line LIKE '%.' THEN 'title' WHEN (document_id * 7 + pos) % 6 = 0 AND length(line) <= 300 THEN 'formula' WHEN (document_id * 7 + pos) % 11 = 3 THEN 'table' WHEN (document_id * 7 + pos) % 17 = 5 THEN 'image' ELSE 'text' END AS type FROM ln),
st AS (SELECT *, CASE WHEN type = 'image' AND (document_id * 7 + pos) % 2 = 0 THEN '' ELSE line END AS own, type = 'title' AND coalesce(lag(type) OVER (PARTITION BY document_id ORDER BY pos), '') <> 'title' AND pos > 0 AS starts FROM ty),
bk AS (SELECT *, length(t) AS n, row_number() OVER (PARTITION BY {sec} ORDER BY pos) AS j FROM (SELECT document_id, pos, page, type, own, CASE type WHEN 'title' THEN '## ' || own WHEN 'formula' THEN '$$' || chr(10) || own || chr(10) || '$$' ELSE own END AS t, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM st)),
pk AS (
  SELECT {sec}, j, 1 AS c, CASE WHEN n <= {most} THEN n END AS pend, type = 'title' AS titles, CASE WHEN n > {most} AND type = 'text' THEN {most} END AS room FROM bk WHERE j = 1
  UNION ALL
  SELECT {sec}, j, CASE WHEN opens THEN c + 1 ELSE c END, CASE WHEN attach OR large THEN NULL WHEN opens THEN n ELSE pend + 2 + n END, CASE WHEN opens THEN type = 'title' ELSE titles AND type = 'title' END, CASE WHEN type = 'text' THEN CASE WHEN attach THEN greatest(1, {most} - pend - 2) WHEN large THEN {most} END END
  FROM (SELECT *, NOT attach AND (pend IS NULL OR large OR pend >= {target} OR pend + 2 + n > {most}) AS opens
    FROM (SELECT p.document_id, p.section, b.j, p.c, p.pend, p.titles, b.n, b.type, coalesce(p.titles AND p.pend + 2 + b.n > {most}, false) AS attach, b.n > {most} AS large FROM pk p JOIN bk b ON b.document_id = p.document_id AND b.section = p.section AND b.j = p.j + 1))),
sp AS (
  SELECT {sec}, j, 0 AS piece, '' AS got, t AS rest, room FROM pk JOIN bk USING (document_id, section, j) WHERE room IS NOT NULL
  UNION ALL
  SELECT {sec}, j, piece + 1, substr(rest, 1, {cut}), substr(rest, {cut} + 1), room FROM sp WHERE rest <> ''),
pc AS (SELECT {sec}, c, 1 AS piece, j, t AS txt, n, type, pos, page, true AS whole FROM pk JOIN bk USING (document_id, section, j) WHERE room IS NULL
  UNION ALL SELECT {sec}, c, sp.piece, j, sp.got, length(sp.got), type, pos, page, false FROM sp JOIN pk USING (document_id, section, j) JOIN bk USING (document_id, section, j) WHERE sp.piece > 0),
ch AS (SELECT *, row_number() OVER (PARTITION BY {sec} ORDER BY c, piece) AS i FROM (SELECT {sec}, c, piece, coalesce(length(string_agg(txt, '12' ORDER BY j) FILTER (WHERE txt <> '')), 0) AS len, count(*) AS nb, arg_max(n, j) AS last_n, bool_and(whole) AS whole, bool_and(type = 'formula') AS formulas FROM pc GROUP BY ALL)),
fm AS (
  SELECT {sec}, i, 1 AS g, len, last_n, whole, false AS moves FROM ch WHERE i = 1
  UNION ALL
  SELECT {sec}, i, CASE WHEN merges THEN g ELSE g + 1 END, CASE WHEN merges THEN {_glue('pl', 'len')} WHEN moves THEN {_glue('pn', 'len')} ELSE len END, last_n, CASE WHEN merges THEN pw AND whole ELSE whole END, moves
  FROM (SELECT *, alone AND NOT merges AND pw AND {_glue('pn', 'len')} <= {most} AS moves
    FROM (SELECT f.document_id, f.section, h.i, f.g, f.len AS pl, f.last_n AS pn, f.whole AS pw, h.len, h.last_n, h.whole, h.formulas AND h.len <= {most} AS alone, h.formulas AND h.len <= {most} AND {_glue('f.len', 'h.len')} <= {most} AS merges
      FROM fm f JOIN ch h ON h.document_id = f.document_id AND h.section = f.section AND h.i = f.i + 1))),
pl AS (SELECT p.*, h.i, p.j = max(p.j) OVER (PARTITION BY p.document_id, p.section, h.i) AS is_last FROM pc p JOIN ch h USING (document_id, section, c, piece)),
gr AS (SELECT l.*, CASE WHEN is_last AND coalesce(x.moves, false) THEN x.g ELSE f.g END AS g FROM pl l JOIN fm f ON f.document_id = l.document_id AND f.section = l.section AND f.i = l.i LEFT JOIN fm x ON x.document_id = l.document_id AND x.section = l.section AND x.i = l.i + 1),
gl AS (SELECT {sec}, g, coalesce(length(string_agg(txt, '12' ORDER BY j, piece) FILTER (WHERE txt <> '')), 0) AS len, list(DISTINCT pos) AS ps FROM gr GROUP BY ALL),
tl AS (SELECT {sec}, g FROM (SELECT *, lag(len) OVER w AS before, lag(ps) OVER w AS had, lead(g) OVER w AS after FROM gl WINDOW w AS (PARTITION BY {sec} ORDER BY g)) WHERE after IS NULL AND g > 1 AND len < {least} AND NOT list_has_any(ps, had) AND {_glue('before', 'len')} <= {most}),
fi AS (SELECT gr.*, CASE WHEN tl.g IS NOT NULL THEN gr.g - 1 ELSE gr.g END AS k FROM gr LEFT JOIN tl USING (document_id, section, g)),
ti AS (SELECT {sec}, list(own ORDER BY pos) AS path FROM bk WHERE type = 'title' GROUP BY ALL),
ag AS (SELECT {sec}, k, coalesce(string_agg(txt, chr(10) || chr(10) ORDER BY j, piece) FILTER (WHERE txt <> ''), '') AS text, list(pos ORDER BY j, piece) AS blocks, list(type ORDER BY j, piece) AS kinds, min(page) AS first_page, max(page) AS last_page FROM fi GROUP BY ALL),
chunk AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY section, k) - 1 AS ordinal, section, coalesce(path, []) AS path, text, length(text) AS n_chars, blocks, list_filter(kinds, lambda t, x: list_position(kinds, t) = x) AS types, first_page, last_page FROM ag LEFT JOIN ti USING (document_id, section))"""


_LIMITS = (C.TARGET, C.MOST, C.LEAST)
_SMALL = (300, 400, 60)


@query(f"WITH {_sql(*_LIMITS)} SELECT * FROM chunk")
def chunk_documents(spark, sf_dir):
    return C.chunk(_blocks(spark, sf_dir))


@query(f"WITH {_sql(*_SMALL)} SELECT * FROM chunk")
def chunk_small(spark, sf_dir):
    """Chunks of at most 400 characters, so that long lines are cut and formulas have to look for context."""
    return C.chunk(_blocks(spark, sf_dir), *_SMALL)


def _spread(v: str, name: str) -> str:
    return f"min({v}) AS {name}_min, " + ", ".join(f"round(quantile_cont({v}, {q}), 3) AS {name}_{n}" for q, n in ((0.5, "median"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"))) + f", max({v}) AS {name}_max"


def _kinds(name: str, what: str) -> str:
    return ", ".join([f"count(*) FILTER (WHERE {what}) AS {name}", *[f"count(*) FILTER (WHERE {what} AND atom = '{k}') AS {name}_{k}" for k in ("table", "formula", "image")]])


@query(f"""WITH {_sql(*_SMALL)},
us AS (SELECT document_id, pos, count(*) AS uses FROM (SELECT document_id, unnest(blocks) AS pos FROM chunk) GROUP BY 1, 2),
ob AS (SELECT count(DISTINCT document_id) AS documents, count(DISTINCT (document_id, page)) AS pages, count(*) AS source_blocks, count(uses) AS referenced_blocks, count(*) FILTER (WHERE uses IS NULL) AS unreferenced_blocks, count(*) FILTER (WHERE uses > 1) AS multiply_referenced, round(count(uses) / count(*)::DOUBLE, 6) AS coverage_rate,
  count(DISTINCT (document_id, section)) AS sections, count(*) FILTER (WHERE type = 'text' AND n > {_SMALL[1]}) AS oversized_text_blocks, count(*) FILTER (WHERE type <> 'text' AND n > {_SMALL[1]}) AS oversized_other_blocks, round(count(uses) FILTER (WHERE type IN ('table', 'image')) / (count(*) FILTER (WHERE type IN ('table', 'image')))::DOUBLE, 6) AS asset_coverage_rate FROM bk LEFT JOIN us USING (document_id, pos)),
pg AS (SELECT document_id, ordinal, c.section, n_chars, types, len(list_distinct(blocks)) AS n_blocks, b.page, b.type, b.n FROM (SELECT *, unnest(list_distinct(blocks)) AS pos FROM chunk) c JOIN bk b USING (document_id, pos)),
pr AS (SELECT document_id, ordinal, section, n_chars, types, n_blocks, count(DISTINCT page) AS n_pages, count(*) FILTER (WHERE type IN ('table', 'formula', 'image')) AS atomic, max(type) FILTER (WHERE type IN ('table', 'formula', 'image')) AS atom, max(n) FILTER (WHERE type IN ('table', 'formula', 'image')) AS atom_chars FROM pg GROUP BY ALL),
pw AS (SELECT *, lag(section) OVER (PARTITION BY document_id ORDER BY ordinal) AS before, count(*) OVER (PARTITION BY document_id, section) AS of_section FROM pr),
oc AS (SELECT count(*) AS chunks, {_spread('n_chars', 'chars')}, {_spread('n_pages', 'pages')}, {_spread('n_blocks', 'blocks')}, count(*) FILTER (WHERE before <> section) AS section_boundary_splits, count(DISTINCT CASE WHEN of_section > 1 THEN (document_id, section) END) AS sections_split, count(*) FILTER (WHERE n_chars > {_SMALL[1]}) AS over_most,
  {_kinds('single', 'n_blocks = 1 AND atomic = 1')}, {_kinds('oversized_atomic', f"atomic = 1 AND NOT list_contains(types, 'text') AND atom_chars > {_SMALL[1]}")}, {", ".join(f"count(*) FILTER (WHERE list_contains(types, '{k}')) AS with_{k}" for k in ("table", "formula", "image"))} FROM pw)
SELECT * FROM ob, oc""")
def chunk_statistics(spark, sf_dir):
    blocks = _blocks(spark, sf_dir)
    return C.summary(blocks, C.chunk(blocks, *_SMALL), *_SMALL[:2])


@query(f"""WITH {_sql(*_SMALL)},
pb AS (SELECT document_id, ordinal, CASE (document_id + ordinal) % 11 WHEN 1 THEN 'absent_block' WHEN 2 THEN CASE WHEN len(blocks) > 1 THEN 'order' END WHEN 3 THEN 'pages' WHEN 4 THEN 'section' WHEN 5 THEN 'types' END AS problem FROM chunk),
nb AS (SELECT document_id, unnest(CASE (document_id + ordinal) % 11 WHEN 6 THEN [] WHEN 1 THEN [] ELSE blocks END) AS pos FROM chunk)
SELECT problem, count(*) AS n FROM pb WHERE problem IS NOT NULL GROUP BY 1 UNION ALL SELECT 'uncovered', count(*) FROM bk WHERE (document_id, pos) NOT IN (SELECT (document_id, pos) FROM nb)""")
def chunk_lineage(spark, sf_dir):
    """Chunks of which every eleventh is damaged in one of five ways, every eleventh is missing, against their blocks."""
    blocks = _blocks(spark, sf_dir)
    m = (F.col("document_id") + F.col("ordinal")) % 11
    damaged = C.chunk(blocks, *_SMALL).where(m != 6).withColumns({
        "blocks": F.when(m == 1, F.array(F.lit(1_000_000))).when(m == 2, F.reverse("blocks")).otherwise(F.col("blocks")),
        "last_page": F.when(m == 3, F.col("last_page") + 1).otherwise(F.col("last_page")),
        "section": F.when(m == 4, F.col("section") + 1).otherwise(F.col("section")),
        "types": F.when(m == 5, F.array_append("types", "video")).otherwise(F.col("types")),
    })
    return C.lineage(blocks, damaged).groupBy("problem").agg(F.count("*").alias("n"))
