"""Queries over scoped search, fusion, reranking, citations and equivalence, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidemark.functions import questions as Q, text as T
from tidemark.operators import evaluation as E, evidence, retrieval, search as S
from tidemark.plans import equivalence
from tidemark.plans.catalog import _DENSE, _INDEX, NAMES, _vectors, query
from tidemark.plans.store import _BLOCKS, _blocks
from tidemark.sources.tables import table, written

_TERMS = r"regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+(?:[._-][\p{{L}}\p{{N}}]+)*')"


@query(f"""WITH tok AS (SELECT source AS kb, doc_id, unnest({_TERMS.format('text')}) AS term FROM documents WHERE source IS NOT NULL), idx AS (SELECT kb, doc_id, term, count(*) AS tf FROM tok GROUP BY ALL),
qt AS (SELECT DISTINCT item_id AS query_id, source AS kb, term FROM (SELECT item_id, source, unnest({_TERMS.format('b.text')}) AS term FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)),
len AS (SELECT kb, doc_id, sum(tf) AS len FROM idx GROUP BY ALL), sc AS (SELECT kb, count(*) AS n, avg(len) AS a FROM len GROUP BY 1), dfs AS (SELECT kb, term, count(*) AS df FROM idx GROUP BY ALL),
bs AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 4) AS score, string_agg(term, ' ' ORDER BY term) AS matched FROM qt JOIN idx USING (kb, term) JOIN dfs USING (kb, term) JOIN len USING (kb, doc_id) JOIN sc USING (kb) GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score, matched FROM bs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10""")
def bm25_scoped(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("kb"), "doc_id", "text")
    q = table(spark, sf_dir, "benchmark").join(d.select("kb", F.col("doc_id").alias("item_id")), "item_id").select(F.col("item_id").alias("query_id"), "kb", "text")
    return S.scoped_bm25(d, q, T.tokens).select("query_id", F.col("rank").cast("long"), "doc_id", "score", "matched")


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def payload_join(spark, sf_dir):
    return S.attach(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select("o_orderkey", "o_custkey", "c_mktsegment")


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'gone' WHEN o_totalprice > 300000 THEN 'mismatch' ELSE 'valid' END AS state, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def hit_revalidation(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    hits = table(spark, sf_dir, "orders").join(c, "o_custkey").withColumn("c_nationkey", F.when(F.col("o_totalprice") > 300000, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    return S.revalidated(hits, c.where("o_custkey % 3 <> 0"), "o_custkey", ["c_nationkey", "c_mktsegment"]).groupBy("state").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT o_custkey AS q, o_orderstatus AS kb, o_orderkey AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), g AS (SELECT o_custkey AS q, o_orderstatus AS kb, o_orderkey AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT q, coalesce(v.kb, g.kb) AS kb, d, v.r AS a, g.r AS b, round(coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + g.r), 0), 12) AS score FROM (SELECT * FROM v WHERE r <= 20) v FULL JOIN (SELECT * FROM g WHERE r <= 20) g USING (q, d))
SELECT q AS query_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, kb, d % 50, d % 7, d) AS rank, d AS chunk_id, score, CASE WHEN b IS NULL THEN 'vector' WHEN a IS NULL THEN 'graph' ELSE 'both' END AS source FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, kb, d % 50, d % 7, d) <= 10""")
def hybrid_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", F.col("rank").cast("long"), "chunk_id", "score", "source")


def _fused(spark, d):
    o, w = table(spark, d, "orders"), Window.partitionBy("o_custkey")
    page = (F.col("o_orderkey") % 7).cast("int")
    base = lambda df, *order: df.select(F.col("o_custkey").alias("query_id"), F.col("o_orderstatus").alias("kb"), (F.col("o_orderkey") % 50).alias("document_id"), F.col("o_orderkey").alias("chunk_id"), F.row_number().over(w.orderBy(*order)).alias("rank"), page.alias("first"), page.alias("last"), F.array(page).alias("blocks")).where("rank <= 20")
    return S.hybrid(base(o, F.desc("o_totalprice"), F.col("o_orderkey")), base(o.where("o_orderstatus <> 'P'"), "o_orderdate", "o_orderkey"))


@query("""WITH v AS (SELECT o_custkey AS q, o_orderstatus AS kb, o_orderkey AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders), g AS (SELECT o_custkey AS q, o_orderstatus AS kb, o_orderkey AS d, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus <> 'P'),
f AS (SELECT q, coalesce(v.kb, g.kb) AS kb, d, v.r AS a, g.r AS b, round(coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce(1.0::DOUBLE / (60 + g.r), 0), 12) AS score FROM (SELECT * FROM v WHERE r <= 20) v FULL JOIN (SELECT * FROM g WHERE r <= 20) g USING (q, d)),
t AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, kb, d % 50, d % 7, d) <= 10) SELECT count(*) FILTER (b IS NULL) AS vector, count(*) FILTER (a IS NULL) AS graph, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS "both" FROM t""")
def source_distribution(spark, sf_dir):
    return S.source_distribution(_fused(spark, sf_dir))


def _ranked(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"), "o_orderpriority")


@query("""WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS before, o_orderpriority AS s FROM orders)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, before) AS rank, before FROM r WHERE before <= 20 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, before) <= 10""")
def rerank_topk(spark, sf_dir):
    return S.rerank(_ranked(spark, sf_dir).where("rank <= 20"), F.col("o_orderpriority"), 10).select("query_id", "doc_id", F.col("rank").cast("long"), F.col("before").cast("long"))


@query("""WITH r AS (SELECT o_custkey AS q, o_orderkey AS d, o_orderpriority = '1-URGENT' AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders),
m AS (SELECT *, row_number() OVER (PARTITION BY q, s ORDER BY r) AS nth, count(*) FILTER (s AND r <= 8) OVER (PARTITION BY q) AS have FROM r),
e AS (SELECT *, s AND nth > have AND nth <= have + greatest(2 - have, 0) AS spare FROM m), n AS (SELECT *, count(*) FILTER (spare) OVER (PARTITION BY q) AS ns FROM e)
SELECT q AS query_id, d AS doc_id, s AS special, row_number() OVER (PARTITION BY q ORDER BY r) AS rank FROM n WHERE spare OR r <= 8 - ns""")
def final_quota(spark, sf_dir):
    r = _ranked(spark, sf_dir)
    return retrieval.quota(r, F.col("o_orderpriority") == "1-URGENT", 8, 2).select("query_id", "doc_id", "special", F.col("rank").cast("long"))


@query("""WITH u AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT query_id, doc_id, rank, 'dense' AS branch, 'graph' AS failed FROM u WHERE rank <= 3""")
def branch_policy(spark, sf_dir):
    def broken():
        return table(spark, sf_dir, "orders").select(F.raise_error(F.lit("no graph store")).cast("long").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("rank"))

    rows, failed = S.gather({"dense": lambda: _ranked(spark, sf_dir).where("rank <= 3"), "graph": broken}, "degraded")
    return rows.select("query_id", "doc_id", F.col("rank").cast("long"), "branch", F.lit(",".join(failed)).alias("failed"))


@query("SELECT c_custkey AS query_id, 'C' || n AS marker FROM customer, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n) WHERE n = c_custkey % 4 + 1 OR n = 6 OR (n = 5 AND c_nationkey = 3)")
def cited_candidates(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "query_id")
    candidates = c.select("query_id", F.explode(F.array(*[F.lit(f"C{n}") for n in range(1, 7)])).alias("marker"))
    answers = c.select("query_id", F.concat(F.lit("As [C"), (F.col("query_id") % 4 + 1).cast("string"), F.lit("] and [C6] say, not (C2), [C06] or [D3].")).alias("answer"))
    return S.cited(candidates, answers, c.where("c_nationkey = 3").select("query_id", F.lit("C5").alias("marker")))


@query("SELECT count(*) AS n, count(DISTINCT l_suppkey) AS documents FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 5 AND l_returnflag = 'N' AND l_tax <= 0.06")
def visible_points(spark, sf_dir):
    points = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("kb"), F.col("l_suppkey").alias("document_id"), F.col("l_returnflag").alias("modality"), (F.col("l_quantity") > 5).alias("searchable"), F.when(F.col("l_tax") > 0.06, True).alias("quarantined"))
    return S.visible(points, kb="O", modality="N").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, d.vec_id, d.vec_id // 2 AS asset, round(list_inner_product(q.v, d.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(d.v, d.v))), 5) + 0.0 AS score FROM v q, v d WHERE q.vec_id % 100 = 0 AND q.vec_id <> d.vec_id AND d.label % 2 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, asset ORDER BY r) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank, vec_id, score FROM o QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r) <= 10""")
def visual_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumnRenamed("embedding", "v")
    active = v.join(table(spark, sf_dir, "embeddings").where("label % 2 = 0").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")  # the active generation, before the search
    found = retrieval.exact_knn(spark, active, v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id"), 20)
    once = S.distinct_assets(found.withColumn("asset", F.floor(F.col("doc_id") / 2)), ["asset"], 10)
    return once.select("query_id", F.col("rank").cast("long"), F.col("doc_id").alias("vec_id"), "score")


@query("SELECT doc_id AS chunk_id, [length(text), len(regexp_extract_all(text, 'e'))]::DOUBLE[] AS vector FROM documents WHERE trim(text, ' ') <> ''")
def index_build(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return S.build_index(chunks, lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])


@query("""SELECT o_orderkey AS query_id, o_orderstatus = 'F' OR year(o_orderdate) = 1996 AS bound FROM orders""")
def evidence_sufficiency(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "query_id")
    year = F.year("o_orderdate")
    needs = o.select("query_id", "o_orderpriority", year.alias("year")).select("query_id", F.col("o_orderpriority").alias("object"), "year", F.lit("revenue").alias("metric"))
    whole = F.concat(F.lit("REVENUE of "), "o_orderpriority", F.lit(" in "), year.cast("string"))
    told = o.select("query_id", F.explode(F.array(F.when((F.col("o_orderstatus") == "F") | (year == 1996), whole).otherwise(F.concat(F.lit("revenue in "), year.cast("string"))), F.concat("o_orderpriority", F.lit(" alone")))).alias("text"))
    return S.sufficiency(needs, told).select("query_id", "bound")


@query("""SELECT o_orderkey AS query_id, o_orderpriority || ' ' || year(o_orderdate) || ' revenue' AS query FROM orders WHERE o_orderstatus <> 'F'""")
def supplementary_query(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    told = o.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("object"), F.year("o_orderdate").alias("year"), F.lit("revenue").alias("metric"), (F.col("o_orderstatus") == "F").alias("bound"))
    return S.supplementary(told)


@query("""WITH k AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') AS k FROM conversations WHERE text IS NOT NULL), e AS (SELECT * FROM k WHERE turn < 2 AND k <> ''), x AS (SELECT * FROM k WHERE turn >= 2 AND k <> '')
SELECT conv_id AS "user", turn AS at FROM x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = x.conv_id AND (contains(e.k, x.k) OR contains(x.k, e.k))) QUALIFY row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) = 1""")
def memory_dedupe(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("user"), F.col("turn").alias("at"), F.col("text").alias("note"))
    return S.new_memories(c.where("at >= 2"), c.where("at < 2"), Q.memory_key).select("user", "at")


@query(f"""WITH {_BLOCKS} SELECT conv_id AS document_id, 'p' || page || '-b' || nth AS block_id, CASE m WHEN 0 THEN '## ' || text WHEN 2 THEN 'a' || chr(10) || 'b' || chr(10) || '<table>' || text || '</table>' WHEN 3 THEN 'figure' WHEN 4 THEN '$$' || text || '$$' ELSE text END AS rendered FROM nb WHERE kept""")
def block_render(spark, sf_dir):
    return _blocks(spark, sf_dir).where("block_id IS NOT NULL").select("document_id", "block_id", S.rendered(F.col("type"), F.col("text"), F.col("caption")).alias("rendered"))


@query("SELECT s_suppkey, coalesce(nullif(trim(CASE WHEN s_nationkey % 2 = 0 THEN '  ' ELSE s_name END), ''), 'Nation ' || s_nationkey || ' [table, text]') AS text FROM supplier")
def rerank_text(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", Q.rerank_text(F.when(F.col("s_nationkey") % 2 == 0, "  ").otherwise(F.col("s_name")), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")), F.array(F.lit("text"), F.lit("table"))).alias("text"))


@query("SELECT p_partkey, p_name || ' x' || p_size AS name FROM part")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", Q.safe_name(F.concat(F.lit(" /"), F.replace("p_name", F.lit(" "), F.lit("\t: ")), F.lit("<>\x01x"), F.col("p_size").cast("string"), F.lit("  "))).alias("name"))


@query("SELECT DISTINCT ON (o_custkey, o_orderpriority) o_custkey, o_orderpriority, o_orderkey FROM orders ORDER BY o_custkey, o_orderpriority, o_orderkey")
def first_seen(spark, sf_dir):
    return retrieval.first_seen(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("""SELECT CASE WHEN user_id % 3 = 0 AND value * 10000 <= 600000 THEN 'text_only' ELSE 'text_and_visual' END AS mode, CASE WHEN user_id % 3 = 1 THEN 'table_on_page' WHEN user_id % 3 = 2 THEN 'several_images' WHEN value * 10000 > 600000 THEN 'large_image' ELSE 'text_suffices' END AS reason, count(*) AS n FROM events GROUP BY 1, 2""")
def visual_index_selection(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    told = Q.visual_policy(F.lit("A bird above the river at dawn"), F.repeat(F.lit("context "), 14), F.col("value") * 10000, F.when(F.col("user_id") % 3 == 2, 2).otherwise(1), F.col("user_id") % 3 == 1)
    return e.select(told.alias("p")).groupBy("p.mode", "p.reason").agg(F.count("*").alias("n"))


@query("""SELECT source, CAST(count(*) AS BIGINT) AS planned, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS stored, count(*) = count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS published FROM documents GROUP BY 1""")
def publish_verification(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    told = evidence.coverage(d, table(spark, sf_dir, "labels"), "doc_id", ["source"])
    return told.select("source", F.col("expected").alias("planned"), F.col("found").alias("stored"), (F.col("missing") == 0).alias("published"))


_CASES = [
    ("SELECT n_name FROM nation WHERE n_nationkey > 3 AND n_regionkey = 1", "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 3", "equal"),
    ("SELECT n_name FROM nation WHERE n_nationkey > 3", "SELECT n_name FROM nation WHERE n_nationkey > 4", "unknown"),
    ("SELECT n_name FROM nation", "SELECT n_nationkey FROM nation", "different"),
    ("SELECT n_name FROM (SELECT n_name, n_nationkey FROM nation) t WHERE n_nationkey = 2 + 1", "SELECT n_name FROM nation WHERE n_nationkey = 3", "equal"),
    ("SELECT DISTINCT n_regionkey FROM nation", "SELECT n_regionkey FROM nation GROUP BY n_regionkey", "equal"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{want}')" for i, (_, _, want) in enumerate(_CASES)) + ") t(nth, verdict)")
def semantic_equivalence(spark, sf_dir):
    for name in NAMES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.createDataFrame([(i, equivalence.compare_plans(spark, a, b)) for i, (a, b, _) in enumerate(_CASES)], "nth int, verdict string")


@query("SELECT false AS equal, count(*) AS rows_a, count(*) AS rows_b, count(*) FILTER (o_orderkey % 100 = 0) AS differing FROM orders")
def result_tolerance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    moved = o.withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 100 == 0, 0.01).otherwise(1e-10))
    return equivalence.same_results(o, moved)


@query("SELECT 'test' AS split, 100 AS n UNION ALL SELECT 'dev', count(*) - 100 FROM customer")
def group_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("item"), F.floor(F.col("o_orderkey") / 2).alias("signature"))
    groups = E.leakage_groups(spark, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item")), o)
    sizes = groups.groupBy("group").agg(F.count("*").cast("int").alias("n"))
    # groups of one size are alike: the search sees a few sizes, then the first groups of each are taken
    counts = {r["n"]: r["c"] for r in sizes.groupBy("n").agg(F.count("*").alias("c")).collect()}
    units = [((n, i), n) for n, c in counts.items() for i in range(min(c, 100 // n + 1))]
    chosen = E.split_groups(units, 100)
    take = spark.createDataFrame([(n, sum(1 for m, _ in chosen if m == n)) for n in counts], "n int, take int")
    nth = F.row_number().over(Window.partitionBy("n").orderBy("group"))
    marked = sizes.withColumn("nth", nth).join(take, "n").withColumn("split", F.when(F.col("nth") <= F.col("take"), "test").otherwise("dev"))
    return marked.groupBy("split").agg(F.sum("n").alias("n"))


# Five branches over documents: vectors, words, documents of the best one's source and language, pairs of documents by their better vector, and vectors of every seventh document as pictures.
@query(f"""WITH {_INDEX}, {_DENSE.format('q.doc_id IN (SELECT item_id FROM benchmark)')},
gr AS (SELECT b.query_id, d.doc_id, row_number() OVER (PARTITION BY b.query_id ORDER BY d.doc_id) AS rank FROM bm b JOIN documents o ON o.doc_id = b.doc_id AND b.rank = 1 JOIN documents d ON d.source = o.source AND d.lang = o.lang),
mm AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM (SELECT query_id, doc_id // 2 * 2 AS doc_id, max(score) AS s FROM dn WHERE rank <= 40 GROUP BY 1, 2)),
vi AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds WHERE doc_id % 7 = 0),
u AS (SELECT query_id, doc_id, rank AS r, 0 AS b, 'dense' AS n FROM dn WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank, 1, 'sparse' FROM bm WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank, 2, 'graph' FROM gr WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank, 3, 'multimodal' FROM mm WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank, 4, 'visual' FROM vi WHERE rank <= 8),
pl AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY min(r * 5 + b)) AS pos, list_sort(list_distinct(list(n))) AS branches FROM u GROUP BY 1, 2 QUALIFY pos <= 48),
nt AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1), mt AS (SELECT p.query_id, p.doc_id, count(*) AS k FROM pl p JOIN qt USING (query_id) JOIN idx ON idx.doc_id = p.doc_id AND idx.term = qt.term GROUP BY 1, 2),
sd AS (SELECT p.*, round(coalesce(k, 0) / n::DOUBLE, 6) AS score, p.doc_id % 7 = 0 AS special FROM pl p LEFT JOIN nt USING (query_id) LEFT JOIN mt USING (query_id, doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, pos) AS r FROM sd),
hv AS (SELECT *, count(*) FILTER (WHERE special AND r <= 8) OVER (PARTITION BY query_id) AS have, row_number() OVER (PARTITION BY query_id, special ORDER BY r) AS nth FROM rk),
sp AS (SELECT *, special AND nth > have AND nth <= have + greatest(2 - have, 0) AS spare FROM hv), ns AS (SELECT *, count(*) FILTER (WHERE spare) OVER (PARTITION BY query_id) AS spares FROM sp)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank, doc_id, score, branches, special FROM ns WHERE spare OR r <= 8 - spares""")
def unified_retrieval(spark, sf_dir):
    from tidemark.operators import unified as U
    from tidemark.plans.catalog import _bm25, _dense

    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = _bm25(spark, sf_dir, 20).select("query_id", "rank", "doc_id", "score")  # the matched terms of all pairs would be collected to be written
    sparse, dense = written(spark, found, "sparse"), written(spark, _dense(spark, sf_dir, 40), "dense")
    top = sparse.where("rank = 1").select("query_id", "doc_id").join(docs.select("doc_id", "source", "lang"), "doc_id").select("query_id", "source", "lang")
    near = top.join(docs.select("doc_id", "source", "lang"), ["source", "lang"]).select("query_id", "doc_id")
    graph = retrieval.top(near, "query_id", [F.asc("doc_id")], 20)
    pairs = dense.groupBy("query_id", (F.floor(F.col("doc_id") / 2) * 2).alias("doc_id")).agg(F.max("score").alias("score"))
    multimodal = retrieval.top(pairs, "query_id", [F.desc("score"), F.asc("doc_id")], 20)
    v = _vectors(spark, sf_dir).withColumnRenamed("embedding", "v")
    visual = retrieval.exact_knn(spark, v.where("doc_id % 7 = 0"), v.join(items.select(F.col("item_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id"), 8)
    branches = {"dense": dense, "sparse": sparse, "graph": graph, "multimodal": multimodal, "visual": visual}
    found = U.search(spark, items.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), docs, branches, visual=F.col("doc_id") % 7 == 0)
    return found.select("query_id", F.col("rank").cast("long"), "doc_id", "score", "branches", "special")


@query("""WITH RECURSIVE h AS (SELECT o_custkey AS query_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderkey % 50 AS doc_id, [month(o_orderdate) % 6, month(o_orderdate) % 6 + 1] AS blocks, o_orderstatus AS text FROM orders),
o AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) = 1), j AS (SELECT *, row_number() OVER (PARTITION BY query_id, text ORDER BY rank) AS j FROM o),
f AS (SELECT query_id, text, rank, doc_id, blocks, j, blocks AS seen, true AS kept FROM j WHERE j = 1
  UNION ALL SELECT j.query_id, j.text, j.rank, j.doc_id, j.blocks, j.j, CASE WHEN list_has_any(f.seen, j.blocks) THEN f.seen ELSE list_concat(f.seen, j.blocks) END, NOT list_has_any(f.seen, j.blocks) FROM f JOIN j ON j.query_id = f.query_id AND j.text = f.text AND j.j = f.j + 1)
SELECT query_id, rank, doc_id, text FROM f WHERE kept""")
def distinct_context(spark, sf_dir):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    block = F.month("o_orderdate") % 6
    hits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), F.row_number().over(order).alias("rank"), (F.col("o_orderkey") % 50).alias("doc_id"), F.array(block, block + 1).alias("blocks"), F.col("o_orderstatus").alias("text"))
    return retrieval.distinct_context(hits).select("query_id", F.col("rank").cast("long"), "doc_id", "text")
