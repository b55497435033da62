"""The registry of queries over the input tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


from pyspark.sql import Window, functions as F  # noqa: E402

from tidemark.functions import questions as Q  # noqa: E402
from tidemark.operators import chunking, graph, metrics, retrieval, tables  # noqa: E402
from tidemark.plans import guard  # noqa: E402
from tidemark.sources import html_tables  # noqa: E402
from tidemark.sources.tables import table  # noqa: E402
from tidemark.streaming import ingest  # noqa: E402

_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+(?:[._-][a-z0-9]+)*')"
_INDEX = f"""tok AS (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents),
idx AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
qt AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark)),
len AS (SELECT doc_id, sum(tf) AS len FROM idx GROUP BY 1),
sc AS (SELECT count(*) AS n, avg(len) AS a FROM len),
dfs AS (SELECT term, count(*) AS df FROM idx WHERE term IN (SELECT term FROM qt) GROUP BY 1),
bs AS (SELECT qt.query_id, idx.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 4) AS score
  FROM idx JOIN qt USING (term) JOIN dfs USING (term) JOIN len USING (doc_id), sc GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs)"""
_DENSE = """v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ds AS (SELECT q.doc_id AS query_id, d.doc_id, round(list_inner_product(q.v, d.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(d.v, d.v))), 5) AS score
  FROM v q, v d WHERE {} AND q.doc_id <> d.doc_id),
dn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ds)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def _bm25(spark, d, k):
    return retrieval.bm25(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), k)


def _dense(spark, d, k):
    v = _vectors(spark, d).withColumnRenamed("embedding", "v")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return retrieval.exact_knn(spark, v, v.join(items, "doc_id", "left_semi").withColumnRenamed("doc_id", "query_id"), k)


@query(f"WITH {_INDEX} SELECT query_id, rank, doc_id, score FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10).select("query_id", F.col("rank").cast("long"), "doc_id", "score")


@query(f"WITH tok AS (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents), idx AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM idx GROUP BY 1")
def term_stats(spark, sf_dir):
    return retrieval.postings(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(f"WITH tok AS (SELECT doc_id, unnest({_TOK.format('text')}) AS term FROM documents) SELECT doc_id, count(*) AS len, count(DISTINCT term) AS terms FROM tok GROUP BY 1")
def doc_lengths(spark, sf_dir):
    return retrieval.postings(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.sum("tf").alias("len"), F.count("*").alias("terms"))


@query(f"WITH {_DENSE.format('q.doc_id % 100 = 0')} SELECT query_id, rank, doc_id, score FROM dn WHERE rank <= 10")
def exact_knn_batch(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumnRenamed("embedding", "v")
    q = v.where("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")  # the stated query set, against all rows
    return retrieval.exact_knn(spark, v, q, 10).select("query_id", F.col("rank").cast("long"), "doc_id", "score")


_FUSE = f"""WITH {_INDEX}, {_DENSE.format('q.doc_id IN (SELECT item_id FROM benchmark)')},
u AS (SELECT query_id, doc_id, rank AS r, 0 AS b FROM bm WHERE rank <= 50 UNION ALL SELECT query_id, doc_id, rank, 1 FROM dn WHERE rank <= 50)"""


@query(f"""{_FUSE}, f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, min(r) AS best FROM u GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best, doc_id) AS rank FROM f) SELECT query_id, rank, doc_id, score FROM o WHERE rank <= 10""")
def rrf_fusion(spark, sf_dir):
    return retrieval.rrf([_bm25(spark, sf_dir, 50), _dense(spark, sf_dir, 50)], 10).select("query_id", F.col("rank").cast("long"), "doc_id", "score")


@query(f"""{_FUSE}, f AS (SELECT query_id, doc_id, min(r * 2 + b) AS pos FROM u GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM f) SELECT query_id, rank, doc_id FROM o WHERE rank <= 48""")
def fair_pool(spark, sf_dir):
    return retrieval.fair_pool([_bm25(spark, sf_dir, 50), _dense(spark, sf_dir, 50)], 48).select("query_id", F.col("rank").cast("long"), "doc_id")


@query(f"""WITH RECURSIVE {_INDEX}, h AS (SELECT query_id, rank, bm.doc_id, length(text) AS size FROM bm JOIN documents USING (doc_id) WHERE rank <= 10),
p AS (SELECT query_id, 0::BIGINT AS rank, NULL::BIGINT AS doc_id, 0::BIGINT AS size, 0::BIGINT AS used, 0 AS n FROM h GROUP BY 1
  UNION ALL SELECT p.query_id, h.rank, CASE WHEN used + h.size <= 8000 THEN h.doc_id END, h.size, CASE WHEN used + h.size <= 8000 THEN used + h.size ELSE used END, CASE WHEN used + h.size <= 8000 THEN n + 1 ELSE n END FROM p JOIN h ON h.query_id = p.query_id AND h.rank = p.rank + 1)
SELECT query_id, 'C' || n AS marker, doc_id, size FROM p WHERE doc_id IS NOT NULL""")
def context_pack(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("size"))
    return retrieval.pack_context(_bm25(spark, sf_dir, 10).select("query_id", "rank", "doc_id").join(sizes, "doc_id"), 8000)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE CAST(o_totalprice AS DECIMAL(18,6)) > 200000 AND o_orderpriority = '1-URGENT'")
def table_filter(spark, sf_dir):
    from decimal import Decimal

    o = table(spark, sf_dir, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,6)"))
    found = tables.filter_text(tables.filter_number(o, "price", "gt", Decimal(200000)), F.col("o_orderpriority"), "eq", "1-URGENT")
    return found.select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey AS row, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 50")
def table_sort(spark, sf_dir):
    return tables.sort(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row"), "s_name", "s_acctbal"), "s_acctbal", descending=True)


@query("SELECT s_name, s_nationkey, s_suppkey AS row FROM supplier WHERE s_suppkey IN (3, 1, 2)")
def table_select(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "row")
    return tables.select(df, ["s_name", "s_nationkey"], [3, 1, 2]).drop("request")


@query("SELECT c_mktsegment AS segment, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(min(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS least, CAST(max(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS most FROM customer GROUP BY 1")
def table_aggregate(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").cast("decimal(18,2)").alias("v"))
    return tables.aggregate(df, "v", ["sum", "min", "max"], "segment").select("segment", F.col("sum").cast("double").alias("total"), F.col("min").cast("double").alias("least"), F.col("max").cast("double").alias("most"))


@query("SELECT round(avg(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE, 4) AS mean, CAST(max(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS most FROM orders")
def table_aggregate_all(spark, sf_dir):
    """All rows as one group."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row"), F.col("o_totalprice").cast("decimal(18,2)").alias("v"))
    return tables.aggregate(df, "v", ["avg", "max"]).select(F.round(F.col("avg").cast("double"), 4).alias("mean"), F.col("max").cast("double").alias("most"))


@query("""WITH y AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderstatus, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total FROM orders GROUP BY 1, 2)
SELECT yr, o_orderstatus, CAST(total AS DOUBLE) AS total, CAST(total - lag(total) OVER (PARTITION BY o_orderstatus ORDER BY yr) AS DOUBLE) AS delta FROM y""")
def table_growth(spark, sf_dir):
    y = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("yr"), "o_orderstatus").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    return tables.growth(y, "total", "yr", ["o_orderstatus"]).select("yr", "o_orderstatus", F.col("total").cast("double"), F.col("delta").cast("double"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT c.k, CAST(c.n AS DOUBLE) AS a, CAST(s.n AS DOUBLE) AS b, CAST(c.n - s.n AS DOUBLE) AS difference FROM c JOIN s USING (k)""")
def table_compare(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("v")).withColumn("row", F.col("k"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("v")).withColumn("row", F.col("k"))
    return tables.compare(a, b, "k", "v").select("k", *[F.col(c).cast("double") for c in ("a", "b", "difference")])


# SQL shapes: the same text runs through the guard here and in DuckDB there.
SHAPES = {
    "sql_group_having": "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders GROUP BY o_custkey HAVING count(*) >= 12",
    "sql_join_group": "SELECT n_name, count(*) AS n, min(c_acctbal) AS least FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "sql_anti_join": "SELECT c_custkey, c_name FROM customer LEFT JOIN (SELECT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') o ON c_custkey = k WHERE k IS NULL ORDER BY c_custkey",
    "sql_cte_set": "WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier) SELECT k FROM a INTERSECT SELECT k FROM b",
    "sql_union": "SELECT n_name AS name FROM nation UNION SELECT r_name AS name FROM region",
    "sql_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 9000",
    "sql_union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region",
    "sql_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey AS k FROM supplier",
    "sql_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey AS k FROM supplier",
    "sql_ranks": "SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal) % 10) AS r, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal) % 10) AS d FROM supplier",
    "sql_values_over": "SELECT s_suppkey, lead(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS after, first_value(s_suppkey) OVER w AS first, last_value(s_suppkey) OVER w AS last, nth_value(s_suppkey, 2) OVER w AS second FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "sql_range_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n, max(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE UNBOUNDED PRECEDING) AS m FROM part",
    "sql_right_join": "SELECT r_name, n_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey > 12",
    "sql_full_join": "SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) s FULL JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) c ON s_suppkey = c_custkey",
    "sql_semi_in": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "sql_lateral": "SELECT n_name, t.n FROM nation, LATERAL (SELECT count(*) AS n FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) t",
    "sql_values": "SELECT v.k, n_name FROM (VALUES (1, 'one'), (2, 'two'), (99, 'none')) AS v(k, w) LEFT JOIN nation ON v.k = n_nationkey",
    "sql_bools": "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS all_large, bool_or(o_totalprice > 400000) AS any_huge FROM orders GROUP BY o_orderstatus",
    "sql_avg": "SELECT c_mktsegment, round(avg(c_acctbal), 6) AS mean, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY c_mktsegment",
    "sql_string_agg": "SELECT n_regionkey, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "sql_math": "SELECT s_suppkey, abs(s_acctbal) AS a, ceil(s_acctbal) + floor(s_acctbal) AS b, mod(s_suppkey, 7) AS c, round(power(s_nationkey, 2) + sqrt(s_suppkey), 6) AS d, greatest(s_suppkey, s_nationkey) AS e, least(s_suppkey, s_nationkey) AS f, -s_suppkey AS g, s_suppkey % 5 * 2 - 1 AS h FROM supplier",
    "sql_strings": "SELECT n_nationkey, lower(n_name) || '-' || upper(n_name) AS a, concat_ws('/', n_name, 'x') AS b, replace(n_name, 'A', 'b') AS c, substring(n_name, 2, 3) AS d, right(n_name, 2) AS e, position('A' IN n_name) AS f, split_part(concat(n_name, '-z'), '-', 2) AS g, ltrim(concat('  ', n_name)) AS h, btrim(concat(' ', n_name, ' ')) AS i, char_length(n_name) AS j FROM nation",
    "sql_dates": "SELECT o_orderkey, cast(date_part('year', o_orderdate) AS int) AS y, cast(extract(MONTH FROM o_orderdate) AS int) AS m, cast(date_trunc('month', o_orderdate) AS date) AS first FROM orders WHERE o_orderdate >= date '1995-01-01' AND o_orderdate < date '1996-01-01'",
    "sql_predicates": "SELECT c_custkey FROM customer WHERE c_name ILIKE '%9' AND (c_acctbal BETWEEN 100 AND 5000 OR c_mktsegment IN ('BUILDING', 'MACHINERY')) AND c_mktsegment IS NOT NULL AND NOT c_nationkey <= 3 AND c_nationkey IS DISTINCT FROM 9",
    "sql_windows": "SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rn, lag(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS before FROM supplier",
    "sql_frame": "SELECT s_suppkey, count(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM supplier",
    "sql_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus",
    "sql_text": "SELECT c_custkey, upper(trim(c_mktsegment)) AS segment, cast(length(c_name) AS bigint) AS n, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS other FROM customer WHERE c_name LIKE '%7' AND c_acctbal BETWEEN 0 AND 5000",
    "sql_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "sql_scalar_subquery": "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT max(p_retailprice) - 20 FROM part)",
    "sql_arrays": "SELECT o_orderstatus, array_agg(DISTINCT o_orderstatus) AS states, every(o_totalprice > 1500) AS all_large, every(o_totalprice > 0) AS all_paid FROM orders GROUP BY o_orderstatus",
    "sql_casts": "SELECT c_custkey, cast(c_custkey AS string) || ':' || cast(c_nationkey AS string) AS t, cast(c_nationkey AS double) AS d, cast(concat('0', cast(c_nationkey AS string)) AS int) AS i, cast('1995-03-04' AS date) AS day, regexp_replace(c_name, '^[A-Z]+', '') AS rest, rtrim(concat(c_mktsegment, '  ')) AS r, ltrim(concat('  ', c_mktsegment)) AS l FROM customer",
    "sql_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey = n_regionkey",
}
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _shape(sql):
    def run(spark, sf_dir):
        for name in NAMES:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
        guard.check(spark, sql, set(NAMES))
        return spark.sql(sql)

    return run


for _name, _sql in SHAPES.items():  # three functions go by other names there
    QUERIES[_name], ORACLE_SQL[_name] = _shape(_sql), _sql.replace("btrim(", "trim(").replace("every(", "bool_and(").replace("string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name)", "string_agg(n_name, ',' ORDER BY n_name)")


# Statements and whether the guard lets them through.
GUARD_CASES = [
    *((sql, True) for sql in SHAPES.values()),
    ("DROP TABLE orders", False), ("INSERT INTO orders SELECT * FROM orders", False), ("SELECT 1; SELECT 2", False), ("SELECT sleep(1) FROM orders", False),
    ("SELECT * FROM secret", False), ("SELECT o_orderkey / 2 FROM orders", False), ("SELECT * FROM orders LIMIT 5 OFFSET 2", False),
    ("SELECT `reflect`('java.lang.Math','abs',1) FROM nation", False), ("SELECT '\\'' || reflect('java.lang.Math','abs',1) || '\\'' FROM nation", False),
    ("SELECT java_method('java.lang.Math','abs',1) FROM nation", False), ("SELECT default.abs(1) FROM nation", False), ("SELECT n_name FROM nation LIMIT 2 + 3", False),
    ("SELECT n FROM (SELECT n_name AS n FROM nation LIMIT 3) t", False), ("SELECT * FROM range(5)", False), ("SELECT * FROM nation TABLESAMPLE (5 ROWS)", False),
    ("SELECT CAST(o_totalprice AS DECIMAL(12,2)) FROM orders", False), ("SELECT n_name FROM nation WHERE n_name RLIKE 'A'", False), ("SELECT CASE WHEN n_nationkey > 3 THEN 1 ELSE 0 END FROM nation", False),
    ("SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM region)", False), ("SELECT n_nationkey & 1 FROM nation", False), ("SELECT explode(array(1, 2)) FROM nation", False),
    ("SELECT transform(array(1), x -> x) FROM nation", False), ("SELECT /*+ BROADCAST(nation) */ n_name FROM nation", False), ("SELECT n_name FROM spark_catalog.default.nation", False),
    ("SELECT n_name FROM parquet.`/etc`", False), ("SET spark.sql.ansi.enabled = false", False), ("", False),
    ("SELECT n_name -- a remark\nFROM nation", True), ("VALUES (1, 'a'), (2, 'b')", True), ("SELECT n_name FROM nation WHERE n_name ILIKE 'a%' OR n_name NOT IN ('X', 'Y')", True),
    ("SELECT r_name, t.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) t", True), ("SELECT n_name FROM nation WHERE n_name = 'DROP TABLE x; -- '", True),
    ("SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS s FROM orders GROUP BY 1", True), ("SELECT n_name || '!' AS x FROM nation ORDER BY 1 LIMIT 5", True),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(ok).lower()})" for i, (_, ok) in enumerate(GUARD_CASES)) + ") t(nth, accepted)")
def sql_guard(spark, sf_dir):
    rows = []
    for i, (sql, _) in enumerate(GUARD_CASES):
        try:
            guard.check(spark, sql, set(NAMES))
            rows.append((i, True))
        except guard.Rejected:
            rows.append((i, False))
    return spark.createDataFrame(rows, "nth int, accepted boolean")


def _edges(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("src"), (F.col("o_orderkey") * 2 + 1).alias("dst"))
    return o.withColumn("rel", F.col("dst"))


@query("SELECT id, count(*) AS degree FROM (SELECT o_custkey * 2 AS id FROM orders UNION ALL SELECT o_orderkey * 2 + 1 FROM orders) GROUP BY 1 ORDER BY degree DESC, id LIMIT 50")
def degree_topn(spark, sf_dir):
    return graph.degree(_edges(spark, sf_dir), 50)


@query("""WITH s AS (SELECT DISTINCT o_custkey * 4 AS id FROM orders WHERE o_totalprice > 400000),
h AS (SELECT s.id AS seed, o_orderkey AS o FROM s JOIN orders ON o_custkey * 4 = s.id QUALIFY dense_rank() OVER (PARTITION BY s.id ORDER BY o_orderkey) <= 3),
t AS (SELECT seed, l_partkey FROM h JOIN lineitem ON l_orderkey = o QUALIFY dense_rank() OVER (PARTITION BY seed, o ORDER BY l_partkey) <= 3)
SELECT seed, o * 4 + 1 AS node, 1 AS hops FROM h UNION ALL SELECT seed, l_partkey * 4 + 2, 2 FROM t""")
def graph_two_hop(spark, sf_dir):
    """Customers, their orders, the parts of those: three neighbours a step."""
    o, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    edges = o.select((F.col("o_custkey") * 4).alias("src"), (F.col("o_orderkey") * 4 + 1).alias("dst"), (-F.col("o_orderkey")).alias("rel"))
    edges = edges.union(lines.select(F.col("l_orderkey") * 4 + 1, F.col("l_partkey") * 4 + 2, F.col("l_orderkey") * 8 + F.col("l_linenumber")))
    seeds = o.where("o_totalprice > 400000").select((F.col("o_custkey") * 4).alias("id")).distinct()
    return graph.walk(seeds, edges, 2, max_neighbors=3).where("hops > 0").select("seed", "node", "hops")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def graph_orphans(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return graph.orphans(nodes, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))).withColumnRenamed("id", "c_custkey")


@query("""WITH p AS (SELECT p_partkey AS id, lower(p_name) AS label, row_number() OVER (PARTITION BY substr(lower(p_name), 1, 2) ORDER BY lower(p_name), p_partkey) AS at, substr(lower(p_name), 1, 2) AS p FROM part)
SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM p x JOIN p y ON x.p = y.p AND y.at > x.at AND y.at <= x.at + 16""")
def blocking_pairs(spark, sf_dir):
    return graph.prefix_pairs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("label")))


@query("""WITH p AS (SELECT p_partkey AS id, lower(p_name) AS label, row_number() OVER (PARTITION BY substr(lower(p_name), 1, 2) ORDER BY lower(p_name), p_partkey) AS at, substr(lower(p_name), 1, 2) AS p FROM part)
SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM p x JOIN p y ON x.p = y.p AND y.at > x.at AND y.at <= x.at + 16
UNION SELECT x.id, y.id FROM p x JOIN p y ON x.label = y.label AND x.id < y.id WHERE x.label IN (SELECT label FROM p GROUP BY label HAVING count(*) <= 64)
UNION SELECT least, id FROM (SELECT id, min(id) OVER (PARTITION BY label) AS least, count(*) OVER (PARTITION BY label) AS n FROM p) WHERE n > 64 AND id <> least""")
def linking_pairs(spark, sf_dir):
    return graph.blocking_pairs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("label")))


@query("SELECT s_suppkey AS node, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS root FROM supplier QUALIFY count(*) OVER (PARTITION BY s_nationkey) > 1")
def link_components(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return graph.canonical(spark, s.select(F.col("s_suppkey").alias("a"), F.lag("s_suppkey").over(w).alias("b")).where("b IS NOT NULL"))


def _run_and_gold(spark, d):
    ranked = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rank"))
    gold = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"))
    return ranked, gold


@query("""WITH r AS (SELECT o_custkey AS query_id, o_orderpriority = '1-URGENT' AS good, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT query_id, round(1.0::DOUBLE / min(rank), 6) AS mrr, CAST(min(rank) <= 3 AS INTEGER) AS hit_3, round(sum(CASE WHEN rank <= 3 THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS recall_3 FROM r WHERE good GROUP BY 1""")
def retrieval_metrics(spark, sf_dir):
    return metrics.ranking_metrics(*_run_and_gold(spark, sf_dir)).select("query_id", "mrr", "hit_3", "recall_3")


@query("SELECT lang, count(n_chars) AS n, round(quantile_cont(n_chars, 0.5), 3) AS median, round(quantile_cont(n_chars, 0.95), 3) AS p95 FROM documents GROUP BY 1")
def percentile_linear(spark, sf_dir):
    return metrics.distribution(table(spark, sf_dir, "documents"), "n_chars", ["lang"]).select("lang", "n", "median", "p95")


@query("""WITH p AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL)
SELECT lang, max(CASE WHEN pos = round_even((n - 1) * 0.5::DOUBLE, 0) THEN n_chars END) AS p50, max(CASE WHEN pos = round_even((n - 1) * 0.95::DOUBLE, 0) THEN n_chars END) AS p95 FROM p GROUP BY 1""")
def percentile_nearest(spark, sf_dir):
    return metrics.nearest_rank(table(spark, sf_dir, "documents"), "n_chars", ["lang"], {"p50": 0.5, "p95": 0.95})


@query("""WITH d AS (SELECT DISTINCT doc_id FROM documents), l AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)
SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'stale' ELSE 'matching' END AS state, count(*) AS n FROM d FULL OUTER JOIN l ON d.doc_id = l.doc_id GROUP BY 1""")
def scope_audit(spark, sf_dir):
    return metrics.audit(table(spark, sf_dir, "documents").select("doc_id").distinct(), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", F.lit(True))


@query("SELECT count(*) FILTER (n_regionkey = 1) AS only_a, count(*) FILTER (n_regionkey = 0) AS only_b FROM nation")
def result_equivalence(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return metrics.same_bag(n.where("n_regionkey != 0"), n.where("n_regionkey != 1"))


@query("""SELECT time_bucket(INTERVAL '5 minutes', ts) AS bucket, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2""")
def tumbling_events(spark, sf_dir):
    return ingest.tumbling(table(spark, sf_dir, "events"), 5)


@query("SELECT event_id, user_id, event_type FROM events")
def ingest_available_now(spark, sf_dir):
    return ingest.ingest_available(spark, sf_dir, table(spark, sf_dir, "events").schema, "event_id", "events.parquet").select("event_id", "user_id", "event_type")


def _blocks(spark, d):
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return lines.withColumn("type", F.when((F.char_length("text") <= 40) & ~F.col("text").endswith("."), "title").otherwise("text"))


@query("""WITH b AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
t AS (SELECT *, CAST(length(text) <= 40 AND NOT text LIKE '%.' AS INTEGER) AS title FROM b),
s AS (SELECT *, CASE WHEN title = 1 AND coalesce(lag(title) OVER (PARTITION BY document_id ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS st FROM t)
SELECT document_id, CAST(pos AS INTEGER) AS at, CAST(sum(st) OVER (PARTITION BY document_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM s""")
def sectionize(spark, sf_dir):
    return chunking.sectionize(_blocks(spark, sf_dir)).select("document_id", "at", "section")


@query()
def html_cells(spark, sf_dir):
    return html_tables.cells(table(spark, sf_dir, "pages"), "page_id", "html")


@query("""SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS chars_after FROM conversations""")
def history_window(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id")
    return c.select("conv_id", "turn", F.count("*").over(w).alias("n"), F.coalesce(F.sum(F.char_length("text")).over(w.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("chars_after"))


def _stripped_sql(c: str) -> str:
    """questions.stripped in DuckDB's words, from the same fixed values."""
    edge = lambda x: f"regexp_replace({x}, '^[{Q.PARTICLES}]+|[{Q.PARTICLES}]+$', '', 'g')"
    plain = edge(f"regexp_replace(trim(lower(coalesce({c}, '')), ' '), '{Q.LEADING}', '')")
    short = edge(f"regexp_replace({plain}, '{Q.TRAILING}', '')")
    return f"coalesce(nullif({short}, ''), {plain})"


def _holds(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query(f"""WITH s AS (SELECT conv_id, turn, {_stripped_sql('text')} AS q, row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS later FROM conversations)
SELECT conv_id, turn, later AND q <> '' AND (length(q) <= 8 OR {_holds('q', Q.FOLLOW_UP)}) AS follow_up,
CASE WHEN q <> '' AND NOT regexp_matches(q, '[{Q.SEPARATORS}]') AND NOT {_holds('q', Q.COMPLEX)} AND (length(q) <= 24 OR (length(q) <= 40 AND {_holds('q', Q.FACT)})) THEN 'dense' ELSE 'unified' END AS route FROM s""")
def route_queries(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    has = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")).isNotNull()
    return c.select("conv_id", "turn", Q.follows_up(F.col("text"), has).alias("follow_up"), Q.route(F.col("text")).alias("route"))


# Each of these registers its queries here.
from tidemark.plans import analysis as _analysis, chunks as _chunks, evidence as _evidence, files as _files, graphs as _graphs, grounding as _grounding, links as _links, needs as _needs  # noqa: E402, F401
from tidemark.plans import outputs as _outputs, searches as _searches, similar as _similar, splits as _splits, store as _store, streams as _streams, versions as _versions  # noqa: E402, F401
