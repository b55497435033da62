"""The engine's own operators on small fixtures, and every query against nothing but its schema and SQL."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import chunking, graph, metrics, retrieval, tables
from tidemark.plans import catalog, guard
from tidemark.sources import html_tables


def test_tokenize_cjk_and_inner_marks():
    assert text.tokenize("Ab-C_d 图表a.b。") == ["ab-c_d", "图", "表", "图表", "a.b"]
    assert text.tokenize(None) == []


def test_numbers(spark):
    rows = [("1,234.5", "1234.5"), ("(12)", "-12"), ("−3%", "-3"), ("n/a", None), ("", None), (None, None), ("x1", None)]
    got = spark.createDataFrame(rows, "t string, want string").select("want", text.number(F.col("t")).alias("v")).collect()
    assert [None if r.v is None else Decimal(r.v).normalize() for r in got] == [None if r.want is None else Decimal(r.want).normalize() for r in got]


def test_bm25_orders_and_matches(spark):
    docs = spark.createDataFrame([(1, "red fish"), (2, "red red dog"), (3, "blue cat"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "Red fish")], "query_id long, text string")
    got = [(r.doc_id, r["rank"], r.matched) for r in retrieval.bm25(docs, q, 5).orderBy("rank").collect()]
    assert got[0] == (1, 1, "fish red") and got[1][0] == 2 and len(got) == 2


def test_rrf_pool_and_quota(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, doc_id long, rank int")
    assert [r.doc_id for r in retrieval.rrf([a, b], 3).orderBy("rank").collect()] == [11, 10, 12]
    assert [r.doc_id for r in retrieval.fair_pool([a, b], 3).orderBy("rank").collect()] == [10, 11, 12]
    many = spark.createDataFrame([(1, i, i + 1) for i in range(10)], "query_id long, doc_id long, rank int")
    got = [r.doc_id for r in retrieval.quota(many, F.col("doc_id") >= 8, 4, 2).orderBy("rank").collect()]
    assert got == [0, 1, 8, 9]


def test_context_skips_what_does_not_fit(spark):
    hits = spark.createDataFrame([(1, 1, 5, 60), (1, 2, 6, 50), (1, 3, 7, 40)], "query_id long, rank int, doc_id long, size long")
    assert [(r.marker, r.doc_id) for r in retrieval.pack_context(hits, 100).orderBy("marker").collect()] == [("C1", 5), ("C2", 7)]


def test_table_operations(spark):
    df = spark.createDataFrame([(0, "a", Decimal("2")), (1, " a", None), (2, "", Decimal("1")), (3, "b", Decimal("2"))], "row long, k string, v decimal(18,6)")
    assert tables.filter_number(df, "v", "ne", Decimal(2)).count() == 1
    assert [r.row for r in tables.sort(df, "v", True).collect()] == [0, 3, 2, 1]
    assert [(r.k, r["sum"]) for r in tables.aggregate(df, "v", ["sum"], "k").collect()] == [("a", 2), (None, 1), ("b", 2)]
    with pytest.raises(tables.TableError):
        tables.compare(df.withColumn("k", F.lit("x")), df, "k", "v")
    zero = df.withColumn("v", F.lit(Decimal(0)).cast("decimal(18,6)")).where("row != 1")
    assert {r.relative for r in tables.compare(df, zero, "k", "v").collect()} == {None}
    assert [r.row for r in tables.select(df, ["k"], [3, 0, 3]).orderBy("request").collect()] == [3, 0, 3]


def test_graph_walk_has_no_vertex_twice(spark):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 2), (3, 1, 3)], "src long, dst long, rel long")
    got = graph.walk(spark.createDataFrame([(1,)], "id long"), edges).collect()
    assert all(len(set(r.path)) == len(r.path) for r in got) and {r.node for r in got} == {1, 2, 3}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in graph.canonical(spark, links).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100


def test_metrics_close_up_repeats(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3)], "query_id long, doc_id long, rank int")
    r = metrics.ranking_metrics(ranked, spark.createDataFrame([(1, 6), (2, 9)], "query_id long, doc_id long")).orderBy("query_id").collect()
    assert (r[0].mrr, r[0].hit_1, r[0].hit_3, r[1].mrr) == (0.5, 0, 1, 0.0)


def test_chunks_cover_blocks_and_stay_in_sections(spark):
    rows = [(1, i, "title" if i % 5 == 0 else "text", ("Head %d" % i) if i % 5 == 0 else "word. " * 90) for i in range(15)]
    blocks = spark.createDataFrame(rows, "document_id long, at int, type string, text string")
    chunks = chunking.chunk(blocks)
    assert chunking.uncovered(blocks, chunks).count() == 0
    assert chunks.agg(F.max("n_chars")).first()[0] <= chunking.MOST
    assert max(map(len, chunking.split_text("x" * 5000))) == chunking.MOST


def test_html_spans_and_markdown():
    cells = html_tables.html_cells("<table><tr><th>a</th><th>b</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr></table>")
    assert [(c["row"], c["col"], c["text"]) for c in cells if c["derived"]] == [(2, 0, "1")]
    assert [c["text"] for c in html_tables.markdown_cells("x\n| a | b |\n|---|---|\n| 1 | 2 |\nend")] == ["a", "b", "1", "2"]
    assert html_tables.html_cells(None) == [] and html_tables.markdown_cells("no | table") == []


@pytest.mark.parametrize("sql", ["DROP TABLE nation", "SELECT 1; SELECT 2", "SELECT sleep(1) FROM nation", "SELECT * FROM other", "SELECT n_nationkey / 2 FROM nation", "SELECT * FROM nation OFFSET 2", "SELECT CAST(1 AS DECIMAL(10,2)) FROM nation", "not sql"])
def test_guard_rejects(spark, sql):
    with pytest.raises(guard.Rejected):
        guard.check(spark, sql, {"nation"})


def test_guard_bounds(spark):
    out = guard.bounded(spark.range(5), 3)
    assert (out.truncated, out.reason, len(out.rows)) == (True, "row_limit", 3)
    assert guard.bounded(spark.range(3), 3).truncated is False


@pytest.mark.parametrize("name", ["bm25_topk", "table_compare", "sql_windows", "sectionize", "percentile_nearest", "ingest_available_now"])
def test_queries_run(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() >= 0


def test_equal_labels_meet_beyond_the_window(spark):
    labels = {i: "ab same" if i % 3 else f"ab other {i % 2}" for i in range(60)} | {90: None, 91: None}
    got = [tuple(r) for r in graph.blocking_pairs(spark.createDataFrame(list(labels.items()), "id long, label string"), window=2).collect()]
    want = {(x, y) for x in labels for y in labels if x < y and labels[x] is not None and labels[x] == labels[y]}
    assert len(got) == len(set(got)) and want <= set(got) and len(set(got) - want) <= 2 * 60
