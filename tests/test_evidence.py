"""Evidence operators on small fixtures: ties, nulls, empty tables."""

from pyspark.sql import functions as F

from tidemark.operators import evidence


def test_best_hit_speaks_for_its_evidence(spark):
    hits = spark.createDataFrame([(1, 5, 9, 0.5), (1, 5, 8, 0.5), (1, 6, 7, 0.9), (1, None, 1, 1.0)], "query_id long, evidence_id long, point_id long, score double")
    got = [(r["rank"], r.evidence_id, r.point_id, r.hits) for r in evidence.group_hits(hits, 2).orderBy("rank").collect()]
    assert got == [(1, 6, 7, 1), (2, 5, 8, 2)]
    assert evidence.group_hits(hits.limit(0), 2).count() == 0


def test_context_and_titles(spark):
    rows = [(1, 0, "title", "A"), (1, 1, "text", "xyz"), (1, 2, "title", "B"), (1, 3, "text", None), (2, 0, "text", "q")]
    blocks = spark.createDataFrame(rows, "document_id long, at int, type string, text string")
    got = {(r.document_id, r["at"]): r for r in evidence.context(blocks, "document_id", "at", "text", 2).collect()}
    assert (got[1, 2].before, got[1, 0].before, got[1, 0].after, got[1, 2].after) == ("yz", None, "xy", None)
    paths = {(r.document_id, r["at"]): r.path for r in evidence.title_path(blocks, 1).collect()}
    assert paths == {(1, 0): "A", (1, 1): "A", (1, 2): "B", (1, 3): "B", (2, 0): None}
    assert {r.path for r in evidence.title_path(blocks).where("at = 3").collect()} == {"A > B"}


def test_neighbours_take_turns(spark):
    edges = spark.createDataFrame([(1, 2, 1), (1, 2, 2), (1, 3, 3)], "node long, neighbour long, edge long")
    assert [r.edge for r in evidence.neighbour_turns(edges, 3).orderBy("turn").collect()] == [1, 3, 2]


def test_attribution_and_recovery(spark):
    points = spark.createDataFrame([(1, 7), (2, None), (3, 7), (4, 7), (5, 7)], "k long, c long")
    owners = spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 7), (4, 8)], "k long, o long")
    got = {r.k: r.state for r in evidence.attribute(points, owners, "k", "c", "o").collect()}
    assert got == {1: "correct", 2: "null", 3: "conflict", 4: "ambiguous", 5: "unknown"}
    hits = spark.createDataFrame([(1, 1, "dense"), (1, 2, "dense"), (1, 2, "sparse")], "query_id long, doc_id long, branch string")
    gold = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, doc_id long")
    assert {r.doc_id: r.found_by for r in evidence.recovery(hits, gold, ["dense", "sparse"]).collect()} == {1: "dense", 2: "multiple", 3: "none"}


def test_cost_terms_and_classes(spark):
    rows = [(1000, 500, "cat x"), (None, 1, "concat"), (0, 0, None)]
    df = spark.createDataFrame(rows, "a long, b long, t string")
    got = df.select(evidence.cost(F.col("a"), F.col("b"), F.lit("0.5"), F.lit("2")).cast("double").alias("c")).collect()
    assert [r.c for r in got] == [1.5, None, 0.0]
    assert [r.subject for r in evidence.classify(df, "t", {"pets": "cat", "letters": "x"}).collect()] == ["ambiguous", "unclassified", "unclassified"]


def test_candidates_keep_the_first(spark):
    first = spark.createDataFrame([(1, 5, 1)], "query_id long, doc_id long, rank int")
    more = spark.createDataFrame([(1, 4, 1), (1, 5, 2), (1, 6, 3)], "query_id long, doc_id long, rank int")
    assert [(r.marker, r.doc_id) for r in evidence.merge_candidates(first, more, 2).orderBy("rank").collect()] == [("C1", 5), ("C2", 4)]
