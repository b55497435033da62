"""What plans must not hold, as it grows faster than their input."""

from pyspark.sql import functions as F

from tidemark.operators import evaluation, graph_retrieval, grounding, similarity


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_merged_entities_are_not_expanded(spark):
    rows = spark.createDataFrame([(1, "a", "t", "x", 1), (1, "b", "t", "y", 2), (2, "c", "t", None, 1), (3, "d", "t", "x", 1), (3, "d", "u", "x", 3), (4, None, None, "z", 1), (5, None, "t", "z", 1), (5, "e", "t", "z", 1)], "id int, name string, type string, alias string, document int")
    found = graph_retrieval.merge_entities(rows)
    assert {r.id: r.conflict for r in found.collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert "Expand" not in _plan(found)


def test_leakage_groups_broadcast_nothing(spark):
    items, signatures = spark.range(50).withColumnRenamed("id", "item"), spark.createDataFrame([(i, i // 3) for i in range(0, 30, 2)], "item long, signature long")
    found = evaluation.leakage_groups(spark, items, signatures)
    assert {r.item: r.group for r in found.collect()} == {i: {2: 0, 8: 6, 14: 12, 20: 18, 26: 24}.get(i, i) for i in range(50)}
    assert "Broadcast" not in _plan(found)


def test_grounding_runs_little_python_at_a_time(spark):
    entities = spark.createDataFrame([(1, "Ann", "A", ["AN"]), (1, "Bo", "A", None), (2, " ", "A", [])], "chunk int, name string, kind string, aliases array<string>")
    chunks = spark.createDataFrame([(1, "An and  BO"), (2, "x")], "chunk int, text string")
    found = grounding.grounded_entities(spark, entities, chunks)
    assert {r.key: (r.aliases, r.reason) for r in found.collect()} == {"ann": (["an"], None), "bo": ([], None)}
    assert _plan(found).split("Initial Plan")[0].count("ArrowEvalPython") <= 2  # each is a process in every task
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024


def test_copies_do_not_meet_by_text(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, None)], "k long, v string")
    _, rows = similarity.classes(df, "k", "v")
    joins = [line for line in _plan(rows).splitlines() if "Join [" in line]
    assert joins and not any("[v#" in line for line in joins)


def test_unified_retrieval_writes_no_matched_terms(spark, sf, monkeypatch):
    from tidemark.plans import searches

    kept, real = {}, searches.written
    monkeypatch.setattr(searches, "written", lambda spark, df, what: kept.setdefault(what, df.columns) and real(spark, df, what))
    searches.unified_retrieval(spark, sf)
    assert kept["sparse"] == ["query_id", "rank", "doc_id", "score"]


def test_two_blocks_of_co_members_meet_from_one_side_each(spark):
    members = spark.createDataFrame([(None if i == 7 else i, i % 2) for i in range(60)], "id long, canonical long")
    found = graph_retrieval.co_members(members, 4)
    want = {(i, j, i % 2) for j in range(60) for i in range(j) if i % 2 == j % 2 and 7 not in (i, j)}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "sequence(0, (n" not in _plan(found)  # all blocks on both sides


def test_like_sets_are_not_sent_with_each_of_their_pairs(spark):
    sets = spark.range(100).select("id", F.transform(F.sequence(F.col("id"), F.col("id") + 2000), lambda t: t.cast("string")).alias("tokens"))
    told = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = told()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as tables at size are
    try:
        found = {(r.a, r.b): r.similarity for r in similarity.jaccard_join(spark, sets, 0.9).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert found == {(a, b): (2001 - b + a) / (2001 + b - a) for a in range(100) for b in range(a + 1, 100)}
    assert told() - before < 16 << 20  # a set has 16 kB, the pairs 79 MB of them
