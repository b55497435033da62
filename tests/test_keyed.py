"""Keyed tables: what is rewritten, what readers see, what is refused."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources.keyed import POINTS, KeyedTable
from tidemark.sources.sinks import CommitError

SCHEMA = "k long, part string, v string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def held(spark, tmp_path):
    df = spark.createDataFrame([(None, "a", "null key"), *[(i % 20, f"p{i}", f"v{i}") for i in range(60)]], SCHEMA)
    t = KeyedTable(spark, f"file://{tmp_path}/t", df.schema, "k", 8)
    t.create(df)
    return t, df


def test_only_touched_buckets_are_rewritten(spark, held):
    t, df = held
    first = t.version()
    assert rows_of(t.read()) == rows_of(df)
    fresh = spark.createDataFrame([(3, "p3", "new"), (None, "b", "other")], SCHEMA)
    second = t.replace(fresh)
    touched = {str(r[0]) for r in fresh.select(t._bucket("k")).distinct().collect()}
    was, now = t.manifest(first), t.manifest(second)
    assert {b for b in now if now[b] != was[b]} == touched and len(touched) == 2
    assert rows_of(t.read()) == rows_of(df.where("k <> 3").unionByName(fresh))
    t.delete(spark.createDataFrame([(3,), (999,)], "k long"))
    assert t.read().where("k = 3").count() == 0 and t.read().where("k IS NULL").count() == 1
    t.restore(first)
    assert rows_of(t.read()) == rows_of(df)
    assert t.prune() == 2 and rows_of(t.read()) == rows_of(df)
    with pytest.raises(CommitError):
        t.restore(second)


@pytest.mark.parametrize("point", POINTS)
def test_a_lost_change_is_seen_whole_or_not_at_all(spark, held, point):
    t, df = held

    def passed(name):
        if name == point:
            raise RuntimeError(name)

    t.passed = passed
    fresh = df.where("k < 5").withColumn("v", F.lit("new"))
    with pytest.raises(RuntimeError):
        t.replace(fresh)
    want = rows_of(df.where("k IS NULL OR k >= 5").unionByName(fresh)) if point == "pointer" else rows_of(df)
    assert rows_of(t.read()) == want
    t.passed = lambda _: None
    with pytest.raises(CommitError):  # two changes at a time are refused
        t.replace(fresh)
    assert t.recover() == ("kept" if point == "pointer" else "dropped") and t.recover() is None
    assert rows_of(t.read()) == want
    t.replace(fresh)
    assert rows_of(t.read()) == rows_of(df.where("k IS NULL OR k >= 5").unionByName(fresh))


def test_visibility_of_a_scope_is_restored(spark, held):
    t, df = held
    before, scope = t.version(), spark.createDataFrame([(1,), (2,)], "k long")
    t.update(scope, v=F.lit("hidden"), part=F.concat("part", F.lit("!")))
    assert t.read().where("v = 'hidden'").count() == 6
    with pytest.raises(CommitError):  # rows are told by part, which was changed
        t.restore_columns(before, scope, "part", "v")
    t.update(scope, part=F.regexp_replace("part", "!", ""))
    t.restore_columns(before, scope, "part", "v")
    assert rows_of(t.read()) == rows_of(df)


def test_empty_tables_and_strays(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    t = KeyedTable(spark, f"file://{tmp_path}/e", none.schema, "k", 4)
    assert t.version() is None and t.read().count() == 0
    t.create(none)
    assert t.read().count() == 0 and t.recover() is None
    t.replace(spark.createDataFrame([(1, "a", "x")], SCHEMA))
    with pytest.raises(CommitError):  # a change may not put rows into buckets it did not touch
        t._change([], lambda old: spark.createDataFrame([(5, "a", "x")], SCHEMA))
    assert t.recover() == "dropped" and rows_of(t.read()) == [(1, "a", "x")]
