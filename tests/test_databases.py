"""File databases: round trip, filters run by the database, read-only, time limit."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from tidemark.sources import databases as D

ROWS = [(1, "a'b", 1.5, b"x"), (2, None, None, None), (None, "é 数", -2.0, b""), (4, "abc", 0.0, None)]


@pytest.fixture
def held(spark, tmp_path):
    D.register(spark)
    D.write(spark.createDataFrame(ROWS, 'k long, `t"x` string, v double, b binary').repartition(3), f"file://{tmp_path}/db", 'ta"b')
    return lambda **o: spark.read.format("file_database").options(path=f"file://{tmp_path}/db", table='ta"b', **o).load()


def test_round_trip_and_filters(held):
    df = held()
    assert df.dtypes == [("k", "bigint"), ('t"x', "string"), ("v", "double"), ("b", "binary")]
    key = lambda r: str(r[0])
    assert sorted(((r[0], r[1], r[2], None if r[3] is None else bytes(r[3])) for r in df.collect()), key=key) == sorted(ROWS, key=key)
    assert sorted(key(r) for r in held(rows=1).collect()) == sorted(key(r) for r in ROWS)
    for cond, want in (("k = 4", [4]), ("k > 1", [2, 4]), ("k IN (1, 9)", [1]), ("v IS NULL", [2]), ("`t\"x` LIKE 'ab%'", [4]), ("v <= 0 AND k IS NOT NULL", [4]), ("k % 2 = 0", [2, 4]), ("`t\"x` = 'a''b'", [1])):
        assert sorted(r.k for r in df.where(cond).collect()) == want, cond
    plan = df.where("k > 1 AND k % 2 = 0")._jdf.queryExecution().executedPlan().toString()
    assert "% 2" in plan and "> 1" not in plan  # Spark filters what the database was not given


def test_what_the_database_decides():
    from pyspark.sql.datasource import EqualTo, In, StringContains

    assert D.condition(EqualTo(("a",), 5)) == ('"a" = ?', [5]) and D.condition(EqualTo(("a", "b"), 5)) is None
    assert D.condition(In(("a",), (1, 2))) == ('"a" IN (?, ?)', [1, 2]) and D.condition(StringContains(("a",), "x")) is None
    assert D.condition(EqualTo(("a",), float("nan"))) is None


def test_read_only_and_limited(held, tmp_path):
    uri = D.files(f"file://{tmp_path}/db")[0]
    with D.opened(uri) as con, pytest.raises(sqlite3.OperationalError):
        con.execute("CREATE TABLE x (a)")
    with D.opened(uri, 0.05) as con, pytest.raises(sqlite3.OperationalError, match="interrupted"):
        con.execute("WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n) SELECT count(*) FROM n").fetchone()
    assert held().where(F.col("k") == 77).count() == 0
    with pytest.raises(Exception, match="no table"):
        D.FileDatabase({"path": f"file://{tmp_path}/db", "table": "nothing"}).schema()
