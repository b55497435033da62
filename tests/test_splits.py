"""Splits against every choice."""

import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from tidemark.operators import requirements as R, splits


def test_choices_of_kinds_against_all():
    rng = random.Random(5)
    hits = 0
    for _ in range(300):
        kinds = [(tuple(rng.randint(0, 2) for _ in range(2)), rng.randint(1, 3)) for _ in range(rng.randint(1, 4))]
        kinds = [(v, n) for v, n in kinds if any(v)]
        quotas = (rng.randint(0, 5), rng.randint(0, 5))
        sums = lambda ns: tuple(sum(n * v[s] for n, (v, _) in zip(ns, kinds)) for s in range(2))  # noqa: E731, B023
        possible = any(sums(ns) == quotas for ns in product(*[range(n + 1) for _, n in kinds]))
        got = splits.choose(kinds, quotas)
        assert (got is not None) == possible
        if got is not None:
            hits += 1
            assert sums(got) == quotas and all(0 <= x <= n for x, (_, n) in zip(got, kinds))
    assert hits > 50


def test_whole_groups_meet_quotas(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice([i, rng.randint(0, 30)])) for i in range(120)] + [(900, None, 700), (901, "a", 700)]
    df = spark.createDataFrame(rows, "item long, subject string, group long").repartition(3)
    got = splits.quota_split(spark, df, {"a": 20, "b": 17}).collect()
    assert sorted((r.item, r.subject, r.group) for r in got) == sorted(rows)
    dev = [r for r in got if r.split == "dev"]
    assert (sum(r.subject == "a" for r in dev), sum(r.subject == "b" for r in dev)) == (20, 17)
    assert not {r.group for r in dev} & {r.group for r in got if r.split == "test"} and 700 not in {r.group for r in dev}
    with pytest.raises(splits.SplitError):
        splits.quota_split(spark, df.where("group = 700"), {"a": 1})


def test_documents_apart_against_all_choices(spark):
    rng, dev = random.Random(9), 4
    rows = [(k * 100 + i, f"s{k}" if k else None, rng.choice([None, *"abcd"]) if k % 3 else "abcd"[i // 3]) for k in range(25) for i in range(rng.randint(3, 10))]
    got = {r.item: (r.split, r.apart) for r in splits.document_split(spark, spark.createDataFrame(rows, "item long, subject string, document string").repartition(3), dev).collect()}
    want = {}
    for subject in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == subject), key=lambda r: (r[2] is not None, r[2] or "", r[0]))
        for chosen in combinations(range(len(own)), dev):
            if not {own[i][2] for i in chosen} & {own[i][2] for i in range(len(own)) if i not in chosen}:
                want |= {r[0]: ("dev" if i in chosen else "test", True) for i, r in enumerate(own)}
                break
        else:
            want |= {r[0]: ("dev" if i < dev else "test", False) for i, r in enumerate(own)}
    assert got == want and {a for _, a in got.values()} == {True, False}


def test_requirements_of_questions(spark):
    asked = spark.createDataFrame([(1, " 2020至2023年中国与美国的人均GDP对比 "), (2, "请解释受教育程度与收入的关系"), (3, "图片中的泰国数据"), (4, None), (5, "2023-2019 年趋势图")], "query_id long, question string")
    got = {r.query_id: r for r in R.requirements(asked).collect()}
    assert (got[1].objects, got[1].years, got[1].first_year, got[1].last_year, got[1].metrics, got[1].comparison, got[1].needs_table) == (["中国", "美国"], [2020, 2023], 2020, 2023, ["GDP", "人均GDP"], True, True)
    assert got[2].relation_terms == ["受教育程度"] and got[2].metrics == ["收入"]
    assert got[3].scanned_table and got[3].needs_feature and not got[4].needs_image and got[5].first_year is None and got[5].needs_feature
    found = spark.createDataFrame([(1, 1, "2020 年中国人均GDP 1 万元", None, "table", True), (1, 2, "2023 美国人均 gdp 亿美元", ["美国"], "table", True), (3, 1, None, None, "image", True)], "query_id long, at int, text string, rows array<string>, modality string, tool boolean")
    told = {r.query_id: (r.satisfied, r.missing, r.bound) for r in R.assess(R.requirements(asked), found).collect()}
    assert told[1] == (False, ["units"], [1, 2]) and told[4] == (True, [], []) and told[2][1] == ["nothing"]
    assert told[3] == (False, ["object:泰国"], [])
