"""Linking candidates against plain loops over blocks."""

import difflib
import random
from itertools import combinations

import pytest

from tidemark.operators import graph, linking


def plain(rows, max_block, max_pairs, window, prefix):
    """(kb, a, b) -> signals, block by block in order."""
    label = lambda t: " ".join((t or "").casefold().split())
    own = {i: (kb, doc, label(name), sorted({label(x) for x in aliases or [] if label(x)}), label(kind)) for i, kb, doc, name, aliases, kind in rows}
    out, skipped = {}, 0
    for kb in {v[0] for v in own.values()}:
        blocks = {}
        for i, (k, _, name, aliases, _) in own.items():
            if k == kb:
                for t in {name, *aliases} - {""}:
                    blocks.setdefault(("exact", t), set()).add(i)
                if prefix and len(name) >= 2:
                    blocks.setdefault(("prefix", name[:2]), set()).add(i)
        found = []
        for (kind, _), ids in sorted(blocks.items()):
            ids = sorted(ids)
            if len(ids) > max_block:
                skipped += len(ids) * (len(ids) - 1) // 2
                continue
            for x, y in combinations(range(len(ids)), 2):
                a, b = ids[x], ids[y]
                ratio = round(difflib.SequenceMatcher(None, own[a][2], own[b][2]).ratio(), 6)
                if kind == "prefix" and (y - x > window or ratio < 0.72):
                    continue
                if (a, b) not in found and len(found) < max_pairs:
                    found.append((a, b))
                    terms = [sorted(({own[i][2], *own[i][3]} - {""})) for i in (a, b)]
                    out[kb, a, b] = (own[a][2] == own[b][2], sorted({*terms[0]} & {*terms[1]}), sorted({*own[a][3]} & {*own[b][3]}), own[a][4] == own[b][4], ratio, own[a][1] == own[b][1])
    return out, skipped


@pytest.mark.parametrize("max_block,max_pairs,window,prefix", [(64, 200, 16, True), (6, 30, 2, True), (5, 12, 3, False)])
def test_candidates_of_all_blocks(spark, max_block, max_pairs, window, prefix):
    rng = random.Random(max_block)
    names = ["Red river", "red rivers", "RED  river ", "Blue hill", "blue hills", "x", "数据库", "数据库表", "Red rover"]
    rows = [(i, i % 3, rng.choice([1, 2, None]), rng.choice(names), rng.choice([None, [], [" "], [rng.choice(names), None], ["Alias %d" % rng.randrange(6), rng.choice(names)]]), rng.choice(["A", "a ", "b"])) for i in range(70)]
    df = spark.createDataFrame(rows, "id long, kb long, doc long, name string, aliases array<string>, type string").repartition(3)
    entities = linking.labelled(spark, df)
    got = {(r.kb, r.a, r.b): tuple(r)[3:] for r in linking.candidates(spark, entities, max_block, max_pairs, window, prefix).collect()}
    want, skipped = plain(rows, max_block, max_pairs, window, prefix)
    assert got == want and want
    assert linking.block_sizes(entities, max_block, prefix).groupBy().sum("skipped_pairs").first()[0] == skipped


def test_pairs_of_common_labels_stay_few(spark):
    rows = [(i, "same") for i in range(70)] + [(100 + i, "few") for i in range(4)] + [(200, None), (201, "sand")]
    df = spark.createDataFrame(rows, "id long, label string").repartition(4)
    got = {tuple(r) for r in graph.blocking_pairs(df, window=1).collect()}
    ordered = [i for i, t in sorted(((i, t) for i, t in rows if t and t.startswith("sa")), key=lambda r: (r[1], r[0]))]
    chain = {tuple(sorted(p)) for p in zip(ordered, ordered[1:])} | {(100, 101), (101, 102), (102, 103)}
    assert got == chain | {(0, i) for i in range(1, 70)} | set(combinations(range(100, 104), 2))
    assert {tuple(r) for r in graph.label_classes(df).collect()} == {("same", 70, 0), ("few", 4, 100), ("sand", 1, 201)}
