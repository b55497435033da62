"""Runs of repeated words against a search of every period."""

import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import queries, runs
from tidemark.llm.common import table


def brute(words, least_length=6, least_exponent=4):
    """(start, length, period) by trying every period."""
    found = {}
    for q in range(1, len(words) // least_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least_length, least_exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


@pytest.mark.parametrize("least_length,least_exponent", [(6, 4), (2, 2), (5, 3)])
def test_runs_of_small_alphabets(least_length, least_exponent):
    rng = random.Random(least_length)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.randint(0, 70), rng.choice([1, 2, 3, 6])
            words = [b"%d" % rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.6:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            docs.append(words)
        assert runs.runs_of(docs, least_length, least_exponent) == [brute(d, least_length, least_exponent) for d in docs]


def test_long_runs_are_linear():
    assert runs.runs_of([[b"a"] * 100_000, [b"a", b"b"] * 30_000 + [b"c"]]) == [[(0, 100_000, 1)], [(0, 60_000, 2)]]


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    keep = [True] * n
    for s, length, q in found:
        keep[s + q : s + length] = [False] * (length - q)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None, sha(lines), sha(" ".join(w for w, k in zip(words, keep) if k)))


def test_query_against_every_period(spark, sf):
    got = sorted(tuple(r) for r in queries.op13_runs(spark, sf).collect())
    want = sorted(expected(r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    assert got == want
    assert any(r[1] for r in got) and any(not r[1] for r in got)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b " * 9), (5, "x y z " * 5000), (5, "x y z " * 5000), (7, " é " * 6), (8, "a " * 5), (9, "a " * 6), (10, "\x1c\x1d \x1c\x1d\x85 " * 8)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, runs int, collapsed int").repartition(3)
    found = runs.find_runs(spark, docs)
    assert found.columns == ["doc_id", "text", "runs", "collapsed"]
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in runs.report(runs.find_runs(spark, docs.withColumn("text", runs.planted(docs.doc_id, docs.text)))).collect()), key=key)
    assert got == sorted((expected(*r) for r in rows), key=key)
    assert runs.report(runs.find_runs(spark, docs.limit(0))).count() == 0
