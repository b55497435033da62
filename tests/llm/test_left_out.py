"""Candidates of the prefix filter."""

import random

from pyspark.sql import functions as F

from tidemark.llm import simhash


def test_texts_with_a_passage_in_common_are_no_candidates(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(200), n):
            out[at] = f"new{rng.randrange(10**9)}"
        return out

    every = [edited(base, 5) for _ in range(80)]  # of similarity 0.6
    every += [edited(w, 2) for w in every[:10]]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(every)], "doc_id long, text string")
    nodes = simhash.fingerprints(spark, df, 5, 1, sets=True).cache()
    roots = nodes.select("node", "size", F.col("node").alias("root"), *simhash.PARITIES)
    id_of = {r.node: r.doc_id for r in nodes.collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(196)} for w in every]
    want = {(i, j) for j in range(90) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    found = {tuple(sorted((id_of[r.a], id_of[r.b]))) for r in simhash.left_out(spark, df, roots, 5, 0.8).collect()}
    assert want <= found and len(want) >= 10 and len(found) <= 3 * len(want)  # of 4,005 pairs


def test_long_texts_with_much_in_common_are_no_candidates(spark):
    rng = random.Random(13)
    base, other = ([f"{c}{rng.randrange(10**6)}" for _ in range(3000)] for c in "vw")

    def edited(words, n):
        out = list(words)
        for at in rng.sample(range(len(words)), n):
            out[at] = f"new{rng.randrange(10**9)}"
        return out

    every = [edited(base, 75) for _ in range(30)]  # of similarity 0.6
    every += [edited(w, 20) for w in every[:4]] + [other[:2200], other[:2000], other[100:2040]]  # the last ones have bits of two widths
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(every)], "doc_id long, text string")
    nodes = simhash.fingerprints(spark, df, 5, 1, sets=True).cache()
    roots = nodes.select("node", "size", F.col("node").alias("root"), *simhash.PARITIES)
    id_of = {r.node: r.doc_id for r in nodes.collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in every]
    want = {(i, j) for j in range(len(every)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(want) == 7
    found = {tuple(sorted((id_of[r.a], id_of[r.b]))) for r in simhash.left_out(spark, df, roots, 5, 0.8).collect()}
    assert found == want  # of 666 pairs
    assert {len(r.odd) for r in nodes.collect()} == {64, 128}
    a, b = nodes.select(F.col("node").alias("x"), F.col("odd").alias("a")), nodes.select(F.col("node").alias("y"), F.col("odd").alias("b"))
    for r in a.crossJoin(b).select("x", "y", simhash._bits_apart(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n <= len(sets[id_of[r.x]] ^ sets[id_of[r.y]])
