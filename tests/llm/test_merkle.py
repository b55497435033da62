"""Manifests against a plain tree of hashes."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries
from tidemark.llm.common import table


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(hashes, arity):
    """All levels of a tree, leaves first."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def way(levels, i, arity):
    """The siblings' runs of node i with its slot, bottom up."""
    out = []
    for level in levels[:-1]:
        run = level[i // arity * arity : i // arity * arity + arity]
        out.append((run, i % arity))
        i //= arity
    return out


def plain(rows, tampered, arity=2):
    leaf = lambda r, more=0: sha("".join(map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1]))))
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by_lang[lang].sort(key=lambda x: x[:3])
    trees = {lang: tree([x[2] for x in by_lang[lang]], arity) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs], arity)
    out = []
    for k, lang in enumerate(langs):
        for i, (_, _, h, r) in enumerate(by_lang[lang]):
            steps = way(trees[lang], i, arity) + way(top, k, arity)
            at = leaf(r, 1) if tampered(r[0]) else h
            for run, slot in steps:
                at = sha("".join([*run[:slot], at, *run[slot + 1 :]]))
            proof = "".join("".join([*run[:slot], *run[slot + 1 :]]) for run, slot in steps)
            out.append((r[0], h, trees[lang][-1][0], top[-1][0], sha(proof), at, at == top[-1][0]))
    return sorted(out, key=str)


ROWS = [(i, f"text {i % 7} é" * (i % 5), ("en", "de", None, "", "en")[i % 5], None if i % 11 == 0 else "s", None if i % 13 == 0 else i) for i in range(120)]
ROWS += [(None, None, None, None, None), (None, "x", "en", "s", 1), (4, "b", "en", "s", 1), (4, "a", "en", "s", 1), (4, "a", "en", "s", 1), (500, "y" * 300_000, "fr", "s", 3)]


def odd(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


@pytest.mark.parametrize("arity,depth", [(2, 8), (2, 2), (3, 1)])
def test_manifest_against_a_plain_tree(spark, arity, depth):
    docs = spark.createDataFrame([(*r, "k") for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, key string").repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    got = merkle.manifest(spark, docs, tampered, arity, depth).drop("proof")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(ROWS, odd, arity)


def test_one_leaf_and_none(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert merkle.manifest(spark, spark.createDataFrame([], schema), F.lit(False)).count() == 0
    r = merkle.manifest(spark, spark.createDataFrame([ROWS[1]], schema), F.lit(True)).first()
    assert (r.subroot, r.root, r.proof, r.verified) == (r.leaf, r.leaf, "", False)


def test_query_against_a_plain_tree(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    want = plain(rows, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 0)
    got = sorted((tuple(r) for r in queries.op11_merkle(spark, sf).collect()), key=str)
    assert got == want and {r[-1] for r in got} == {True, False}
