"""Repeated strings of bytes against a dictionary of all strings; suffix arrays against sorting."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tidemark.llm import queries, substrings
from tidemark.llm.common import table
from tidemark.llm.suffix_groups import laid_out, suffix_array


def test_suffix_arrays_against_sorting():
    rng = random.Random(3)
    for _ in range(300):
        strings, units = [], []
        for u in range(rng.randint(1, 5)):
            for _ in range(rng.randint(1, 5)):
                k = rng.choice([1, 2, 3, 20])
                strings.append(bytes(rng.randrange(k) + 97 for _ in range(rng.randint(0, 40))))
                units.append(u)
        codes, base, end, _ = laid_out(strings, np.array(units))
        sa, c = suffix_array(codes, base, end), codes.tolist()
        for b, e in zip(base.tolist(), end.tolist()):
            assert sa[b:e].tolist() == sorted(range(b, e), key=lambda i: c[i:e])


def brute(rows, length):
    """(doc_id, bytes, removed, spans, digest) by looking every string up."""
    seen, out = set(), []
    raws = [(i is not None, i or 0, xxhash.xxh3_64_intdigest((t or "").encode()), i, (t or "").encode()) for i, t in rows]
    for *_, i, raw in sorted(raws, key=lambda r: r[:3]):
        gone = np.zeros(len(raw) + 2, np.int64)
        for at in range(len(raw) - length + 1):
            s = raw[at : at + length]
            if s in seen:
                gone[at + 1 : at + length + 1] = 1
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone[1:]) if not g)
        out.append((i, len(raw), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,part,hold", [(30, 32, 1 << 20), (30, 2, 300), (41, 1, 1 << 20)])
def test_small_texts(spark, length, part, hold):
    rng = random.Random(length + part)
    words = ["".join(rng.choice("ab é") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = [(rng.choice([None, 7, *range(40)]), "".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for _ in range(90)]
    rows += [(50, None), (51, ""), (52, "a" * 300), (53, "a" * 300), (53, "a" * 300), (53, "b" + "a" * 200), (54, "ab" * 40), (60, words[0] * 400)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, doc int, tie int, spans int").repartition(7)
    got = substrings.report(substrings.remove_repeats(spark, docs, length, part, hold))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, length)


def test_blocks_do_not_matter():
    rng = random.Random(5)
    raw = bytes(rng.randrange(3) for _ in range(5000))
    sizes = np.array([100, 4000, 0, 900])
    for block in (64, 1000):
        doc, first, n, anchor, content = substrings.stretches(raw, sizes, 50, block)
        strings = sorted((d, f + k) for d, f, m in zip(doc.tolist(), first.tolist(), n.tolist()) for k in range(m))
        assert strings == [(d, f) for d, size in enumerate(sizes) for f in range(size - 49)]
        assert n.max() <= 50 - substrings.GRAM + 1


def test_query_against_all_strings(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op12_suffix_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows, 100)
    assert any(r[2] for r in got)
    assert substrings.remove_repeats(spark, table(spark, sf, "documents").limit(0)).count() == 0
