"""Chunking on hand-made sections."""

import random

from tidemark.operators import chunking as C


def blocks(*specs):
    return [C.Block(i, 1 + i // 3, kind, text) for i, (kind, text) in enumerate(specs)]


def shape(chunks):
    return [[b.at for b in c.blocks] for c in chunks]


def test_texts_are_cut_whole():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab. ;\n。é") for _ in range(rng.randint(0, 90)))
        pieces = list(C.split_text(t, 13))
        assert "".join(pieces) == t and all(0 < len(p) <= 13 for p in pieces)
    assert list(C.split_text("one; two three four", 12)) == ["one;", " two three ", "four"]
    assert list(C.split_text("abcdefghij", 4)) == ["abcd", "efgh", "ij"]


def test_packing_and_titles():
    t = lambda n: ("text", "x" * n)
    assert shape(C.chunk_section(blocks(t(60), t(30), t(40), t(30)), 80, 100, 10)) == [[0, 1], [2, 3]]
    got = C.chunk_section(blocks(("title", "## T"), t(250)), 80, 100, 10)  # titles stay with the first piece of a long text
    assert shape(got) == [[0, 1], [1], [1]] and got[0].text.startswith("## T\n\nx") and max(len(c.text) for c in got) <= 100
    assert shape(C.chunk_section(blocks(("title", "## T"), ("table", "y" * 250), t(5)), 80, 100, 1)) == [[0, 1], [2]]
    assert shape(C.chunk_section(blocks(("image", ""), ("image", ""), t(20)), 80, 100, 10)) == [[0, 1, 2]]
    assert shape(C.chunk_section(blocks(t(90), t(5)), 80, 100, 10)) == [[0, 1]]  # a short tail joins
    assert shape(C.chunk_section(blocks(t(99), t(5)), 80, 100, 10)) == [[0], [1]]  # but never over the limit


def test_formulas_look_for_context():
    t = lambda n: ("text", "x" * n)
    f = lambda n: ("formula", "f" * n)
    assert shape(C.chunk_section(blocks(t(50), t(31), f(40)), 80, 100, 1)) == [[0], [1, 2]]  # only the last block fits with it
    assert shape(C.chunk_section(blocks(t(85), f(10)), 80, 100, 1)) == [[0, 1]]
    assert shape(C.chunk_section(blocks(t(95), f(40)), 80, 100, 1)) == [[0], [1]]
    assert shape(C.chunk_section(blocks(f(60), t(30), f(50), t(99)), 80, 100, 1)) == [[0], [1, 2], [3]]


def test_stream_of_sorted_blocks(spark):
    rows = [(d, i, 1 + i // 2, kind, text) for d, specs in {1: [("text", "before"), ("title", "A"), ("title", "B"), ("text", "body " * 400), ("title", "C")], 2: [("image", None)], 3: [("title", "T"), ("text", "a"), ("formula", "e=1")]}.items() for i, (kind, text) in enumerate(specs)]
    df = spark.createDataFrame(rows, "document_id long, at int, page int, type string, text string").repartition(3)
    chunks = C.chunk(df)
    got = {(r.document_id, r.ordinal): (r.section, r.path, r.blocks, r.types, r.first_page, r.last_page) for r in chunks.collect()}
    assert got[1, 0] == (0, [], [0], ["text"], 1, 1) and got[1, 1] == (1, ["A", "B"], [1, 2, 3], ["title", "text"], 1, 2) and got[1, 2][2] == [3] and got[1, 3] == (2, ["C"], [4], ["title"], 3, 3)
    assert got[2, 0] == (0, [], [0], ["image"], 1, 1) and got[3, 0] == (0, ["T"], [0, 1, 2], ["title", "text", "formula"], 1, 2)
    assert C.lineage(df, chunks).count() == 0
    assert C.chunk(df.limit(0)).count() == 0
    one = C.summary(df, chunks).first()
    assert (one.documents, one.source_blocks, one.coverage_rate, one.multiply_referenced, one.with_formula) == (3, 9, 1.0, 1, 1)
