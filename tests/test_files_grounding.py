"""Files as rows, grounding of entities and relations, unified retrieval and context on small fixtures."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.operators import grounding as G, retrieval, unified
from tidemark.sources import files


def test_files_and_uploads(spark, tmp_path):
    pdf = b"%PDF-1.4\nx\n%%EOF\n"
    rows = [("b.pdf", pdf), ("a.pdf", pdf), ("c.PDF", b"junk" * 10 + pdf), ("d.pdf", b"no header %%EOF"), ("e.pdf", b"%PDF-1.4 cut"), ("f.txt", pdf), ("g.pdf", pdf + b"z" * 3000 + b"%%EOF"), ("h.pdf", b"%PDF-" + b"\xff" * 50 + b"%%EOF")]
    root = f"file://{tmp_path}/up"
    assert files.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(3), root) == len(rows)
    found = files.scan(spark, root)
    assert {(r.name, r["size"], r.sha256) for r in found.collect()} == {(n, len(c), hashlib.sha256(c).hexdigest()) for n, c in rows}
    old = spark.createDataFrame([(hashlib.sha256(rows[7][1]).hexdigest(),)], "sha256 string")
    got = {r.name: r.state for r in files.pdf_uploads(found, old, most_bytes=2000).collect()}
    assert got == {"a.pdf": "registered", "b.pdf": "conflict", "c.PDF": "registered", "d.pdf": "no_header", "e.pdf": "truncated", "f.txt": "not_pdf", "g.pdf": "too_large", "h.pdf": "conflict"}
    with pytest.raises(Exception, match="not a file name"):
        files.write_files(spark.createDataFrame([("../x", b"")], "name string, content binary"), root)


def test_canonical_files(spark, tmp_path):
    good = '{"document_id":"d1","pages":[{"page_number":1,"blocks":[{"block_id":"b","type":"text"}]},{"page_number":2,"blocks":null}]}'
    rows = [("a.json", good), ("b.json", good[:-1]), ("c.json", '{"document_id":null,"pages":[]}'), ("d.json", "[]"), ("e.json", '{"document_id":"d2"}')]
    root = f"file://{tmp_path}/c"
    files.write_files(spark.createDataFrame([(n, t.encode()) for n, t in rows], "name string, content binary"), root)
    got = {r.name: (r.document_id, r.pages, r.blocks, r.problem) for r in files.canonical(files.scan(spark, root, "*.json")).collect()}
    assert got["a.json"] == ("d1", 2, 1, None) and got["b.json"][3] == "invalid" and got["c.json"] == (None, None, None, "no_document") and got["d.json"][3] == "invalid" and got["e.json"][3] == "invalid"


def test_reasons_of_grounding(spark):
    chunks = spark.createDataFrame([(1, "The  Red River meets the Blue Hill, says Ann."), (2, None)], "chunk long, text string")
    entities = spark.createDataFrame([(1, "red river", "place", ["the red"]), (1, "RED  RIVER", "place", ["blue"]), (1, "Blue Hill", "place", None), (1, "Ghost", "place", None), (1, "Nile", "place", ["says ann"]), (1, "Ann", "person", ["nobody"]), (1, " ", "place", None), (2, "x", "place", None)], "chunk long, name string, kind string, aliases array<string>")
    taken = G.grounded_entities(spark, entities, chunks)
    assert {(r.chunk, r.key): (r.n, r.aliases, r.reason) for r in taken.collect()} == {
        (1, "red river"): (2, ["blue", "the red"], None), (1, "blue hill"): (1, [], None), (1, "ghost"): (1, [], G.NOT_GROUNDED), (1, "nile"): (1, ["says ann"], None), (1, "ann"): (1, ["nobody"], G.NOT_GROUNDED), (2, "x"): (1, [], G.NOT_GROUNDED)}
    relations = spark.createDataFrame([
        (1, "Red River", "Blue Hill", "meets", "red river meets the blue hill"), (1, "the red", "Blue Hill", "meets", "Red River meets the Blue Hill"), (1, "Ghost", "Nile", "r", "says Ann"), (1, "Nile", "Blue Hill", "r", "not there"),
        (1, "Nile", "Blue Hill", "s", "the Blue Hill"), (1, "Blue Hill", "Nile", "t", "the Blue Hill")], "chunk long, source string, target string, kind string, evidence string")
    got = {(r.source, r.kind): r.reason for r in G.grounded_relations(spark, relations, taken, chunks).collect()}
    assert got == {("Red River", "meets"): None, ("the red", "meets"): G.DUPLICATE, ("Ghost", "r"): G.NO_ENDPOINT, ("Nile", "r"): G.NO_EVIDENCE, ("Nile", "s"): G.NO_SOURCE, ("Blue Hill", "t"): G.NO_TARGET}


def test_unified_list(spark):
    hits = lambda *ids: spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(ids)], "query_id long, doc_id long, rank int")
    texts = spark.createDataFrame([(d, "red fish " * (d % 3 == 0) + f"doc {d}") for d in range(30)] + [(99, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "Red fish?"), (2, "nothing")], "query_id long, question string")
    found = unified.search(spark, asked, texts, {"dense": hits(*range(1, 12)), "visual": hits(20, 22, 99), "sparse": hits(3, 5)}, visual=F.col("doc_id") >= 20)
    got = [(r.doc_id, r.score, r.branches, r.special) for r in found.orderBy("rank").collect()]
    assert len(got) == 8 and [d for d, *_ in got][:3] == [3, 6, 9] and [d for d, *_ in got if d >= 20] == [20, 22]
    assert got[0] == (3, 1.0, ["dense", "sparse"], False)
    with pytest.raises(ValueError):
        unified.search(spark, asked, texts, {"other": hits(1)})


def test_context_without_repeats(spark):
    rows = [(1, 1, 10, [1, 2], "a"), (1, 2, 11, [2, 3], "a"), (1, 3, 12, [3, 4], "a"), (1, 4, 10, [9], "b"), (1, 5, 13, None, "a"), (1, 6, 14, [1], None), (1, 7, 15, [1], None), (2, 1, 11, [2], "a")]
    got = retrieval.distinct_context(spark.createDataFrame(rows, "query_id long, rank int, doc_id long, blocks array<int>, text string"))
    assert sorted((r.query_id, r["rank"], r.doc_id) for r in got.collect()) == [(1, 1, 10), (1, 3, 12), (1, 5, 13), (1, 6, 14), (2, 1, 11)]
