"""op1_token_planes and op3_langid against plain Python."""

import zlib

import numpy as np
import public_tokenizers
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import langid, queries
from tidemark.llm.common import table


def test_token_planes_against_the_library(spark, sf):
    plain, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(table(spark, sf, "documents").select("doc_id", "text").collect(), key=lambda r: r.doc_id):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = queries.op1_token_planes(spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(tuple(r) for r in got.collect()) == want


def test_languages_against_plain_compression(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "text", "lang").collect()
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows}
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    dictionaries = langid.learn_dictionaries(spark, docs, ~langid.held_out(F.col("doc_id"), 3, 1))
    learnt = {r.lang for r in rows if not out[r.doc_id] and r.lang and r.text}
    assert set(dictionaries) == learnt
    for lang, content in dictionaries.items():  # only texts of the other folds, each whole, in lower case
        texts = {r.text.lower() for r in rows if r.lang == lang and not out[r.doc_id] and r.text}
        assert all(any(part in t for t in texts) for part in content.decode().split("\n")[:3])

    def size(text, content):
        raw = text.lower().encode()
        zip_ = zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
        parts = [raw[i : i + 2048] for i in range(0, len(raw), 2048)]
        if len(raw) < 256:
            parts += [raw[len(raw) * k // 4 :] for k in (1, 2, 3) if len(raw) * k // 4]
        return sum(len(zip_.compress(p)) for p in parts)

    got = {r.doc_id: r for r in queries.op3_langid(spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == out[r.doc_id] and 0 <= g.score <= 1
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        ranked = sorted((size(r.text, c), lang) for lang, c in dictionaries.items())
        assert g.lang_pred == ranked[0][1] and abs(g.score - (1 - ranked[0][0] / ranked[1][0])) < 1e-12
    held = [r for r in rows if out[r.doc_id] and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.95 * len(held)


def test_a_tie_goes_to_the_language_that_sorts_first():
    c = langid.Classifier({"b": b"same words in both " * 20, "a": b"same words in both " * 20})
    assert c.predict("same words in both, and again") == ("a", 0.0)
