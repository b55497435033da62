"""Charts, report files and the cache of results."""

import re
import zlib

import pytest

from tidemark.operators.cache import ResultCache
from tidemark.operators.charts import infer_charts
from tidemark.sources import reports


def test_chart_kinds_and_what_cannot_be_drawn(spark):
    rows = [("pie", k, f"l{k}", float(k)) for k in range(6)] + [("bar", k, f"l{k}", float(k)) for k in range(7)] + [("minus", k, f"l{k}", -1.0) for k in range(2)]
    rows += [("long", k, f"l{k}", 1.0) for k in range(25)] + [("full", k, f"l{k}", 1.0) for k in range(24)] + [("twice", k, "same", 1.0) for k in range(2)]
    rows += [("null label", 0, None, 1.0), ("null value", 0, "a", None), ("nan", 0, "a", float("nan")), ("inf", 0, "a", float("inf")), (None, 0, "a", 1.0)] + [("hot", k, f"l{k}", 1.0) for k in range(3000)]
    df = spark.createDataFrame(rows, "result string, at long, name string, amount double").repartition(5)
    got = {r.result: r for r in infer_charts(df, ["result"], "at").collect()}
    assert {k: r.kind for k, r in got.items()} == {"pie": "pie", "bar": "bar", "minus": "bar", "full": "bar", None: "pie"} | dict.fromkeys(["long", "twice", "null label", "null value", "nan", "inf", "hot"])
    assert [(p.label, p.value) for p in got["pie"].points] == [(f"l{k}", float(k)) for k in range(6)] and (got["pie"].category, got["pie"].value, got["hot"].points) == ("name", "amount", None)
    assert infer_charts(df.limit(0), ["result"], "at").count() == 0
    assert infer_charts(df.withColumnRenamed("name", "order_date"), ["result"], "at").where("result = 'pie'").first().kind == "line"
    for lacking in ("name", "amount"):
        assert all(r.kind is None for r in infer_charts(df.drop(lacking), ["result"], "at").collect())


def _report(**changes):
    source = {"id": "ab-cd-ef0123456789", "kind": "rag_evidence", "title": "T\x00", "page_start": 3, "page_end": None, "snippet": "said <so> & \ud800so", "question": None, "answer": None, "columns": None, "rows": None}
    return {"report_id": "1", "title": "图表", "sections": [{"title": "One", "content": "a\n\nb", "sources": [source | changes]}]}


def test_report_files():
    r = _report()
    assert reports.items(r) == [("Title", "图表"), ("Heading1", "One"), ("", "a"), ("", ""), ("", "b"), ("Heading2", "[S-ABCDEF012345] T，第 3–3 页"), ("", "said <so> & so"), ("Heading1", reports.REFERENCES), ("", "[S-ABCDEF012345] T，第 3–3 页")]
    assert reports.docx(r) == reports.docx(_report()) and reports.pdf(r) == reports.pdf(_report())
    raw = reports.pdf(r | {"sections": r["sections"] * 40})
    at = [int(x) for x in re.findall(rb"^(\d{10}) 00000 n", raw, re.M)]
    assert all(raw[a:].startswith(f"{k} 0 obj".encode()) for k, a in enumerate(at, 1))
    pages = [zlib.decompress(x) for x in re.findall(rb"stream\n(.*?)\nendstream", raw, re.S)]
    shown = "".join(bytes.fromhex(h.decode()).decode("utf-16-be") for page in pages for h in re.findall(rb"<([0-9a-f]*)>", page))
    assert len(pages) == raw.count(b"/Type /Page ") > 2 and shown.startswith("图表One") and shown.count("said <so> & so") == 40


@pytest.mark.parametrize("big", [{"sections": _report()["sections"] * 101}, {"sections": [_report()["sections"][0] | {"content": "x" * 1_000_001}]}, _report(kind="chatbi_result", columns=["a", "b"], rows=[["1", "2"]] * 25_001)])
def test_a_report_over_its_bounds_is_refused(big):
    with pytest.raises(reports.ReportTooLarge):
        reports.docx(_report() | big)


def test_exported_reports(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "t", []), ("c", "t", [(None, None, None)]), ("d", "x" * 1_000_001, None), (None, "n", None)], reports.SCHEMA)
    for kind, magic in (("docx", b"PK"), ("pdf", b"%PDF")):
        got = {r.report_id: r for r in reports.export(df, kind).collect()}
        assert len(got) == 5 and got["d"].content is None and got["d"].error and all(bytes(r.content[: len(magic)]) == magic for k, r in got.items() if k != "d")
    told = reports.docx_paragraphs(reports.export(df)).where("report_id = 'c'").orderBy("nth").collect()
    assert [(r.style, r.text) for r in told] == [("Title", "t"), ("Heading1", ""), (None, ""), ("Heading1", reports.REFERENCES)]
    assert reports.docx_paragraphs(reports.export(df.limit(0))).count() == 0


def test_cache_keeps_for_a_time(spark):
    now, asked = [0.0], []

    def build(n):
        asked.append(n)
        return spark.range(n).selectExpr("id", "cast(null as int) AS none")

    cache = ResultCache(most_entries=2, ttl=300, empty_ttl=60, most_rows=5, clock=lambda: now[0])
    ask = lambda key, n: sorted(r.id for r in cache.result(spark, key, lambda: build(n)).collect())
    assert ask("a", 3) == ask("a", 3) == [0, 1, 2] and asked == [3]
    assert ask("none", 0) == ask("none", 0) == [] and asked == [3, 0]
    now[0] = 61
    assert ask("none", 0) == [] and ask("a", 3) == [0, 1, 2] and asked == [3, 0, 0]
    now[0] = 301
    ask("a", 3)
    ask("b", 1)  # the empty result, used longest ago, goes
    assert asked == [3, 0, 0, 3, 1] and ask("none", 0) == [] and asked[-1] == 0
    assert ask("large", 6) == ask("large", 6) == list(range(6)) and asked[-2:] == [6, 6]  # not kept, not cut
    assert ask(None, 1) == ask(None, 1) == [0] and asked[-2:] == [1, 1]
    with pytest.raises(ValueError):
        ResultCache(most_entries=0)
