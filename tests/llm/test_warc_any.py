"""Archives that this writer did not write: versions, types, digests, dictionaries, damage."""

import base64
import hashlib
import io
import struct

import pytest
import zstandard

from tidemark.llm import warc


def record(kind, block, version="WARC/1.0", **headers):
    lines = [version, f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", *[f"{k.replace('_', '-')}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<html>body</html>"
BODY = b"<html>body</html>"
RECORDS = [
    record("warcinfo", b"software: other\r\n", Content_Type="application/warc-fields"),
    record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", Content_Type="application/http; msgtype=request", WARC_Target_URI="http://a/"),
    record("response", HTTP, Content_Type="application/http; msgtype=response", WARC_Payload_Digest="sha1:" + base64.b32encode(hashlib.sha1(BODY).digest()).decode()),
    record("response", HTTP, "WARC/1.1", WARC_Payload_Digest="sha256:" + hashlib.sha256(BODY).hexdigest()),
    record("response", HTTP, WARC_Payload_Digest="sha1:" + "A" * 32),
    record("resource", b"plain", "WARC/0.18", WARC_Target_URI="file:x", WARC_Payload_Digest="crc32:1"),
    record("metadata", b"a: b\r\n"), record("conversion", b"text"), record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", WARC_Refers_To="<urn:uuid:2>", WARC_Payload_Digest="sha1:" + "B" * 32),
]


def archive(records, dictionary=b"", squeezed=False):
    out = b""
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if dictionary:
        held = zstandard.compress(dictionary) if squeezed else dictionary
        out += struct.pack("<II", warc.SKIPPABLE, len(held)) + held
    zip_ = zstandard.ZstdCompressor(dict_data=data)
    return out + b"".join(zip_.compress(r) for r in records)


@pytest.mark.parametrize("dictionary,squeezed", [(b"", False), (b"<html>body</html> WARC/1.0 " * 40, False), (b"<html>body</html> WARC/1.0 " * 40, True)])
@pytest.mark.parametrize("step", [7, 1 << 16])
def test_records_of_others(dictionary, squeezed, step):
    got = list(warc.read_any(io.BytesIO(archive(RECORDS, dictionary, squeezed)), step))
    assert [r.kind for r in got] == ["warcinfo", "request", "response", "response", "response", "resource", "metadata", "conversion", "revisit"]
    assert [r.digest_ok for r in got] == [None, None, True, True, False, None, None, None, None]
    assert got[2].payload == BODY and got[5].payload == b"plain" and got[8].refers_to == "<urn:uuid:2>" and got[1].url == "http://a/"


@pytest.mark.parametrize("step", [64, 1 << 16])
def test_damage_is_a_row(step):
    frames = [zstandard.compress(r) for r in RECORDS[:4]]
    broken = frames[1][:10] + bytes([frames[1][10] ^ 255]) + frames[1][11:]
    wrong = zstandard.compress(RECORDS[2].replace(b"Content-Length: ", b"Content-Length: 9"))
    for raw, want in (
        (frames[0] + wrong + frames[3], ["warcinfo", None, "response"]),
        (frames[0] + b"no frame at all" + frames[3], ["warcinfo", None, "response"]),
        (frames[0] + frames[3][:-5], ["warcinfo", None]), (b"", []), (b"\x00", [None]),
        (frames[0] + zstandard.compress(b"WARC/9.9\r\n\r\n") + zstandard.compress(record("odd", b"")) + frames[2], ["warcinfo", None, None, "response"]),
    ):
        got = list(warc.read_any(io.BytesIO(raw), step))
        assert [getattr(r, "kind", None) for r in got] == want
    got = [getattr(r, "kind", None) for r in warc.read_any(io.BytesIO(frames[0] + broken + frames[3]), step)]
    assert got[0] == "warcinfo" and got[-1] == "response"
    assert isinstance(list(warc.read_any(io.BytesIO(frames[2]), most_bytes=10))[0], warc.DamagedArchive)


def test_archives_as_a_table(spark, tmp_path):
    for name, raw in (("a", archive(RECORDS)), ("b", archive(RECORDS[:2]) + b"junk"), ("c", b"")):
        (tmp_path / f"{name}.warc.zst").write_bytes(raw)
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.zst", 1) for n in "abc"], "path string, nth int")
    rows = warc.read_any_archives(spark, paths).collect()
    assert len(rows) == 12 and sum(r.problem is not None for r in rows) == 1
    assert {r.record_type for r in rows} == {None, "warcinfo", "request", "response", "resource", "metadata", "conversion", "revisit"}
    with pytest.raises(Exception, match="zstandard"):
        warc.read_any_archives(spark, paths, strict=True).collect()
    own = warc.write_archives(spark, spark.createDataFrame([(1, "u", "x" * 2000), (2, "u", "x" * 2000), (3, None, None)], "page_id long, url string, html string"), f"file://{tmp_path}/own")
    assert sorted(r.record_type for r in warc.read_any_archives(spark, own).collect() if r.record_type != "warcinfo") == ["response", "response", "revisit"]
