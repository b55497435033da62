"""WARC archives in zstandard: a dictionary in the leading skippable frame, one frame for each record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import open_fs, shared_dir, small_batches

# Fixed values of the format.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSIONS = (b"WARC/0.17", b"WARC/0.18", b"WARC/1.0", b"WARC/1.1")
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:tidemark:page:"


class DamagedArchive(ValueError):
    """An archive that breaks the format: truncated, wrong lengths, bad headers or digests."""


@dataclass(frozen=True)
class Record:
    kind: str
    page_id: int | None
    url: str | None
    payload: bytes  # empty for revisits
    payload_bytes: int
    digest: str  # SHA-1 of the full payload, lower-case hexadecimal
    refers_to: int | None


_QUOTED = "X-Target-URI-Quoted"
_PLAIN_URL = re.compile(r"[!-~]+")


def _digest_text(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _name(page_id: int | None) -> str:
    return f"<{_PAGE}{'none' if page_id is None else page_id}>"


def _id(text: str | None) -> int | None:
    if not text or not text.startswith(f"<{_PAGE}") or not text.endswith(">"):
        raise DamagedArchive(f"no page in record id {text!r}")
    own = text[len(_PAGE) + 1 : -1]
    try:
        return None if own == "none" else int(own)
    except ValueError as e:
        raise DamagedArchive(f"no page in record id {text!r}") from e


def record_bytes(r: Record, date: str) -> bytes:
    """A whole record. A revisit has the HTTP header alone, whose Content-Length is still the payload's."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    head = [f"WARC-Type: {r.kind}", f"WARC-Record-ID: {_name(r.page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: {_digest_text(r.digest)}"]
    if r.url is not None:
        plain = _PLAIN_URL.fullmatch(r.url) is not None
        head.append("WARC-Target-URI: " + (r.url if plain else urllib.parse.quote(r.url, safe=":/?#[]@!$&'()*+,;=-._~")))
        if not plain:  # what no header may hold is quoted, per cents too, and so said
            head.append(f"{_QUOTED}: yes")
    if r.kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_name(r.refers_to)}"]
    else:
        block += r.payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise DamagedArchive(f"not a header: {line[:80]!r}")
        found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


def parse_record(raw: bytes) -> Record | None:
    """The record of one decoded frame, checked; None for a warcinfo record."""
    if not raw.startswith(VERSION):
        raise DamagedArchive(f"wrong version line: {raw[:20]!r}")
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise DamagedArchive("no end of headers")
    head = _headers(raw[len(VERSION) : end].split(b"\r\n"))
    try:
        length = int(head["content-length"])
        kind = head["warc-type"]
        head["warc-record-id"], head["warc-date"]
    except (KeyError, ValueError) as e:
        raise DamagedArchive(f"missing or bad header: {e}") from e
    block = raw[end + 4 : end + 4 + length]
    if len(block) != length or raw[end + 4 + length :] != b"\r\n\r\n":
        raise DamagedArchive("Content-Length and record length differ")
    if kind == "warcinfo":
        return None
    if kind not in ("response", "revisit"):
        raise DamagedArchive(f"unexpected record type {kind}")
    cut = block.find(b"\r\n\r\n")
    if cut < 0 or not block.startswith(b"HTTP/1."):
        raise DamagedArchive("no HTTP header in the block")
    http = _headers(block[:cut].split(b"\r\n")[1:])
    algorithm, _, text = head.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha1":
        raise DamagedArchive("no SHA-1 payload digest")
    try:
        payload, n, digest = block[cut + 4 :], int(http["content-length"]), base64.b32decode(text).hex()
    except (KeyError, ValueError) as e:
        raise DamagedArchive(f"missing or bad HTTP length or digest: {e}") from e
    if kind == "response":
        if len(payload) != n or hashlib.sha1(payload).hexdigest() != digest:
            raise DamagedArchive("payload and its length or digest differ")
    elif payload:
        raise DamagedArchive("a revisit with a payload")
    url = head.get("warc-target-uri")
    if url is not None and head.get(_QUOTED.lower()) == "yes":
        url = urllib.parse.unquote(url)
    return Record(kind, _id(head["warc-record-id"]), url, payload, n, digest, _id(head.get("warc-refers-to")) if kind == "revisit" else None)


class ArchiveWriter:
    def __init__(self, out, dictionary: bytes, date: str = "2024-01-01T00:00:00Z", level: int = 6):
        self.out, self.date, self.n_bytes = out, date, 0
        self.zip = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True, write_checksum=True)
        if dictionary:
            self._put(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        info = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
        self._put(self.zip.compress(VERSION + f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(int=1)}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.n_bytes += len(raw)

    def add(self, record: Record) -> None:
        self._put(self.zip.compress(record_bytes(record, self.date)))


def _opened(source) -> tuple[zstandard.ZstdCompressionDict | None, bytes]:
    """(dictionary, bytes read beyond it). The leading skippable frame may hold the dictionary as it is or as a zstandard frame."""
    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        return None, head
    n = struct.unpack("<I", head[4:])[0]
    raw = source.read(n)
    if len(raw) != n:
        raise DamagedArchive("the dictionary is cut off")
    if raw.startswith(FRAME):
        try:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        except zstandard.ZstdError as e:
            raise DamagedArchive(f"the dictionary's frame is damaged: {e}") from e
    return zstandard.ZstdCompressionDict(raw), b""


def read_archive(source, step: int = 1 << 16) -> Iterator[Record]:
    """Records of an archive of ours in order, checked against all that we write; one frame at a time is in memory."""
    dictionary, held = _opened(source)
    unzip = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        held = held or source.read(step)
        if not held:
            return
        frame, parts = unzip.decompressobj(), []
        try:
            while True:
                parts.append(frame.decompress(held))
                if frame.eof:
                    held = frame.unused_data
                    break
                held = source.read(step)
                if not held:
                    raise DamagedArchive("the last frame is cut off")
        except zstandard.ZstdError as e:
            raise DamagedArchive(f"not a zstandard frame: {e}") from e
        record = parse_record(b"".join(parts))
        if record is not None:
            yield record


@dataclass(frozen=True)
class AnyRecord:
    """A record of any archive. ``payload`` is the body of an HTTP block, else the block; ``digest_ok`` is null where there is no digest that can be checked."""

    kind: str
    record_id: str | None
    date: str | None
    url: str | None
    content_type: str | None
    payload: bytes
    digest: str | None
    digest_ok: bool | None
    refers_to: str | None


def _digest_ok(told: str | None, payload: bytes) -> bool | None:
    """Whether a digest, in hexadecimal or base 32, is the payload's; null without one or of an unknown kind."""
    algorithm, _, text = (told or "").partition(":")
    name = algorithm.lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5") or not text:
        return None
    own = hashlib.new(name, payload)
    return text.lower() == own.hexdigest() or text.rstrip("=").upper() == base64.b32encode(own.digest()).decode().rstrip("=")


def parse_any(raw: bytes) -> AnyRecord:
    """A record of one decoded frame: any version and type, with what headers it has; DamagedArchive if it is none."""
    line, _, rest = raw.partition(b"\r\n")
    if line.strip() not in VERSIONS:
        raise DamagedArchive(f"wrong version line: {line[:20]!r}")
    end = rest.find(b"\r\n\r\n")
    if end < 0:
        raise DamagedArchive("no end of headers")
    unfolded = re.sub(rb"\r\n[ \t]+", b" ", rest[:end])
    head = _headers(unfolded.split(b"\r\n") if unfolded else [])
    try:
        length, kind = int(head["content-length"]), head["warc-type"].lower()
    except (KeyError, ValueError) as e:
        raise DamagedArchive(f"missing or bad header: {e}") from e
    block = rest[end + 4 : end + 4 + length]
    if len(block) != length or rest[end + 4 + length :].strip(b"\r\n"):
        raise DamagedArchive("Content-Length and record length differ")
    if kind not in TYPES:
        raise DamagedArchive(f"unexpected record type {kind}")
    payload = block
    if head.get("content-type", "").startswith("application/http") or (kind in ("response", "revisit") and block.startswith(b"HTTP/")):
        cut = block.find(b"\r\n\r\n")
        payload = block[cut + 4 :] if cut >= 0 else b""
    told = head.get("warc-payload-digest")
    ok = None if kind == "revisit" else _digest_ok(told, payload)
    if _digest_ok(head.get("warc-block-digest"), block) is False:
        ok = False
    return AnyRecord(kind, head.get("warc-record-id"), head.get("warc-date"), head.get("warc-target-uri"), head.get("content-type"), payload, told, ok, head.get("warc-refers-to"))


def read_any(source, step: int = 1 << 16, most_bytes: int = 1 << 30) -> Iterator[AnyRecord | DamagedArchive]:
    """Records of any zstandard archive in order; what can't be read is an error in its place, and the next frame is looked for.

    One frame is in memory, ``most_bytes`` of it at most: a larger one is an error in its place too.
    """
    try:
        dictionary, held = _opened(source)
    except DamagedArchive as e:
        yield e
        return
    unzip = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        held = held or source.read(step)
        if not held:
            return
        frame, parts, size, problem, start = unzip.decompressobj(), [], 0, None, True
        try:
            while not frame.eof:
                piece = frame.decompress(held)
                size += len(piece)
                if size <= most_bytes:
                    parts.append(piece)
                start = False
                if frame.eof:
                    held = frame.unused_data
                elif not (held := source.read(step)):
                    problem = DamagedArchive("the last frame is cut off")
                    break
        except zstandard.ZstdError as e:
            problem = DamagedArchive(f"not a zstandard frame: {e}")
            held = held[1:] if start else held
            while (at := held.find(FRAME)) < 0:  # on to what may be the next frame
                more = source.read(step)
                if not more:
                    held = b""
                    break
                held = held[-3:] + more
            else:
                held = held[at:]
        if problem is None and size > most_bytes:
            problem = DamagedArchive(f"a record of {size} bytes")
        if problem is None:
            try:
                yield parse_any(b"".join(parts))
                continue
            except DamagedArchive as e:
                problem = e
        yield problem


def learn_dictionary(pages: DataFrame, sample: int = 200, most_chars: int = 20_000, size: int = 32 << 10) -> bytes:
    """A dictionary from a bounded sample: the starts (``most_chars``) of the ``sample`` rows of smallest hash of page_id. Empty if there is too little to learn from.

    It bears on the archives' size alone; records hold whole payloads.
    """
    ids = [r[0] for r in pages.where("html IS NOT NULL AND page_id IS NOT NULL").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    texts = [r[0].encode() for r in pages.where(F.col("page_id").isin(ids)).select(F.left("html", F.lit(most_chars))).limit(2 * sample).collect() if r[0]] if ids else []
    try:
        return zstandard.train_dictionary(size, sorted(texts)).as_bytes() if len(texts) >= 16 else b""
    except zstandard.ZstdError:
        return b""


def decide_roles(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, html, digest, kind, refers_to.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with
    the largest page_id is the response, the others revisit it. Rows that
    share that page_id are all responses; a null page_id is the smallest; a
    null html is an empty payload.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html).alias("digest"), (F.octet_length(html) >= least_bytes).alias("big"))
    again = rows.where("big").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "keeper")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    # small pages, often equal, need no partner; of the join a digest of many rows is a skewed key on the left, which is split
    small, big = rows.where("NOT big").withColumn("keeper", F.lit(None).cast("long")), rows.where("big").join(again, "digest", "left")
    return small.unionByName(big).select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, most_bytes: int = 64 << 20) -> DataFrame:
    """Writes a record for every row; returns the archives' paths. A task that runs twice leaves the same names."""
    small_batches(spark, 512)
    dictionary = learn_dictionary(pages)

    def write(batches):
        from pyspark import TaskContext

        part, made, writer = TaskContext.get().partitionId(), [], None

        def close():
            out.close()
            fs.move(temporary, path)
            made.append(name)

        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    name = f"{folder}/part-{part:06d}-{len(made):05d}.warc.zst"
                    fs, path = open_fs(name)
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    temporary = f"{path}.{uuid.uuid4().hex}.part"
                    out = fs.open_output_stream(temporary, compression=None)
                    writer = ArchiveWriter(out, dictionary)
                payload = row["html"].encode()
                writer.add(Record(row["kind"], row["page_id"], row["url"], payload, len(payload), row["digest"], row["refers_to"]))
                if writer.n_bytes >= most_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(made)], names=["path"])

    paths = sorted(r[0] for r in decide_roles(pages).mapInArrow(write, "path string").collect())  # one for each archive
    return spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "nth long, path string")


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the archives, checked."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("url", pa.string()), ("payload", pa.binary())] * with_payload)

    def read(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, p = open_fs(path)
                with fs.open_input_stream(p, compression=None) as source:
                    rows = []
                    for r in read_archive(source):
                        row = (r.page_id, r.payload_bytes, r.digest, r.kind, r.refers_to)
                        rows.append((*row, r.url, r.payload) if with_payload else row)
                        if len(rows) == (256 if with_payload else 4096):
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    n = max(archives.count(), 1)
    return archives.repartitionByRange(n, "nth").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload)


def read_any_archives(spark: SparkSession, archives: DataFrame, strict: bool = False) -> DataFrame:
    """path, nth, record_type, record_id, date, url, content_type, payload, payload_digest, digest_ok, refers_to, problem of every record of any archives (path).

    A record that can't be read is a row with its ``problem`` and nothing else, ``strict`` makes it an error. An empty archive or table has no rows; other columns of ``archives`` are not looked at.
    """
    names = ["path", "nth", "record_type", "record_id", "date", "url", "content_type", "payload", "payload_digest", "digest_ok", "refers_to", "problem"]
    schema = pa.schema([(n, {"nth": pa.int64(), "payload": pa.binary(), "digest_ok": pa.bool_()}.get(n, pa.string())) for n in names])

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = open_fs(path)
                rows, size = [], 0
                with fs.open_input_stream(p, compression=None) as source:
                    for nth, r in enumerate(read_any(source)):
                        if isinstance(r, DamagedArchive):
                            if strict:
                                raise r
                            rows.append((path, nth, *[None] * 9, str(r)))
                        else:
                            rows.append((path, nth, r.kind, r.record_id, r.date, r.url, r.content_type, r.payload, r.digest, r.digest_ok, r.refers_to, None))
                            size += len(r.payload)
                        if len(rows) == 1024 or size > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    kinds = {"nth": "long", "payload": "binary", "digest_ok": "boolean"}
    return archives.select("path").repartition(max(archives.count(), 1), "path").mapInArrow(read, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN k.keeper IS NOT NULL AND k.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n >= 1000"""
