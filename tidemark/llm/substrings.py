"""Removal of byte strings that stand earlier in the corpus, on suffix arrays.

Every string of ``length`` bytes holds an anchor: of its 24-byte grams the one
of least hash (the first, if several). Equal strings have equal anchors, so only places with
equal anchors are compared. A document is cut into stretches, each the
consecutive strings with one anchor; about one for every 35 bytes. What the cluster
exchanges are stretches, not strings:

1. Each task finds the stretches of its texts; of equal ones only the first goes on.
2. By anchor: of equal stretches all but the first of the corpus are repeats, whole.
3. Where an anchor has stretches that differ, their bytes are fetched and a
   suffix array orders them (``suffix_groups``): neighbours that agree on ``length`` bytes
   are equal strings. An anchor of many stretches is dealt to several arrays, whose
   distinct strings are then compared by anchor and hash.
4. By document: the repeats are united and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidemark.llm.common import small_batches, written
from tidemark.llm.suffix_groups import laid_out, suffix_array

GRAM = 24
_POS = np.uint64((1 << 24) - 1)
_MIX = np.random.default_rng(12).integers(1, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)
_NO_ID = -(1 << 63)
_OCC = "anchor long, content long, doc long, tie long, place long"
_KNOWN = "anchor long, content long, doc long, tie long, first long, n long"
_NAMES = ("anchor", "content", "doc", "tie", "first", "n")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of the 24 bytes from each place on: doubled from 1 to 16 bytes, then 16 and 8 together."""
    h, k = _MIX[0][b], 1
    eight = h
    while k < 16:
        h = h[:-k] * _MIX[1][k] + h[k:]
        h ^= h >> np.uint64(31)
        k *= 2
        if k == 8:
            eight = h
    n = len(b) - GRAM + 1
    h = h[:n] * _MIX[1][0] + eight[16 : 16 + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(29))


def _least(a: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours."""
    k = 1
    while 2 * k <= w:
        a, k = np.minimum(a[:-k], a[k:]), 2 * k
    return np.minimum(a[: len(a) - (w - k)], a[w - k :]) if k < w else a


def stretches(raw: bytes, sizes: np.ndarray, length: int, block: int = 1 << 20) -> tuple[np.ndarray, ...]:
    """(document, first string, number of strings, anchor, content) of the stretches of texts that stand one after the other in ``raw``."""
    b = np.frombuffer(raw, np.uint8)
    offsets = np.cumsum(sizes) - sizes
    out = []
    for low in range(0, max(0, len(b) - length + 1), block):
        part = b[low : low + block + length - 1]
        h = _gram_hashes(part)
        anchor_at = (_least((h & ~_POS) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & _POS).astype(np.int64)
        doc = np.searchsorted(offsets, np.arange(low, low + len(anchor_at)), "right") - 1
        at = np.flatnonzero(np.arange(low, low + len(anchor_at)) + length <= (offsets + sizes)[doc])
        if not len(at):
            continue
        own, doc = anchor_at[at], doc[at]
        head = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])])
        n, first = np.diff(np.r_[head, len(at)]), at[head] + low
        digest = xxhash.xxh3_64_intdigest
        content = np.array([digest(raw[i:j]) for i, j in zip(first.tolist(), (first + n + length - 1).tolist())], np.uint64)
        out.append((doc[head], first - offsets[doc[head]], n, _signed(h[own[head]]), _signed(content)))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def _joined(doc: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first, number) of ranges of strings, neighbouring ones as one; they come in order."""
    if not len(doc):
        return doc, first, n
    head = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (first[1:] != (first + n)[:-1])])
    return doc[head], first[head], np.add.reduceat(n, head)


def _local(texts: list[bytes], doc: list[int], tie: list[int], length: int) -> tuple[np.ndarray, ...]:
    """Occurrences of one task's texts: of equal stretches the first, and ranges of the others (place < 0, content their number)."""
    by = sorted(range(len(texts)), key=lambda k: (doc[k], tie[k]))
    once = [k for x, k in enumerate(by) if not x or (doc[k], tie[k]) != (doc[by[x - 1]], tie[by[x - 1]])]
    ids, ties = np.array([doc[k] for k in once], np.int64), np.array([tie[k] for k in once], np.int64)
    d, first, n, anchor, content = stretches(b"".join(texts[k] for k in once), np.array([len(texts[k]) for k in once]), length)
    order = np.lexsort((first, d, content, anchor))
    a, c = anchor[order], content[order]
    lead = np.zeros(len(order), bool)
    lead[order] = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])] if len(order) else lead
    rd, rf, rn = _joined(d[~lead], first[~lead], n[~lead])
    spread = (rf * 0x9E3779B1 + ties[rd]) if len(rd) else rf  # known already: dealt anywhere
    return (np.r_[anchor[lead], spread], np.r_[content[lead], rn], ids[np.r_[d[lead], rd]], ties[np.r_[d[lead], rd]], np.r_[first[lead] << 8 | n[lead], -1 - rf])


def _batches(columns: tuple[np.ndarray, ...], names: tuple[str, ...], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[low : low + rows]) for c in columns], names=list(names))


def _tie(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _occurrences(length: int, hold: int = 1 << 25):
    def found(batches):
        texts, doc, tie, size = [], [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = t.as_py().encode()
                texts.append(raw)
                doc.append(i)
                tie.append(_tie(raw))
                size += len(raw)
                if size >= hold:
                    yield from _batches(_local(texts, doc, tie, length), ("anchor", "content", "doc", "tie", "place"))
                    texts, doc, tie, size = [], [], [], 0
        if texts:
            yield from _batches(_local(texts, doc, tie, length), ("anchor", "content", "doc", "tie", "place"))

    return found


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences in order of (anchor, content, doc, tie, place) -> ranges that are repeats (anchor null), and first stretches whose anchor has others."""
    last = None  # the first occurrence of the class at hand, and whether its anchor had a class before
    for batch in batches:
        a, c, d, t, p = (batch.column(k).to_numpy() for k in range(5))
        known = p < 0
        ranges = [(d[known], t[known], -1 - p[known], c[known])]
        rows = np.stack([x[~known] for x in (a, c, d, t, p)])
        carried = last is not None
        if carried:
            rows = np.c_[last[0], rows]
        if rows.shape[1]:
            a, c, d, t, p = rows
            same = a[1:] == a[:-1]
            lead = np.r_[True, ~same | (c[1:] != c[:-1])]
            at = np.flatnonzero(lead)
            of = at[np.cumsum(lead) - 1]
            more = ~lead & ((d != d[of]) | (t != t[of]) | (p != p[of]))  # the same place again is a repeated row
            ranges.append((d[more], t[more], p[more] >> 8, p[more] & 255))
            fa = a[at]
            shares = np.zeros(len(at), bool)
            shares[1:] |= fa[1:] == fa[:-1]
            shares[:-1] |= fa[1:] == fa[:-1]
            shares[0] |= carried and last[1]
            ask = at[:-1][shares[:-1]]
            last = (rows[:, at[-1]], bool(shares[-1]))
            if len(ask):
                yield from _batches((a[ask], c[ask], d[ask], t[ask], p[ask] >> 8, p[ask] & 255), _NAMES)
        for d, t, first, n in ranges:
            if len(d):
                none = pa.nulls(len(d), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *map(pa.array, (d, t, first, n))], names=list(_NAMES))
    if last is not None and last[1]:
        a, c, d, t, p = (int(x) for x in last[0])
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, (a, c, d, t, p >> 8, p & 255)))])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1, write_checksum=False)
    for batch in batches:
        raws = [t.as_py().encode() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_tie(r) for r in raws], pa.int64()), pa.array([pack.compress(r) for r in raws], pa.binary())], names=["doc", "tie", "body"])


def _cut(length: int):
    """(doc, tie, body, asks) -> the bytes of each stretch asked for."""

    def found(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            docs, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, size = [], 0
            for k, asks in enumerate(batch.column(3)):
                raw = unpack.decompress(batch.column(2)[k].as_py())
                for x in asks.as_py():
                    cut = raw[x["first"] : x["first"] + x["n"] + length - 1]
                    out.append((x["anchor"], x["part"], x["parts"], docs[k], ties[k], x["first"], cut))
                    size += len(cut)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["anchor", "part", "parts", "doc", "tie", "first", "bytes"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["anchor", "part", "parts", "doc", "tie", "first", "bytes"])

    return found


def repeats(unit: np.ndarray, doc: np.ndarray, tie: np.ndarray, first: np.ndarray, strings: list[bytes], length: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of collections of stretches (``unit`` ascends): the strings that stand earlier in their collection, and the others.

    Each as (stretch, offset in it) in order. The suffix array puts equal strings side by side.
    """
    codes, base, end, starts = laid_out(strings, unit)
    sa = suffix_array(codes, base, end)[1:]
    sizes = np.array([len(s) for s in strings])
    of = np.searchsorted(starts, sa, "right") - 1
    whole = starts[of] + sizes[of] - sa >= length
    at, of = sa[whole], of[whole]
    if not len(at):
        return (at, at), (at, at)
    windows = np.lib.stride_tricks.sliding_window_view(codes.astype(np.uint16), length)
    lead = np.ones(len(at), bool)
    for low in range(1, len(at), 1 << 16):
        part = windows[at[low - 1 : low + (1 << 16)]]
        lead[low : low + (1 << 16)] = (part[1:] != part[:-1]).any(axis=1)
    lead[1:] |= unit[of[1:]] != unit[of[:-1]]
    nth = np.empty(len(strings), np.int64)  # a string stands once in a stretch, so the stretches' order is the strings'
    nth[np.lexsort((first, tie, doc))] = np.arange(len(strings))
    run = np.cumsum(lead) - 1
    least = np.minimum.reduceat(nth[of], np.flatnonzero(lead))[run]
    later = nth[of] != least
    order = np.lexsort((at, of))
    at, of, later = at[order], of[order], later[order]
    offset = at - starts[of]
    return (of[later], offset[later]), (of[~later], offset[~later])


def _ordered(length: int, hold: int):
    """Stretches sorted by (anchor, part) -> ranges that are repeats (anchor null), and of anchors in several parts the distinct strings (n 0)."""

    def of_units(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchor, part, parts, doc, tie, first = (np.array(c, np.int64) for c in list(zip(*held))[:6])
        strings = [h[6] for h in held]
        unit = np.cumsum(np.r_[0, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
        (k, offset), (k1, offset1) = repeats(unit, doc, tie, first, strings, length)
        k, offset, n = _joined(k, first[k] + offset, np.ones(len(k), np.int64))
        if len(k):
            none = pa.nulls(len(k), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *map(pa.array, (doc[k], tie[k], offset, n))], names=list(_NAMES))
        split = parts[k1] > 1
        k1, offset1 = k1[split], offset1[split]
        digest = xxhash.xxh3_64_intdigest
        content = _signed(np.array([digest(strings[i][o : o + length]) for i, o in zip(k1.tolist(), offset1.tolist())], np.uint64))
        yield from _batches((anchor[k1], content, doc[k1], tie[k1], first[k1] + offset1, np.zeros(len(k1), np.int64)), _NAMES)

    def found(batches):
        held, size, key = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= hold and row[:2] != key:
                    yield from of_units(held)
                    held, size = [], 0
                key = row[:2]
                held.append(row)
                size += len(row[6]) + 2
        if held:
            yield from of_units(held)

    return found


def _kept(length: int, names: list[str]):
    """(doc, tie, body, nth, spans) -> what of a document is removed and what stays."""
    span = pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())])

    def found(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for doc, body, nth, ranges in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4)):
                raw = unpack.decompress(body.as_py())
                spans = []
                if nth > 1:  # the row's repeat
                    spans = [(0, len(raw))] if len(raw) >= length else []
                elif ranges.is_valid and len(ranges):
                    values = ranges.values
                    low, n = values.field(0).to_numpy(), values.field(1).to_numpy()
                    order = np.argsort(low, kind="stable")
                    low, high = low[order], np.maximum.accumulate((low + n + length - 1)[order])
                    head = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
                    spans = list(zip(low[head].tolist(), high[np.r_[head[1:] - 1, len(high) - 1]].tolist()))
                edges = [0, *(x for s in spans for x in s), len(raw)]
                out.append((None if doc == _NO_ID else doc, len(raw), [{"start": s, "end": e} for s, e in spans], b"".join(raw[edges[x] : edges[x + 1]] for x in range(0, len(edges), 2))))
            c = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.list_(span)), pa.array(c[3], pa.binary())], names=names)

    return found


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 100, strings_a_part: int = 32, hold: int = 1 << 20) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of the maximal removed runs of bytes) and kept (the other bytes) of each document.

    A byte goes if a string of ``length`` bytes that covers it stands earlier
    too: in a document of smaller doc_id, or earlier in its own. Strings are of
    the UTF-8 bytes of whole texts and never cross documents. Null texts count as empty; a
    null doc_id as smaller than all others; of texts with one doc_id that with the smaller hash
    is earlier; of equal rows one is the first and the others go whole. An empty
    table stays empty. Other columns of ``docs`` are not looked at. Very long
    texts are hashed a block at a time; common strings meet as one row for each task that read
    them, and an anchor's stretches in parts of about ``strings_a_part``.
    """
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    seen = texts.mapInArrow(_occurrences(length), _OCC)
    known = written(spark, seen.repartition("anchor").sortWithinPartitions("anchor", "content", "doc", "tie", "place").mapInArrow(_resolve, _KNOWN), "repeats")

    asks = known.where("anchor IS NOT NULL")
    # A common anchor's stretches are dealt to 16 tasks before they learn how many there are.
    salted = asks.withColumn("salt", F.pmod("content", F.lit(16)).cast("int"))
    many = asks.groupBy("anchor").agg(F.ceil(F.count("*") / strings_a_part).alias("parts")).where("parts > 1")
    asks = salted.join(many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), ["anchor", "salt"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    asks = asks.withColumn("part", F.pmod("content", "parts")).groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "part", "parts", "first", "n")).alias("asks"))
    bodies = texts.mapInArrow(_packed, "doc long, tie long, body binary")
    cut = bodies.dropDuplicates(["doc", "tie"]).join(asks, ["doc", "tie"]).select("doc", "tie", "body", "asks").mapInArrow(_cut(length), "anchor long, part long, parts long, doc long, tie long, first long, bytes binary")
    told = cut.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_ordered(length, hold), _KNOWN)
    told = written(spark, told, "ordered")
    of_string = Window.partitionBy("anchor", "content").orderBy("doc", "tie", "first")
    apart = told.where("anchor IS NOT NULL").withColumn("nth", F.row_number().over(of_string)).where("nth > 1")

    spans = known.where("anchor IS NULL").select("doc", "tie", "first", "n")
    spans = spans.unionByName(told.where("anchor IS NULL").select("doc", "tie", "first", "n")).unionByName(apart.select("doc", "tie", "first", F.lit(1).cast("long").alias("n")))
    spans = spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    rows = bodies.withColumn("nth", F.row_number().over(Window.partitionBy("doc", "tie").orderBy("doc"))).join(spans, ["doc", "tie"], "left")
    return rows.select("doc", "tie", "body", "nth", "spans").mapInArrow(_kept(length, ["doc_id", "n_bytes", "spans", "kept"]), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def report(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
