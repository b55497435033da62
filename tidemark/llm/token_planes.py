"""Token ids on disk: fixed-size blocks of ids, transposed to bit or byte planes, each plane compressed.

A file holds the documents of one range of doc_id, in ascending order::

    magic | chunk | chunk | ... | chunk index | document index | footer

A chunk is one block of ``block`` ids (the last may be shorter), its planes
compressed by zstandard one by one. The chunk index has each chunk's place,
number of ids, CRC and plane lengths; the document index has each document's
id and number of ids. The footer, of fixed size, says where the indexes are.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import open_fs, shared_dir, small_batches
from tidemark.llm.tokenize import encoder, release

MAGIC = b"TMPLANE1"
_FOOTER = struct.Struct("<QQQII8s")


@dataclass(frozen=True)
class Layout:
    """``plane``: "byte" or "bit"; ``width``: bytes of an id (0: as many as the vocabulary needs); ``block``: ids of a chunk."""

    plane: str = "byte"
    width: int = 0
    block: int = 1 << 16
    level: int = 3


def to_planes(ids: np.ndarray, layout: Layout) -> list[bytes]:
    """The planes of a block, lowest first. Their number follows from the layout alone."""
    as_bytes = np.ascontiguousarray(ids, dtype=f"<u{layout.width}").view(np.uint8).reshape(-1, layout.width)
    if layout.plane == "byte":
        return [as_bytes[:, k].tobytes() for k in range(layout.width)]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * layout.width)]


def from_planes(planes: list[bytes], n: int, layout: Layout) -> np.ndarray:
    if layout.plane == "byte":
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view(f"<u{layout.width}").reshape(-1)


class PlaneWriter:
    """Writes one file, chunk by chunk: it holds a block of ids and the indexes."""

    def __init__(self, out, layout: Layout):
        if layout.width not in (1, 2, 4, 8):
            raise ValueError("the layout's width must be 1, 2, 4 or 8 bytes")
        self.out, self.layout = out, layout
        self.zip = zstandard.ZstdCompressor(level=layout.level)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.place = out.write(MAGIC)
        self.chunks: list[list[int]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and (int(ids.max()) >> 8 * self.layout.width or int(ids.min()) < 0):
            raise ValueError(f"an id does not fit {self.layout.width} bytes")
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        while self.n_held >= self.layout.block:
            self._chunk(self.layout.block)

    def _chunk(self, n: int) -> None:
        every = np.concatenate(self.held)
        block, rest = every[:n], every[n:]
        self.held, self.n_held = [rest], len(rest)
        planes = [self.zip.compress(p) for p in to_planes(block, self.layout)]
        raw = block.astype(f"<u{self.layout.width}").tobytes()
        self.chunks.append([self.place, n, zlib.crc32(raw), *map(len, planes)])
        self.place += self.out.write(b"".join(planes))

    def close(self) -> None:
        if self.n_held:
            self._chunk(self.n_held)
        index = np.array(self.chunks, dtype="<u8").tobytes()
        null = np.array([d is None for d in self.doc_ids], dtype=np.uint8).tobytes()
        docs = np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes() + np.array(self.lengths, dtype="<u8").tobytes() + null
        head = json.dumps({"plane": self.layout.plane, "width": self.layout.width, "block": self.layout.block, "chunks": len(self.chunks), "docs": len(self.doc_ids)}).encode()
        tail = self.zip.compress(index) , self.zip.compress(docs)
        self.out.write(tail[0] + tail[1] + head)
        self.out.write(_FOOTER.pack(self.place, len(tail[0]), len(tail[1]), len(head), zlib.crc32(tail[0] + tail[1] + head), MAGIC))


class PlaneReader:
    """Reads a file written by PlaneWriter: checks it, then gives documents or any chunk by itself."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        if size < _FOOTER.size + len(MAGIC):
            raise ValueError("not a plane file: too short")
        place, n_index, n_docs, n_head, crc, magic = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC or self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError("not a plane file: wrong magic bytes")
        tail = self._at(place, n_index + n_docs + n_head)
        if zlib.crc32(tail) != crc:
            raise ValueError("damaged index")
        head = json.loads(tail[n_index + n_docs :])
        self.layout = Layout(head["plane"], head["width"], head["block"])
        self.unzip = zstandard.ZstdDecompressor()
        planes = head["width"] * (1 if head["plane"] == "byte" else 8)
        self.chunks = np.frombuffer(self.unzip.decompress(tail[:n_index]), "<u8").reshape(head["chunks"], 3 + planes) if head["chunks"] else np.zeros((0, 3 + planes), "<u8")
        docs, n = self.unzip.decompress(tail[n_index : n_index + n_docs]), head["docs"]
        self.lengths = np.frombuffer(docs, "<u8", n, 8 * n).astype(np.int64)
        self.doc_ids = [None if null else d for d, null in zip(np.frombuffer(docs, "<i8", n).tolist(), docs[16 * n :])]

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def chunk(self, k: int) -> np.ndarray:
        place, n, crc, *lengths = self.chunks[k].tolist()
        raw, planes, at = self._at(place, sum(lengths)), [], 0
        for m in lengths:
            planes.append(self.unzip.decompress(raw[at : at + m]))
            at += m
        ids = from_planes(planes, n, self.layout)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"damaged chunk {k}")
        return ids

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Each document's id and ids, one chunk at a time in memory besides the document itself."""
        held, k = np.zeros(0, f"<u{self.layout.width}"), 0
        for doc_id, n in zip(self.doc_ids, self.lengths.tolist()):
            more = [held]
            have = len(held)
            while have < n:
                more.append(self.chunk(k))
                have += len(more[-1])
                k += 1
            every = np.concatenate(more) if len(more) > 1 else held
            yield doc_id, every[:n]
            held = every[n:]


_SHARD = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_planes(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str, spaced: bool, end_id: int, layout: Layout = Layout()) -> DataFrame:
    """Encodes whole texts and writes plane files to ``folder`` in ascending doc_id order.

    Nulls: a null text is an empty one; null doc_ids come first. Equal doc_ids
    are ordered by text, equal rows all stay. An empty table gives no file.
    Very long texts are encoded a piece at a time; extra columns are not read.
    Strings of special tokens give their ids, as in the library's plain call.
    Files are moved to their final name when complete, so a task that runs
    twice leaves the same file. Returns the manifest: shard, path, n_docs,
    n_ids and start (ids of all documents before the shard).
    """
    small_batches(spark)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = docs.select("doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def write(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        name = f"{folder}/shard-{shard:06d}.planes"
        fs, path = open_fs(name)
        writer = part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                out = fs.open_output_stream(part, compression=None)
                enc = encoder(vocabulary, spaced)
                writer = PlaneWriter(out, replace(layout, width=layout.width or enc.dtype.itemsize))
                end = np.array([end_id], enc.dtype)
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_each(batch.column(1))):
                writer.add(doc_id, np.append(ids, end))
        release()
        if writer is not None:
            writer.close()
            out.close()
            fs.move(part, path)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": name, "n_docs": len(writer.doc_ids), "n_ids": writer.n_ids}], schema=_SHARD)

    shards = sorted(ordered.mapInArrow(write, "shard long, path string, n_docs long, n_ids long").collect())  # a row for each file
    start, rows = 0, []
    for s in shards:
        rows.append((s.shard, s.path, s.n_docs, s.n_ids, start))
        start += s.n_ids
    return spark.createDataFrame(rows, "shard long, path string, n_docs long, n_ids long, start long")


def read_planes(spark: SparkSession, manifest: DataFrame, with_ids: bool = True, ids_per_task: int = 1 << 24) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids.

    A task reads files one after another, of about ``ids_per_task`` ids in all;
    it holds a chunk and a document at a time.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                fs, p = open_fs(path)
                with fs.open_input_file(p) as source:
                    rows, held = [], 0
                    for doc_id, ids in PlaneReader(source).documents():
                        row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                        start += len(ids)
                        held += 1 + len(ids) // 64 * with_ids
                        if held >= 4096:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                    yield _batch(rows, schema)

    total = manifest.agg(F.sum("n_ids")).first()[0] or 0
    return manifest.select("shard", "path", "start").repartitionByRange(max(-(-total // ids_per_task), 1), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, schema)], schema=schema)
