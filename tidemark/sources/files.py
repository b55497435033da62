"""Files as rows: written by tasks to shared storage, read whole with name, size, hash and what their first and last bytes tell."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

# How a PDF file begins and ends, and how far from its ends that may be.
PDF_HEADER, PDF_END, PDF_REACH = "%PDF-", "%%EOF", 1024


def write_files(rows: DataFrame, root: str) -> int:
    """A file for each row (name, content: binary) below ``root``; returns how many. A file takes its place by a move, so a repeated task replaces its own."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = pafs.FileSystem.from_uri(root)
        attempt, n = TaskContext.get().taskAttemptId(), 0
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not name or "/" in name or name.startswith("."):
                    raise ValueError(f"not a file name: {name!r}")
                part = f"{base}/.{name}.{attempt}"
                with fs.open_output_stream(part) as out:
                    out.write(content or b"")
                fs.move(part, f"{base}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.select("name", "content").mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0


def scan(spark: SparkSession, root: str, names: str = "*") -> DataFrame:
    """name, size, sha256, content of the files below ``root`` whose names match; columns that aren't used aren't read. Spark lists no files of 0 bytes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(root)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")


def pdf_uploads(files: DataFrame, existing: DataFrame | None = None, most_bytes: int = 50 << 20) -> DataFrame:
    """name, size, sha256, state of scanned files: not_pdf by name, empty, too_large, no_header, truncated, conflict (the content is there already, or under an earlier name), else registered.

    ``existing`` has sha256. A header may stand in the first ``PDF_REACH`` bytes, the end mark in the last.
    """
    raw = lambda c: F.decode(c, "ISO-8859-1")
    head, tail = raw(F.substring("content", 1, PDF_REACH)), raw(F.substring("content", -PDF_REACH, PDF_REACH))
    own = (
        F.when(~F.lower("name").endswith(".pdf"), "not_pdf").when(F.col("size") == 0, "empty").when(F.col("size") > most_bytes, "too_large")
        .when(~F.contains(head, F.lit(PDF_HEADER)), "no_header").when(~F.contains(tail, F.lit(PDF_END)), "truncated"))
    told = files.select("name", "size", "sha256", own.alias("own"))
    first = told.where("own IS NULL").groupBy("sha256").agg(F.min("name").alias("first"))
    if existing is not None:
        first = first.join(existing.select("sha256").distinct().withColumn("old", F.lit(True)), "sha256", "left")
    else:
        first = first.withColumn("old", F.lit(None).cast("boolean"))
    state = F.coalesce("own", F.when(F.coalesce("old", F.lit(False)) | (F.col("first") != F.col("name")), "conflict").otherwise("registered"))
    return told.join(first, "sha256", "left").select("name", "size", "sha256", state.alias("state"))


def canonical(files: DataFrame) -> DataFrame:
    """name, sha256, document_id, pages, blocks, problem of canonical.json files: the hash is of the bytes, problem is invalid (no JSON object of that shape), no_document or null."""
    shape = "document_id string, pages array<struct<page_number:int,blocks:array<struct<block_id:string,type:string>>>>, _broken string"
    doc = F.from_json(F.decode("content", "UTF-8"), shape, {"columnNameOfCorruptRecord": "_broken"})
    told = files.select("name", "sha256", doc.alias("d"))
    problem = F.when(F.col("d").isNull() | F.col("d._broken").isNotNull() | F.col("d.pages").isNull(), "invalid").when(F.col("d.document_id").isNull(), "no_document")
    blocks = F.aggregate(F.col("d.pages"), F.lit(0), lambda n, p: n + F.coalesce(F.size(p["blocks"]), F.lit(0)))
    return told.select("name", "sha256", problem.alias("problem"), F.col("d.document_id").alias("document_id"), F.size("d.pages").alias("pages"), blocks.alias("blocks")).select(
        "name", "sha256", *[F.when(F.col("problem").isNull(), F.col(c)).alias(c) for c in ("document_id", "pages", "blocks")], "problem")
