"""Tables of file databases (SQLite) as a Spark data source: one partition a file or row range, filters run by the database, read-only, with a time limit.

Files may be on any file system that executors reach; a task copies the one
it reads to its own scratch folder, as the database can only open local files.
"""

from __future__ import annotations

import os
import sqlite3
import tempfile
import time
from collections.abc import Iterator
from contextlib import closing, contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import BinaryType, BooleanType, DataType, DoubleType, LongType, StringType, StructType

_KINDS = {"INTEGER": LongType(), "REAL": DoubleType(), "TEXT": StringType(), "BLOB": BinaryType()}
_COMPARED = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{os.path.abspath(uri)}")


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@contextmanager
def opened(uri: str, seconds: float | None = None) -> Iterator[sqlite3.Connection]:
    """A read-only connection to a copy of the file; statements end with an error after ``seconds``."""
    fs, path = _fs(uri)
    with tempfile.TemporaryDirectory() as scratch:
        local = f"{scratch}/table.db"
        with fs.open_input_stream(path) as src, open(local, "wb") as out:
            while part := src.read(1 << 22):
                out.write(part)
        with closing(sqlite3.connect(f"file:{local}?mode=ro", uri=True)) as con:
            con.execute("PRAGMA query_only = ON")
            if seconds is not None:
                end = time.monotonic() + seconds
                con.set_progress_handler(lambda: time.monotonic() > end, 10_000)
            yield con


def condition(f: Filter) -> tuple[str, list] | None:
    """A filter as SQL and its values; None if the database would not decide it as Spark does."""
    if len(f.attribute) != 1:
        return None
    name = quoted(f.attribute[0])
    if isinstance(f, IsNull):
        return f"{name} IS NULL", []
    if isinstance(f, IsNotNull):
        return f"{name} IS NOT NULL", []
    if isinstance(f, In) and f.value and all(isinstance(v, (int, float, str)) for v in f.value):
        return f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if isinstance(f, StringStartsWith):
        return f"substr({name}, 1, ?) = ?", [len(f.value), f.value]
    if type(f) in _COMPARED and isinstance(f.value, (int, float, str)) and f.value == f.value:
        return f"{name} {_COMPARED[type(f)]} ?", [f.value]
    return None


class Slice(InputPartition):
    def __init__(self, uri: str, low: int | None = None, high: int | None = None):
        self.uri, self.low, self.high = uri, low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if (found := condition(f)) is None:
                yield f  # Spark's own work
            else:
                self.where.append(found)

    def partitions(self) -> list[Slice]:
        """A partition for each file; with ``rows`` for so many row ids of each."""
        step, out = int(self.options.get("rows", 0)), []
        for uri in files(self.options["path"]):
            if not step:
                out.append(Slice(uri))
                continue
            with opened(uri) as con:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.options['table'])}").fetchone()
            out += [Slice(uri, at, at + step) for at in range(low, high + 1, step)] if low is not None else []
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        where = list(self.where)
        if partition.low is not None:
            where.append(("rowid >= ? AND rowid < ?", [partition.low, partition.high]))
        sql = f"SELECT {', '.join(quoted(f.name) for f in self.schema)} FROM {quoted(self.options['table'])}"
        if where:
            sql += " WHERE " + " AND ".join(f"({w})" for w, _ in where)
        kinds = [pa.int64() if f.dataType == LongType() else pa.float64() if f.dataType == DoubleType() else pa.binary() if f.dataType == BinaryType() else pa.string() for f in self.schema]
        seconds = self.options.get("seconds")
        with opened(partition.uri, float(seconds) if seconds else None) as con:
            cursor = con.execute(sql, [v for _, values in where for v in values])
            while rows := cursor.fetchmany(4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=self.schema.names)


class FileDatabase(DataSource):
    """``spark.read.format("file_database")`` with options path (a folder of .db files, or one), table, seconds (limit of a statement), rows (row ids of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "file_database"

    def schema(self) -> StructType:
        """Columns as the first file declares them; what it has no type for is text."""
        found = files(self.options["path"])
        if not found:
            raise FileNotFoundError(self.options["path"])
        with opened(found[0]) as con:
            told = con.execute(f"SELECT name, upper(type) FROM pragma_table_info({_text(self.options['table'])})").fetchall()
        if not told:
            raise ValueError(f"no table {self.options['table']}")
        schema = StructType()
        for name, kind in told:
            schema = schema.add(name, _KINDS.get(kind, StringType()))
        return schema

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def files(path: str) -> list[str]:
    """URIs of the .db files of a folder, or of the one file."""
    fs, at = _fs(path)
    if fs.get_file_info(at).type == pafs.FileType.File:
        return [path]
    base = path.rstrip("/")
    return sorted(f"{base}/{i.base_name}" for i in fs.get_file_info(pafs.FileSelector(at)) if i.base_name.endswith(".db"))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session and lets it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FileDatabase)


def _kind(t: DataType) -> str:
    return "INTEGER" if t.typeName() in ("byte", "short", "integer", "long") or isinstance(t, BooleanType) else "REAL" if t.typeName() in ("float", "double") else "BLOB" if isinstance(t, BinaryType) else "TEXT"


def write(df: DataFrame, path: str, table: str) -> None:
    """A database file for each task, named by its partition; a repeated task writes the same file anew. Dates and decimals are text."""
    columns = [(f.name, _kind(f.dataType), f.dataType) for f in df.schema]
    flat = df.select(*[df[n].cast("string") if k == "TEXT" else df[n].cast("long") if k == "INTEGER" else df[n] for n, k, _ in columns])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, at = _fs(path)
        with tempfile.TemporaryDirectory() as scratch:
            with closing(sqlite3.connect(f"{scratch}/table.db")) as con:
                con.execute(f"CREATE TABLE {quoted(table)} ({', '.join(f'{quoted(n)} {k}' for n, k, _ in columns)})")
                n = 0
                for batch in batches:
                    con.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(columns))})", zip(*(c.to_pylist() for c in batch.columns)))
                    n += batch.num_rows
                con.commit()
            fs.create_dir(at, recursive=True)
            name = f"{at.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.db"
            with open(f"{scratch}/table.db", "rb") as src, fs.open_output_stream(f"{name}.{TaskContext.get().taskAttemptId()}") as out:
                while part := src.read(1 << 22):
                    out.write(part)
            fs.move(f"{name}.{TaskContext.get().taskAttemptId()}", name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["rows"])

    flat.mapInArrow(put, "rows long").collect()  # a number for each task
