"""Keyed tables in buckets: replacement rewrites the buckets it touches, a version is a list of bucket folders.

A version's manifest names, for each bucket, the folder that holds it and its
rows. A change writes new folders for the touched buckets alone, reads them back,
writes a manifest and then moves the pointer by one rename. So readers see the
old version or the new one, a version is brought back by moving the pointer,
and what a lost writer left is told by its pending record and dropped.

    root/pending.json          version and base of a change under way; there is one at a time
    root/data/<version>/bucket=<b>/...
    root/manifests/<version>.json
    root/active.json           the pointer
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.sources.sinks import CommitError, _fs, active, point

#: Where a change can be lost, in order; a hook gets the name of each as it is passed.
POINTS = ("pending", "data", "manifest", "pointer")


class KeyedTable:
    """Rows of one schema, dealt to ``buckets`` by a hash of ``key`` (null keys to one of them). The manifest has one entry for each bucket, so its size is bounded."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, key: str, buckets: int = 64, passed: Callable[[str], None] | None = None):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root, schema, key, buckets
        self.passed = passed or (lambda _: None)

    # ---- files

    def _write(self, name: str, content: dict, fresh: bool = False) -> None:
        fs, path = _fs(self.spark, f"{self.root}/{name}")
        out = fs.create(path, not fresh)  # fresh: an error if it is there
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()

    def _read(self, name: str) -> dict | None:
        fs, path = _fs(self.spark, f"{self.root}/{name}")
        return json.loads(self.spark.read.text(f"{self.root}/{name}", wholetext=True).first()[0]) if fs.exists(path) else None

    def _drop(self, name: str) -> bool:
        fs, path = _fs(self.spark, f"{self.root}/{name}")
        return fs.delete(path, True)

    # ---- reading

    def version(self) -> str | None:
        pointer = active(self.spark, self.root)
        return pointer and pointer["generation"]

    def manifest(self, version: str | None) -> dict[str, dict]:
        """bucket -> folder, rows of a version; of none an empty table's."""
        if version is None:
            return {}
        found = self._read(f"manifests/{version}.json")
        if found is None:
            raise CommitError(f"no version {version}")
        return found["buckets"]

    def _rows_of(self, entries: dict[str, dict]) -> DataFrame:
        folders = [f"{self.root}/data/{e['version']}/bucket={b}" for b, e in sorted(entries.items()) if e["rows"]]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: str | None = None) -> DataFrame:
        """The rows of the active version, or of another one that is still there."""
        return self._rows_of(self.manifest(version or self.version()))

    # ---- changes

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _change(self, touched: list[int], make: Callable[[DataFrame], DataFrame]) -> str:
        """A version in which the touched buckets hold what ``make`` makes of their rows. A failure leaves the old version in place."""
        base, version = self.version(), uuid.uuid4().hex
        try:
            self._write("pending.json", {"version": version, "base": base}, fresh=True)
        except Exception as e:
            raise CommitError("another change is under way or was lost: recover first") from e
        self.passed("pending")
        entries = self.manifest(base)
        old = self._rows_of({b: e for b, e in entries.items() if int(b) in set(touched)})
        new = make(old).select(self.schema.names).withColumn("bucket", self._bucket(self.key))
        place = f"{self.root}/data/{version}"
        new.repartition("bucket").write.partitionBy("bucket").parquet(place)
        self.passed("data")
        counts = lambda df: {r["bucket"]: r["count"] for r in df.groupBy("bucket").count().collect()}  # noqa: E731  (a row for each bucket)
        rows = counts(self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(place))
        meant = counts(new)
        if rows != meant or not set(rows) <= set(touched):
            raise CommitError(f"{sum(rows.values())} rows of {sum(meant.values())} were written, or some outside the change's buckets")
        fresh = {str(b): {"version": version, "rows": rows.get(b, 0)} for b in touched}
        self._write(f"manifests/{version}.json", {"base": base, "buckets": entries | fresh})
        self.passed("manifest")
        self._point(version)
        self.passed("pointer")
        self._drop("pending.json")
        return version

    def _point(self, version: str) -> None:
        point(self.spark, self.root, {"generation": version, "rows": sum(e["rows"] for e in self.manifest(version).values())})

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket(self.key)).distinct().collect())  # ``buckets`` numbers at most

    def create(self, rows: DataFrame) -> str:
        return self._change(list(range(self.buckets)), lambda _: rows)

    def replace(self, rows: DataFrame) -> str:
        """All rows of the keys that ``rows`` has give way to those of ``rows``; stale ones go with them."""
        keys = rows.select(self.key).distinct()
        return self._change(self._touched(keys), lambda old: self._without(old, keys).unionByName(rows.select(self.schema.names)))

    def delete(self, keys: DataFrame) -> str:
        """Rows of these keys go; keys that are not there change nothing."""
        known = keys.select(self.key).distinct()
        return self._change(self._touched(known), lambda old: self._without(old, known))

    def update(self, keys: DataFrame, **columns: Column) -> str:
        """The given columns of the rows of these keys, worked out anew."""
        known = keys.select(self.key).distinct()

        def make(old: DataFrame) -> DataFrame:
            marked = old.join(known.select(F.col(self.key).alias("_k"), F.lit(True).alias("_hit")), F.col(self.key).eqNullSafe(F.col("_k")), "left")
            return marked.withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in columns.items()})

        return self._change(self._touched(known), make)

    def _without(self, old: DataFrame, keys: DataFrame) -> DataFrame:
        other = keys.select(F.col(self.key).alias("_k"))
        return old.join(other, F.col(self.key).eqNullSafe(F.col("_k")), "left_anti")

    def restore(self, version: str) -> None:
        """Brings a version back as it was: the pointer moves, nothing is written anew."""
        self.manifest(version)
        self._point(version)

    def restore_columns(self, version: str, keys: DataFrame, row: str, *columns: str) -> str:
        """The columns that rows (``row`` tells them within their key) of these keys had in ``version``; others stay as they are. A row that is gone since is an error."""
        known = keys.select(self.key).distinct()
        touched = self._touched(known)
        then = self._rows_of({b: e for b, e in self.manifest(version).items() if int(b) in set(touched)}).join(known, self.key, "left_semi").select(F.col(self.key).alias("_k"), F.col(row).alias("_r"), *[F.col(c).alias(f"_{c}") for c in columns])
        now = self.read().select(F.col(self.key).alias("_k"), F.col(row).alias("_r"))
        if not then.join(now, ["_k", "_r"], "left_anti").isEmpty():
            raise CommitError("rows of the snapshot are gone")

        def make(old: DataFrame) -> DataFrame:
            both = old.join(then.withColumn("_hit", F.lit(True)), (F.col(self.key) == F.col("_k")) & (F.col(row) == F.col("_r")), "left")
            return both.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns})

        return self._change(touched, make)

    # ---- after a loss

    def recover(self) -> str | None:
        """Puts an end to a change that was lost: ``kept`` if its pointer was moved already, ``dropped`` if not (what it wrote goes), None if there was none."""
        pending = self._read("pending.json")
        if pending is None:
            return None
        kept = self.version() == pending["version"]
        if not kept:
            self._drop(f"manifests/{pending['version']}.json")
            self._drop(f"data/{pending['version']}")
        self._drop("pending.json")
        return "kept" if kept else "dropped"

    def prune(self, keep: list[str] = ()) -> int:
        """Drops versions but the active one and those to ``keep``, and folders of data that none of these names; returns how many folders."""
        wanted = {v for v in (self.version(), *keep) if v}
        named = {e["version"] for v in wanted for e in self.manifest(v).values()}
        dropped = 0
        for what, stays in (("manifests", {f"{v}.json" for v in wanted}), ("data", named)):
            fs, path = _fs(self.spark, f"{self.root}/{what}")
            for status in fs.listStatus(path):
                if (name := status.getPath().getName()) not in stays and not name.startswith("."):
                    fs.delete(status.getPath(), True)
                    dropped += what == "data"
        return dropped
