"""A cache of retrieval results on the driver, bounded in entries, rows and time."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class ResultCache:
    """Keeps results of up to ``most_rows`` rows for ``ttl`` seconds, empty ones for ``empty_ttl``; the least recently used of over ``most_entries`` goes.

    A larger result is not kept but worked out anew by its plan, so nothing is cut.
    """

    def __init__(self, most_entries: int = 256, ttl: float = 300, empty_ttl: float = 60, most_rows: int = 1_000, clock: Callable[[], float] = time.monotonic):
        if most_entries < 1:
            raise ValueError("a cache holds one entry at least")
        self.most_entries, self.ttl, self.empty_ttl, self.most_rows, self.clock = most_entries, ttl, empty_ttl, most_rows, clock
        self.hits = self.misses = 0
        self._held: OrderedDict[str, tuple[float, list, StructType]] = OrderedDict()
        self._lock = threading.Lock()

    def _fresh(self, key: str) -> tuple[list, StructType] | None:
        with self._lock:
            if (entry := self._held.get(key)) is None or entry[0] <= self.clock():
                self._held.pop(key, None)
                return None
            self._held.move_to_end(key)
            return entry[1:]

    def _keep(self, key: str, rows: list, schema: StructType) -> None:
        if (lasts := self.ttl if rows else self.empty_ttl) <= 0:
            return
        with self._lock:
            self._held[key] = (self.clock() + lasts, rows, schema)
            self._held.move_to_end(key)
            while len(self._held) > self.most_entries:
                self._held.popitem(last=False)

    def result(self, spark: SparkSession, key: str | None, build: Callable[[], DataFrame]) -> DataFrame:
        """The result of ``build()``, which is not called if the cache has it; a null key is not kept."""
        if key is None:
            return build()
        if (entry := self._fresh(key)) is not None:
            self.hits += 1
            return spark.createDataFrame(*entry)
        self.misses += 1
        df = build()
        rows = df.limit(self.most_rows + 1).collect()
        if len(rows) > self.most_rows:
            return df
        self._keep(key, rows, df.schema)
        return spark.createDataFrame(rows, df.schema)
