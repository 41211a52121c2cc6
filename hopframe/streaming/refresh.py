"""Cached tables that are read again after a time to live.

A service that answers many traversals over the same edge tables keeps them in executor memory.
A table older than ``seconds`` is dropped from the cache and read again, so new files show.
Nothing is cached whose size on storage, as the planner knows it, exceeds ``most_bytes``.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame


class FreshTables:
    def __init__(self, read: Callable[[str, str | None], DataFrame], seconds: float = 30, most_bytes: int = 8 << 30, clock: Callable[[], float] = time.monotonic):
        self._read, self.seconds, self.most_bytes, self.clock = read, seconds, most_bytes, clock
        self._kept: dict[tuple, tuple[float, DataFrame]] = {}

    def read(self, table: str, datasource: str | None = None) -> DataFrame:
        key, now = (table, datasource), self.clock()
        if key in self._kept and now - self._kept[key][0] < self.seconds:
            return self._kept[key][1]
        self.drop(*key)
        df = self._read(table, datasource)
        if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= self.most_bytes:
            df = df.cache()
        self._kept[key] = (now, df)
        return df

    def drop(self, table: str, datasource: str | None = None) -> None:
        if (table, datasource) in self._kept:
            self._kept.pop((table, datasource))[1].unpersist()
