"""Dimension tables: snapshots that are loaded anew after a time."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Dimension:
    """``current()`` gives the snapshot, loaded again once it is older than ``refresh_s``.

    A failed reload keeps the old snapshot and is tried again after ``retry_s``; the first load must work. Call it once
    per micro-batch (in ``for_each_batch``), so that a batch sees one snapshot.
    """

    def __init__(self, load: Callable[[], DataFrame], refresh_s: float = 600, retry_s: float = 10, clock: Callable[[], float] = time.monotonic):
        self._load, self._refresh, self._retry, self._clock = load, refresh_s, retry_s, clock
        self._snapshot: DataFrame | None = None
        self._next = 0.0
        self.failures = 0

    def current(self) -> DataFrame:
        now = self._clock()
        if self._snapshot is None or now >= self._next:
            try:
                fresh = self._load().persist()
                old, self._snapshot = self._snapshot, fresh
                self._next = now + self._refresh
                if old is not None:
                    old.unpersist()
            except Exception:
                if self._snapshot is None:
                    raise
                self.failures += 1
                self._next = now + self._retry
        return self._snapshot

    def rows(self, **keys) -> DataFrame:
        """Rows of the given key values; null finds null."""
        df = self.current()
        for k, v in keys.items():
            df = df.filter(F.col(k).eqNullSafe(F.lit(v)))
        return df

    def row(self, **keys):
        """One row of the given key values, or None."""
        got = self.rows(**keys).take(1)
        return got[0] if got else None
