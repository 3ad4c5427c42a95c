"""Sessions of events: stretches of a key's events without a gap, in tables and in streams where events come late and out of order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "start timestamp, end timestamp, n long, total double"


def sessions(events: DataFrame, key: str, time: str, value: str, gap: str, delay: str | None = None) -> DataFrame:
    """key, start, end (a gap after the last event), n and total of every session; on a stream, with a delay, each once when it cannot grow any more."""
    rows = events.withWatermark(time, delay) if delay else events
    found = rows.where(F.col(key).isNotNull()).groupBy(key, F.session_window(time, gap).alias("_w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return found.select(key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "total")


class Sessions(StatefulProcessor):
    """Open sessions of a key, kept by their starts; a timer at each one's end gives it out.

    An event opens a session or joins those within a gap of it, two of which it may make one: order does not matter.
    """

    def __init__(self, key: str, time: str, value: str, gap_ms: int):
        self.key, self.time, self.value, self.gap = key, time, value, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start long", "last long, n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, value in zip(frame[self.time], frame[self.value], strict=True):
                self._take(int(pd.Timestamp(at).value // 1_000), None if pd.isna(value) else float(value))
        return iter([])

    def _take(self, at: int, value: float | None) -> None:
        """Times in microseconds. A missing value adds nothing."""
        gap = self.gap * 1_000
        first, last, n, total = at, at, 1, value or 0.0
        for (start,), (end, m, other) in list(self.open.iterator()):
            if start - gap < at < end + gap:
                self.open.removeKey((start,))
                self.handle.deleteTimer(self._due(end))
                first, last, n, total = min(first, start), max(last, end), n + m, total + other
        self.open.updateValue((first,), (last, n, total))
        self.handle.registerTimer(self._due(last))

    def _due(self, last: int) -> int:
        return last // 1_000 + self.gap + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (start,), (end, n, total) in list(self.open.iterator()):
            if self._due(end) <= now:
                self.open.removeKey((start,))
                out.append((key[0], pd.Timestamp(start * 1_000), pd.Timestamp((end + self.gap * 1_000) * 1_000), n, total))
        yield pd.DataFrame(out, columns=[self.key, "start", "end", "n", "total"])

    def close(self) -> None:
        pass


def session_stream(events: DataFrame, key: str, time: str, value: str, gap_seconds: float, delay: str) -> DataFrame:
    """sessions() of a stream by state and timers, one row a session as soon as the watermark is past its end; needs the RocksDB state store.

    Rows behind the watermark are not taken; late_rows() counts them.
    """
    kind = dict(events.dtypes)[key]
    rows = events.where(F.col(key).isNotNull()).select(key, time, F.col(value).cast("double").alias(value)).withWatermark(time, delay)
    return rows.groupBy(key).transformWithStateInPandas(Sessions(key, time, value, round(gap_seconds * 1_000)), f"`{key}` {kind}, {RESULT}", "Append", "EventTime")


def late_rows(query) -> int:
    """Rows that came behind the watermark of a query's state, over all its recent batches."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
