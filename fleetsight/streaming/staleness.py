"""Sources that fall silent, as a stream (A10).

A source that stops sending produces no row that a query could react to, so
each source holds an event-time timer: every newer reading moves it to
``max_age`` after that reading, and when the watermark passes it the source is
reported as stale. A source that sends again is reported as resumed. Sources
that are to be watched from the start (the monitored list) come in as initial
state, so one that never sends anything is reported too.

State is one time per source in the state store (RocksDB, checkpointed with
the stream): a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Changes reported.
STALE, RESUMED = "stale", "resumed"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class _Silence(StatefulProcessor):
    def __init__(self, source_col: str, ts_col: str, max_age_ms: int):
        self.source_col, self.ts_col, self.max_age_ms = source_col, ts_col, max_age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # newest reading, the timer that watches it (0: it has fired)
        self.last = handle.getValueState("last", "ts timestamp, timer bigint")

    def _watch(self, ts) -> None:
        if self.last.exists():
            old = self.last.get()[1]
            if old:
                self.handle.deleteTimer(old)
        due = _ms(ts) + self.max_age_ms + 1          # the first millisecond at which the reading is too old
        self.handle.registerTimer(due)
        self.last.update((pd.Timestamp(ts).to_pydatetime(), due))

    def _row(self, key, ts, change: str) -> pd.DataFrame:
        return pd.DataFrame({self.source_col: [key[0]], "last_data_collection": [pd.Timestamp(ts)], "change": [change]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = None
        for part in rows:                            # one batch of rows at a time: only the newest time is kept
            top = part[self.ts_col].max()
            if not pd.isna(top) and (newest is None or top > newest):
                newest = top
        if newest is None:
            return
        known = self.last.get() if self.last.exists() else None
        if known is not None and pd.Timestamp(known[0]) >= newest:
            return                                   # a late reading changes nothing
        fired = known is not None and not known[1]
        if fired and _ms(newest) + self.max_age_ms < timerValues.getCurrentWatermarkInMs():
            self.last.update((newest.to_pydatetime(), 0))        # newer, but too old as well: still stale
            return
        self._watch(newest)
        if fired:
            yield self._row(key, newest, RESUMED)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ts, due = self.last.get()
        if due != expiredTimerInfo.getExpiryTimeInMs():
            return                                   # an older timer of this source
        self.last.update((ts, 0))
        yield self._row(key, ts, STALE)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues) -> None:
        self._watch(initialState[self.ts_col].max())

    def close(self) -> None:
        pass


def stale_sources_stream(stream: DataFrame, source_col: str, ts_col: str, max_age_hours: float = 3.0,
                         delay: str = "0 seconds", monitored: DataFrame | None = None, since=None) -> DataFrame:
    """(source, last_data_collection, change): a row whenever a source becomes stale or sends again.

    A source is stale when its newest reading is older than ``max_age_hours``
    at the watermark (the newest time seen of any source, less ``delay``); the
    sources whose last row says so are those that the batch form
    (:func:`fleetsight.operators.snapshot.stale_sources`) gives for that time.
    ``monitored`` (a one-column DataFrame) names sources to watch from
    ``since`` on although they may never send; other sources are then left out.
    The stream is append-only; it runs with the RocksDB state store, which
    this function sets for the session.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = stream.schema[source_col].dataType.simpleString()
    rows = stream.select(source_col, F.col(ts_col).cast("timestamp").alias(ts_col)).where(F.col(source_col).isNotNull())
    initial = None
    if monitored is not None:
        names = monitored.select(F.col(monitored.columns[0]).cast(kind).alias(source_col)).where(
            F.col(source_col).isNotNull()).distinct()
        rows = rows.join(names, source_col, "left_semi")
        start = since if isinstance(since, Column) else F.lit(since)
        initial = names.select(source_col, start.cast("timestamp").alias(ts_col)).groupBy(source_col)
    return rows.withWatermark(ts_col, delay).groupBy(source_col).transformWithStateInPandas(
        statefulProcessor=_Silence(source_col, ts_col, round(max_age_hours * 3_600_000)),
        outputStructType=f"`{source_col}` {kind}, last_data_collection timestamp, change string",
        outputMode="Append", timeMode="EventTime", initialState=initial)
