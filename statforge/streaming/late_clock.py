"""Late-clock shots from a stream (EVT-01, EVT-02): rows in event order, state that ends.

A game's rows wait until the watermark has passed them, so that rows of later micro-batches that belong between
them find their place; rows behind the watermark are dropped. State lies in RocksDB, and goes when a game has been
idle: by an event-time timer, or by the time to live of its values where processing time rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.possession import SHOTS, TYPES

RESETS = ("Rebound", "Turnover", "Made Shot")
SHOT = "gameid string, eventnum long, team string, player string, event_type string, elapsed double"
_COLUMNS = [c.split()[0] for c in SHOT.split(", ")]
_WAITING = "eventnum long, clock_seconds double, event_type string, team string, player string, at_ms long"
_STATE = "start double, last_ms long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State beyond memory, with timers and time to live; the session's setting when a query starts."""
    spark.conf.set(_PROVIDER, _ROCKSDB)


def advance(start: float | None, rows: list[tuple], keep_first_shot: bool) -> tuple[float | None, list[tuple]]:
    """A game's rows (eventnum, clock, kind, team, player) in order, from the clock at which the possession began."""
    out = []
    for number, clock, kind, team, player in rows:
        if kind in SHOTS:
            if start is None and keep_first_shot:
                start = clock
            out.append((number, team, player, kind, start - clock if start and clock else 0.0))
        if kind in RESETS:
            start = clock
    return start, out


def _plain(x):
    return None if x is None or pd.isna(x) else x


class Possessions(StatefulProcessor):
    """State of a game: the possession's start, the time of its last settled row, and the rows that wait."""

    def __init__(self, keep_first_shot: bool, idle_ms: int, ttl_ms: int | None):
        self.keep_first_shot, self.idle_ms, self.ttl_ms = keep_first_shot, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("possession", _STATE, ttlDurationMs=self.ttl_ms)
        self.waiting = handle.getListState("waiting", _WAITING, ttlDurationMs=self.ttl_ms)

    def _settle(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        """Rows (with their time at the end) that nothing can come before any more."""
        start, last = self.state.get() if self.state.exists() else (None, None)
        rows.sort(key=lambda r: (r[0] is not None, r[0]))
        start, shots = advance(_plain(start), [r[:5] for r in rows], self.keep_first_shot)
        self.state.update((start, max([r[5] for r in rows] + ([] if _plain(last) is None else [last]))))
        if shots:
            yield pd.DataFrame([(key[0], *s) for s in shots], columns=_COLUMNS)

    def _next_timer(self) -> None:
        """One timer: for the earliest row that waits, or for the end of an idle game."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        waiting = [r[5] for r in self.waiting.get()] if self.waiting.exists() else []
        if waiting:
            self.handle.registerTimer(int(min(waiting)))
        elif self.state.exists():
            self.handle.registerTimer(int(self.state.get()[1]) + self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = ["eventnum", "clock_seconds", "event_type", "team", "player", "at_ms"]
        found = [tuple(map(_plain, r)) for frame in rows for r in frame[columns].itertuples(index=False, name=None)]
        found = [(int(r[0]) if r[0] is not None else None, *r[1:5], int(r[5])) for r in found]
        if self.ttl_ms is not None:  # processing time: there is no watermark to wait for
            yield from self._settle(key, found)
            return
        self.waiting.appendList(found)
        self._next_timer()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(map(_plain, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        due, left = [r for r in waiting if r[5] <= passed], [r for r in waiting if r[5] > passed]
        if due:
            yield from self._settle(key, due)
            self.waiting.put(left) if left else self.waiting.clear()
        elif not left and self.state.exists() and self.state.get()[1] + self.idle_ms <= passed:
            self.state.clear()
        self._next_timer()

    def close(self) -> None:
        pass


def stream_shots(events: DataFrame, time_col: str = "ts", lateness: str = "10 minutes", keep_first_shot: bool = False, idle_ms: int = 6 * 3_600_000, ttl_ms: int | None = None) -> DataFrame:
    """Shots with elapsed time from a stream of events (gameid, eventnum, clock_seconds, event_type, team, player).

    Without ttl_ms time is that of time_col: a row is settled once the watermark, `lateness` behind the latest row,
    has passed it, in the order of event numbers among what has waited; state goes when the watermark is idle_ms
    beyond a game's last row. With ttl_ms rows are settled as they arrive, and state goes that long after its last
    change, whatever the rows' times. A null clock ends the state that it should set; a row without a time is dropped.
    Other columns are ignored. Sets the session's state store (use_rocksdb)."""
    use_rocksdb(events.sparkSession)
    timed = events if ttl_ms is not None else events.withWatermark(time_col, lateness)
    kept = timed.filter(F.col("event_type").isin(*TYPES) & F.col(time_col).isNotNull())
    kept = kept.select("gameid", F.col("eventnum").cast("long").alias("eventnum"), F.col("clock_seconds").cast("double").alias("clock_seconds"), "event_type", "team", "player", F.unix_millis(F.col(time_col).cast("timestamp")).alias("at_ms"), time_col)
    processor = Possessions(keep_first_shot, idle_ms, ttl_ms)
    return kept.groupBy("gameid").transformWithStateInPandas(processor, SHOT, "Append", "EventTime" if ttl_ms is None else "ProcessingTime")
