"""Rounds of matches that are still being played, and activity in a stream of events.

Streams have columns match_id, seq, ts, tick and event_type, where seq rises with ts within a match. Rows that
come later than the watermark are dropped; within it they may come in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROUND_END = "round_end"
#: Keyed state with timers needs this store.
STORE_SETTING, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROW = "seq long, ts_ms long, tick long, event_type string"


class RoundAssembler(StatefulProcessor):
    """One match. Rows wait until the watermark has passed them, so that round ends are taken in order whatever
    order they come in. Each pair of an event and an end is then tested once: an event against the rounds that
    ended before it was taken, an end against the events that were. After idle_ms without a row the match is
    forgotten; what comes for it later begins a new one."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.events = handle.getListState("events", _ROW)
        self.ends = handle.getListState("ends", "round_number int, lo long, hi long")
        self.seen = handle.getValueState("seen", "ts_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            ms = df["ts_ms"]
            self.waiting.appendList(list(zip(df["seq"].tolist(), ms.tolist(), df["tick"].tolist(), df["event_type"].tolist(), strict=True)))
            latest = max(int(ms.max()), self.seen.get()[0] if self.seen.exists() else 0)
            self.seen.update((latest,))
            self.handle.registerTimer(int(ms.min()))
            self.handle.registerTimer(latest + self.idle_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((r for r in rows if r[1] <= now), key=lambda r: r[0])
        if ready:
            left = [r for r in rows if r[1] > now]
            if left:
                self.waiting.put(left)
                self.handle.registerTimer(min(r[1] for r in left))
            else:
                self.waiting.clear()
            yield self._placed(key[0], ready)
        elif not rows and self.seen.exists() and now >= self.seen.get()[0] + self.idle_ms:
            for state in (self.waiting, self.events, self.ends, self.seen):
                state.clear()

    def _placed(self, match_id, ready: list[tuple]) -> pd.DataFrame:
        closed = [tuple(r) for r in self.ends.get()] if self.ends.exists() else []
        number, lo = closed[-1][0::2] if closed else (0, 0)
        fresh = [r for r in ready if r[3] != ROUND_END]
        out, ended = [], []
        for seq, _, tick, kind in (r for r in ready if r[3] == ROUND_END):
            number += 1
            ended.append((number, lo, tick))
            out.append((match_id, seq, tick, kind, number))
            lo = tick
        out += _within(match_id, fresh, closed)
        if ended:
            old = [tuple(r) for r in self.events.get()] if self.events.exists() else []
            out += _within(match_id, old + fresh, ended)
            self.ends.appendList(ended)
        if fresh:
            self.events.appendList(fresh)
        return pd.DataFrame(out, columns=["match_id", "seq", "tick", "event_type", "round_number"])


def _within(match_id, events: list[tuple], bounds: list[tuple]) -> list[tuple]:
    """Events by the rounds (number, lo, hi) that hold their ticks: lo < tick <= hi."""
    events = sorted(events, key=lambda r: r[2])
    ticks = np.array([r[2] for r in events], np.int64)
    out = []
    for number, lo, hi in bounds:
        a, b = np.searchsorted(ticks, [lo, hi], "right")
        out += [(match_id, r[0], r[2], r[3], number) for r in events[a:b]]
    return out


def live_rounds(events: DataFrame, late: str = "10 minutes", idle_minutes: int = 180) -> DataFrame:
    """match_id, seq, tick, event_type, round_number from a stream of events: what round_bounds and in_rounds give
    for the whole table, each row once, as soon as the watermark has passed the event and the end of its round. Ends are
    rows of their own. As ends may fall, an event stays in its match's state until the match is over; rows without
    match, seq, tick or ts belong to no round."""
    rows = events.select("match_id", F.col("seq").cast("long"), "ts", F.unix_millis("ts").alias("ts_ms"), F.col("tick").cast("long"), "event_type").where("match_id is not null and seq is not null and tick is not null and ts is not null")
    kind = events.schema["match_id"].dataType.simpleString()
    return rows.withWatermark("ts", late).groupBy("match_id").transformWithStateInPandas(RoundAssembler(idle_minutes * 60_000), f"match_id {kind}, seq long, tick long, event_type string, round_number int", "Append", "EventTime")


def without_repeats(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each event once, where deliveries repeat it within the watermark; of a table, without regard to time."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """match_id, start, end, events, kills, rounds: runs of a match's events without a pause of gap or more, of a
    table or a stream; end is the last event's time plus gap. late is None where the stream has a watermark, as after without_repeats."""
    seen = (events.withWatermark("ts", late) if events.isStreaming and late else events).groupBy(F.session_window("ts", gap), "match_id")
    out = seen.agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "player_death").alias("kills"), F.count_if(F.col("event_type") == ROUND_END).alias("rounds"))
    return out.select("match_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "kills", "rounds")
