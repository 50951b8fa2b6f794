"""Zones whose state follows a stream of closed bars.

A batch scan finds zones; between scans new bars test them, break them, test the
broken level again and break it once more. follow() keeps for each (symbol, tf)
its zones, how far each has come, and the start of its last bar, and gives a row
for every zone that a micro-batch has moved to another status. The steps are those
that zones.stages() finds in one pass over all bars, so a zone that has followed
the stream has the status that a batch over the same bars gives it.

State is a few numbers a zone; bars aren't kept. Bars of a frame are taken in
order of their start within a micro-batch; a bar that doesn't start after the
frame's last one (repeated, or later than the watermark of stream_bars() allows)
is passed over. A frame that the watermark has left behind by `keep` loses its
state through an event-time timer.

The state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass),
which transformWithState needs.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from candela.schema import STATUSES

ZONES = "symbol string, tf string, zone_type string, level double, tolerance double, status string"
MOVED = "symbol string, tf string, zone_type string, level double, status string, before string, at long"
STATE = "zone_type string, level double, tolerance double, tested boolean, broken boolean, retested boolean, undone boolean"
#: How far a zone has come: untouched, tested, back after a break, used up.
FRESH, TESTED, REVERSED, CONSUMED = STATUSES


def seeds(zones: DataFrame) -> DataFrame:
    """What follow() starts from: zones (symbol, tf, zone_type, level, atr) with the flags of stages() on the bars so far: tested, break_idx, retest_idx, undone."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    return zones.select(
        "symbol", "tf", "zone_type", "level", (F.col("atr") * 0.25).alias("tolerance"), flag(F.col("tested") == 1).alias("tested"), F.col("break_idx").isNotNull().alias("broken"),
        F.col("retest_idx").isNotNull().alias("retested"), flag(F.col("undone") == 1).alias("undone"),
    )


def status(tested: bool, broken: bool, retested: bool, undone: bool) -> str:
    if not broken:
        return TESTED if tested else FRESH
    return REVERSED if retested and not undone else CONSUMED


def advanced(zone: tuple, high: float, low: float, close: float) -> tuple:
    """The zone (a row of STATE) after one more bar. A bar that breaks the zone isn't its first test from the other side."""
    kind, level, tol, tested, broken, retested, undone = zone
    support = kind == "Support"
    below, above = close < level - tol, close > level + tol
    if not broken:
        touched = low <= level + tol and not close <= level - tol if support else high >= level - tol and not close >= level + tol
        tested, broken = tested or touched, below if support else above
    elif not retested:
        retested = low <= level + tol * 2 and high >= level - tol * 2
    else:
        undone = undone or (above if support else below)
    return kind, level, tol, tested, broken, retested, undone


class Follower(StatefulProcessor):
    def __init__(self, keep: datetime.timedelta):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.zones = handle.getListState("zones", STATE)
        self.last = handle.getValueState("last", "at long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Each row is a zone of the key, as seeds() gives it."""
        self.zones.appendValue(tuple(initialState[name] for name in (field.split()[0] for field in STATE.split(", "))))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get()[0] if self.last.exists() else None
        bars = {}
        for row in rows:
            if last is None or row["at"] > last:
                bars[row["at"]] = row  # of equal starts the last that came
        if not bars:
            return
        zones = [tuple(z) for z in self.zones.get()] if self.zones.exists() else []
        moved = {}
        for at in sorted(bars):
            bar = bars[at]
            for k, zone in enumerate(zones):
                zones[k] = advanced(zone, bar["high"], bar["low"], bar["close"])
                before, after = status(*zone[3:]), status(*zones[k][3:])
                if before != after:
                    moved[k] = moved[k][0] if k in moved else before, at
        if zones:
            self.zones.put(zones)
        last = max(bars)
        self.last.update((last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last // 1000 + int(self.keep.total_seconds() * 1000))
        for k, (before, at) in moved.items():
            now = status(*zones[k][3:])
            if now != before:
                yield Row(symbol=key[0], tf=key[1], zone_type=zones[k][0], level=zones[k][1], status=now, before=before, at=at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.zones.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def follow(bars: DataFrame, zones: DataFrame, lateness: str = "1 hour", keep: datetime.timedelta = datetime.timedelta(days=30)) -> DataFrame:
    """bars: a stream (symbol, tf, ts, open, high, low, close, ...) of closed bars; zones: seeds(). Gives (symbol, tf, zone_type, level, status, before, ts) in append mode."""
    rows = bars.withWatermark("ts", lateness).select("symbol", "tf", "ts", "high", "low", "close", F.unix_micros("ts").alias("at"))
    moved = rows.groupBy("symbol", "tf").transformWithState(Follower(keep), MOVED, "append", "eventTime", zones.groupBy("symbol", "tf"))
    return moved.withColumn("ts", F.timestamp_micros("at")).drop("at")
