"""Conversations as streams with state of their own: ends by time and by steps, carry-over, views of ticks, interval logs.

State lives in RocksDB, a value or list for each key, across micro-batches and
restarts; a key's rows of one micro-batch are taken in order, so time has to go
forward from batch to batch (ticks that are late count where they come).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, as these processors need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def _rows(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


class Ends(StatefulProcessor):
    """A conversation ends with the step that makes ``most`` of them, or when ``stall`` microseconds of event time pass without a step; then a new one begins."""

    def __init__(self, stall: int, most: int, names: list[str]):
        self.stall, self.most, self.names = stall, most, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first long, last long, steps long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.open.get() if self.open.exists() else None
        ended = []
        for at in _rows(rows, ["us", "tie"])["us"].tolist():
            if now and at - now[1] > self.stall:
                ended.append((key[0], *now, "timeout"))
                now = None
            now = (now[0], max(now[1], at), now[2] + 1) if now else (at, at, 1)
            if now[2] >= self.most:
                ended.append((key[0], *now, "max_steps"))
                now = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now:
            self.open.update(tuple(int(x) for x in now))
            self.handle.registerTimer(-(-(now[1] + self.stall) // 1000))
        else:
            self.open.clear()
        yield pd.DataFrame(ended, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self.open.get()
        self.open.clear()
        yield pd.DataFrame([(key[0], *now, "timeout")], columns=self.names)

    def close(self) -> None:
        pass


def ends(df: DataFrame, key: str, at: str, tie: str, stall_seconds: int, most: int, late: str) -> DataFrame:
    """``key, first_us, last_us, steps, reason`` of every conversation that has ended, from a stream of steps with event times."""
    names = [key, "first_us", "last_us", "steps", "reason"]
    d = df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).select(key, at, F.unix_micros(at).alias("us"), F.col(tie).alias("tie"))
    schema = f"{key} {dict(df.dtypes)[key]}, first_us long, last_us long, steps long, reason string"
    return d.groupBy(key).transformWithStateInPandas(Ends(stall_seconds * 1_000_000, most, names), schema, "append", "eventTime")


class CarryOver(StatefulProcessor):
    """Bytes that play in each tick when at most ``cap`` fit: a bucket that empties by ``cap`` a tick."""

    def __init__(self, cap: int, order: list[str]):
        self.cap, self.order = cap, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getValueState("waiting", "bytes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.waiting.get()[0] if self.waiting.exists() else 0
        f = _rows(rows, self.order)
        waiting, played = [], []
        for arrived in f["bytes"].tolist():
            plays = min(self.cap, before + arrived)
            before += arrived - plays
            waiting.append(before)
            played.append(plays)
        self.waiting.update((int(before),))
        yield f.assign(waiting=waiting, played=played)

    def close(self) -> None:
        pass


def carry_over(df: DataFrame, key: str, order: list[str], cap: int) -> DataFrame:
    """A stream of ticks (``bytes`` that arrive) with ``waiting`` and ``played``, as :func:`tracemill.streaming.ticks.carry_over` has them for a table."""
    schema = ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", waiting long, played long"
    return df.groupBy(key).transformWithStateInPandas(CarryOver(cap, order), schema, "append", "none")


class TickView(StatefulProcessor):
    """What a party sees at its tick: the other's chunk of the tick before, and the tool results that came since."""

    def __init__(self, order: list[str], names: list[str]):
        self.order, self.names = order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "chunk string")
        self.queue = handle.getListState("queue", "result string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else None
        queue = [r[0] for r in self.queue.get()] if self.queue.exists() else []
        out = []
        for r in _rows(rows, self.order).itertuples():
            if pd.notna(r.result):
                queue.append(r.result)
                continue
            out.append((key[0], r.tick, seen, queue))
            seen, queue = (r.chunk if pd.notna(r.chunk) else None), []
        self.seen.update((seen,))
        if queue:
            self.queue.put([(x,) for x in queue])
        else:
            self.queue.clear()
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def tick_views(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``key, tick, seen, results`` of every tick of a stream (columns ``tick``, ``chunk``, and ``result`` in rows that are no ticks but results of tools)."""
    schema = f"{key} {dict(df.dtypes)[key]}, tick {dict(df.dtypes)['tick']}, seen string, results array<string>"
    return df.groupBy(key).transformWithStateInPandas(TickView(order, [key, "tick", "seen", "results"]), schema, "append", "none")


class IntervalLog(StatefulProcessor):
    """Open and close events, paired last opened first by effect and party; ``close_all`` ends whatever is open; a close that finds nothing open is ignored."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "effect string, who string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stacks: dict[tuple, list[int]] = {}
        if self.open.exists():
            for effect, who, at in self.open.get():
                stacks.setdefault((effect, who), []).append(at)
        closed = []
        for r in _rows(rows, ["at", "seq"]).itertuples():
            if r.event == "open":
                stacks.setdefault((r.effect, r.who), []).append(int(r.at))
            elif r.event == "close_all":
                closed += [(key[0], *k, at, int(r.at)) for k, own in stacks.items() for at in own]
                stacks.clear()
            elif stacks.get((r.effect, r.who)):
                closed.append((key[0], r.effect, r.who, stacks[r.effect, r.who].pop(), int(r.at)))
        left = [(*k, at) for k, own in stacks.items() for at in own]
        if left:
            self.open.put(left)
        else:
            self.open.clear()
        yield pd.DataFrame(closed, columns=self.names)

    def close(self) -> None:
        pass


def interval_log(df: DataFrame, key: str) -> DataFrame:
    """``key, effect, who, start, end`` of every interval that has closed, from a stream of events (effect, who, event, at, seq)."""
    schema = f"{key} {dict(df.dtypes)[key]}, effect string, who string, start long, end long"
    return df.select(key, "effect", "who", "event", F.col("at").cast("long").alias("at"), "seq").groupBy(key).transformWithStateInPandas(IntervalLog([key, "effect", "who", "start", "end"]), schema, "append", "none")
