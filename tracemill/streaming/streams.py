"""Structured Streaming: sessions, deduplication, idempotent checkpoints, turn-taking and lag state."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(df: DataFrame, key: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions by key with gaps up to ``gap``; with a watermark they close in a stream."""
    d = df.withColumn(at, F.col(at).cast("timestamp"))
    if late is not None:
        d = d.withWatermark(at, late)
    g = d.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("events"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def windows(df: DataFrame, at: str, width: str, by: Sequence[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    d = df.withColumn(at, F.col(at).cast("timestamp"))
    if late is not None:
        d = d.withWatermark(at, late)
    w = F.window(at, width, slide) if slide else F.window(at, width)
    g = d.groupBy(w.alias("w"), *by).agg(F.count("*").alias("events"))
    return g.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def dedupe(df: DataFrame, keys: Sequence[str], at: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def run_available(df: DataFrame, sink: Callable[[DataFrame, int], None] | None, path: str | None, checkpoint: str, mode: str = "append"):
    """Process what is there and stop: into Parquet at ``path`` or through ``sink``."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = w.foreachBatch(sink).start() if sink is not None else w.format("parquet").start(path)
    q.awaitTermination()
    return q


def idempotent_append(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A batch sink that adds rows whose key is not there yet; a batch that is repeated adds nothing."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(keys))
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            new = new.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
        new.write.mode("append").parquet(path)

    return sink


# --- turn taking -----------------------------------------------------------------

ACTIONS = ("stop_talking", "keep_talking", "generate_message", "wait", "backchannel")


#: What else may be known of a tick, and what it is where a table lacks the column: the listener's verdicts to break in and to acknowledge,
#: own speech that only acknowledges, own speech that brings a tool's result, and a number drawn from 0 to 1.
SIGNALS = {"interrupts": False, "acknowledges": False, "back": False, "holds": False, "draw": 1.0}


class Policy:
    """Thresholds of the turn-taking decisions, in ticks; None switches a rule off.

    ``wait_other``, ``wait_self``: silence of both sides before an answer.
    ``yield_interrupted``, ``yield_interrupting``: overlap that is borne where the
    other side, or this one (also with a tool's result), broke in; without the
    first no overlap ends speech. ``variance``: ticks over a threshold within which
    chance decides. ``check_every``: ticks at which the listener's verdicts count.
    Acknowledgements by chance come between ``backchannel_min`` and
    ``backchannel_max`` ticks after the last, ``rate`` a second; ``backchannel_every``
    is a fixed distance. ``discard_overlap``: speech of the other side that ended
    while this one spoke is not answered.
    """

    def __init__(
        self,
        wait_other: int = 2,
        wait_self: int = 4,
        yield_interrupted: int | None = 2,
        yield_interrupting: int | None = 5,
        backchannel_every: int | None = None,
        backchannel_min: int | None = None,
        backchannel_max: int | None = None,
        rate: float = 0.0,
        tick_seconds: float = 0.05,
        check_every: int | None = None,
        variance: float = 0.0,
        discard_overlap: bool = False,
    ):
        self.wait_other, self.wait_self = wait_other, wait_self
        self.yield_interrupted, self.yield_interrupting = yield_interrupted, yield_interrupting
        self.backchannel_min = backchannel_min if backchannel_every is None else backchannel_every
        self.backchannel_max = backchannel_max if backchannel_every is None else backchannel_every
        self.chance = 1.0 - math.exp(-rate * tick_seconds)
        self.check_every, self.variance, self.discard_overlap = check_every, variance, discard_overlap

    def over(self, value: int, threshold: int, draw: float) -> bool:
        """Whether a threshold is reached: never below it, always ``variance`` above it, with rising chance between."""
        if value < threshold or value >= threshold + self.variance:
            return value >= threshold
        return draw < (value - threshold) / self.variance

    def acknowledges(self, since: int, draw: float) -> bool:
        if self.backchannel_min is None or since < self.backchannel_min:
            return False
        return self.backchannel_max is not None and since >= self.backchannel_max or draw < self.chance

    def step(self, s: dict, own: bool, other: bool, tool: bool, interrupts: bool = False, acknowledges: bool = False, back: bool = False, holds: bool = False, draw: float = 1.0) -> str:
        """Advance the state by one tick and decide."""
        s["ticks"] += 1
        s["own_run"] = s["own_run"] + 1 if own else 0
        s["other_run"] = s["other_run"] + 1 if other else 0
        s["since_own"] = 0 if own else s["since_own"] + 1
        s["since_other"] = 0 if other else s["since_other"] + 1
        s["heard"] += other
        s["since_back"] += 1
        if own:
            return self._speaking(s, other, back, holds, draw)
        if tool:
            return "generate_message"
        if other:
            if self.check_every is None or s["ticks"] % self.check_every == 0:
                if interrupts:
                    return "generate_message"
                if acknowledges:
                    s["since_back"] = 0
                    return "backchannel"
            if self.acknowledges(s["since_back"], draw):
                s["since_back"] = 0
                return "backchannel"
            return "wait"
        if s["heard"] and self.over(s["since_other"], self.wait_other, draw) and self.over(s["since_own"], self.wait_self, draw):
            s["heard"] = 0
            return "generate_message"
        return "wait"

    def _speaking(self, s: dict, other: bool, back: bool, holds: bool, draw: float) -> str:
        if back:
            return "keep_talking"
        if other:
            limit = self.yield_interrupting if holds or s["own_run"] < s["other_run"] else self.yield_interrupted
            yields = self.yield_interrupted is not None and limit is not None and self.over(s["other_run"], limit, draw)
            return "stop_talking" if yields else "keep_talking"
        if self.discard_overlap:
            s["heard"] = 0
        return "keep_talking"

    @staticmethod
    def start() -> dict:
        return dict.fromkeys(_STATE, 0)


_STATE = ("ticks", "own_run", "other_run", "since_own", "since_other", "heard", "since_back")


def _with_signals(df: DataFrame, key: str, tick: str) -> DataFrame:
    more = [F.coalesce(F.col(c), F.lit(v)).alias(c) if c in df.columns else F.lit(v).alias(c) for c, v in SIGNALS.items()]
    return df.select(key, tick, "own", "other", "tool", *more)


def _decide(policy: Policy, s: dict, f: pd.DataFrame) -> list[str]:
    rows = f[["own", "other", "tool", *SIGNALS]].itertuples(index=False)
    return [policy.step(s, *map(bool, r[:-1]), float(r[-1])) for r in rows]


def decisions(df: DataFrame, policy: Policy, key: str = "conv_id", tick: str = "tick_id") -> DataFrame:
    """``key, tick, action`` of batch ticks (columns own, other, tool and any of ``SIGNALS``): one fold a conversation."""
    schema = f"{key} {dict(df.dtypes)[key]}, {tick} {dict(df.dtypes)[tick]}, action string"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(tick)
        f["action"] = _decide(policy, Policy.start(), f)
        return f[[key, tick, "action"]]

    return _with_signals(df, key, tick).groupBy(key).applyInPandas(run, schema)


def decision_stream(df: DataFrame, policy: Policy, key: str = "conv_id", tick: str = "tick_id", timeout_ms: int | None = None) -> DataFrame:
    """The same in a stream: the counters are the state; a conversation that stalls for ``timeout_ms`` yields ``timeout``."""
    out = f"{key} {dict(df.dtypes)[key]}, {tick} {dict(df.dtypes)[tick]}, action string"
    state = ", ".join(f"{c} long" for c in _STATE)

    def run(name: tuple, frames: Iterator[pd.DataFrame], g: GroupState) -> Iterator[pd.DataFrame]:
        if g.hasTimedOut:
            g.remove()
            yield pd.DataFrame({key: [name[0]], tick: [-1], "action": ["timeout"]})
            return
        s = dict(zip(_STATE, g.get)) if g.exists else Policy.start()
        f = pd.concat(list(frames)).sort_values(tick)
        f["action"] = _decide(policy, s, f)
        g.update(tuple(int(s[c]) for c in _STATE))
        if timeout_ms is not None:
            g.setTimeoutDuration(timeout_ms)
        yield f[[key, tick, "action"]]

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms is not None else GroupStateTimeout.NoTimeout
    return _with_signals(df, key, tick).groupBy(key).applyInPandasWithState(run, out, state, "append", kind)


def backchannel(since: Column, heard: Column, least: int, most: int, rate: float, tick_seconds: float, draw: Column) -> Column:
    """Whether to acknowledge at a tick: never without speech of the other side or before ``least`` ticks, always from ``most`` on, by chance between."""
    chance = 1.0 - math.exp(-rate * tick_seconds)
    return F.when((heard <= 0) | (since < least), False).when(since >= most, True).otherwise(draw < chance)


def end_reasons(df: DataFrame, key: str, tick: str, done: Column, max_steps: int) -> DataFrame:
    """``key, end, reason``: the first tick that is ``done``, or the one at which ``max_steps`` ticks are over, or the last one there is."""
    d = df.groupBy(key).agg(F.min(F.when(done, F.col(tick))).alias("done"), F.min(tick).alias("first"), F.max(tick).alias("last"))
    limit = F.col("first") + max_steps - 1
    reason = F.when(F.col("done") <= limit, "done").when(F.col("last") >= limit, "max_steps").otherwise("open")
    return d.select(key, F.least(F.coalesce("done", "last"), limit).alias("end"), reason.alias("reason"))


def lagged(df: DataFrame, key: str, tick: str, values: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Each tick with the values of the tick before: what either party sees of the other."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy(*(order or [F.col(tick)]))
    return df.select("*", *[F.lag(v).over(w).alias(f"seen_{v}") for v in values])
