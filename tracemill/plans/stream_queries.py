"""Streams and ticks on the test tables: a user's events, numbered in time, are the ticks of a conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.operators import joins as J
from tracemill.operators import ordered as O
from tracemill.plans.registry import Tables, long, query
from tracemill.session import scratch
from tracemill.streaming import stateful as ST
from tracemill.streaming import streams as S
from tracemill.streaming import ticks as K
from tracemill.streaming.commitlog import CommitLog


def _folder(t: Tables) -> str:
    return scratch(t.spark, "stream")


def _stream(t: Tables) -> DataFrame:
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


def _run(t: Tables, df: DataFrame) -> DataFrame:
    out = _folder(t)
    S.run_available(df, None, f"{out}/rows", f"{out}/state")
    return t.spark.read.schema(df.schema).parquet(f"{out}/rows")


@query("""
with x as (select *, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as b from events),
s as (select *, sum(case when us - b > 1800000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as seg from x),
g as (select user_id, min(us) as start_us, max(us) + 1800000000 as end_us, count(*) as events from s group by user_id, seg)
select * from g where end_us <= (select max(epoch_us(ts)) - 600000000 from events)
""")
def stream_sessions(t: Tables) -> DataFrame:
    d = _run(t, S.sessions(_stream(t), "user_id", "ts", "30 minutes", late="10 minutes"))
    return d.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query("""
with g as (select event_type, epoch_us(time_bucket(interval 6 hours, ts)) as start_us, count(*) as events from events group by 1, 2)
select * from g where start_us + 21600000000 <= (select max(epoch_us(ts)) - 600000000 from events)
""")
def stream_windows(t: Tables) -> DataFrame:
    d = _run(t, S.windows(_stream(t), "ts", "6 hours", ["event_type"], late="10 minutes"))
    return d.select("event_type", F.unix_micros("start").alias("start_us"), "events")


@query("select user_id, event_type from events group by 1, 2")
def stream_dedupe(t: Tables) -> DataFrame:
    return _run(t, S.dedupe(_stream(t), ["user_id", "event_type"], "ts", "60 days")).select("user_id", "event_type")


@query("select event_id, user_id from events")
def stream_checkpoint(t: Tables) -> DataFrame:
    """The same stream run twice into one table with a commit log: the second run adds nothing."""
    out = _folder(t)
    d = _stream(t).select("event_id", "user_id")
    log = CommitLog(t.spark, out, ["event_id"])
    for n in (1, 2):
        S.run_available(d, log.sink(f"run{n}"), None, f"{out}/state{n}")
    return log.read(d.schema)


def _in_thirds(t: Tables, make) -> DataFrame:
    """What ``make`` does to a stream of the events that come in three batches of a third of the time, each run a start of its own from the same checkpoint."""
    out = _folder(t)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = t.events.agg(F.min(us), F.max(us)).first()
    for n in range(3):
        t.events.where(F.floor((us - lo) * 3 / (hi - lo + 1)) == n).write.mode("append").parquet(f"{out}/in")
        rows = make(t.spark.readStream.schema(t.events.schema).parquet(f"{out}/in"))
        with ST.rocksdb(t.spark):
            S.run_available(rows, None, f"{out}/rows", f"{out}/state")
    return t.spark.read.schema(rows.schema).parquet(f"{out}/rows")


@query("""
with x as (select user_id, event_id, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as b from events),
s as (select *, sum(case when us - b > 21600000000 then 1 else 0 end) over (partition by user_id order by us, event_id rows unbounded preceding) as seg from x),
r as (select *, (row_number() over (partition by user_id, seg order by us, event_id) - 1) // 4 as chunk from s),
g as (select user_id, seg, chunk, min(us) as first_us, max(us) as last_us, count(*) as steps from r group by 1, 2, 3),
l as (select *, max(seg) over (partition by user_id) as last_seg from g)
select user_id, first_us, last_us, steps, case when steps = 4 then 'max_steps' else 'timeout' end as reason from l
where steps = 4 or seg < last_seg or last_us + 21600000000 <= (select max(epoch_us(ts)) - 600000000 from events)
""")
def stream_ends(t: Tables) -> DataFrame:
    """Conversations that end with their fourth step, or when six hours pass without one: timers on event time, in three starts from one checkpoint."""
    return _in_thirds(t, lambda d: ST.ends(d, "user_id", "ts", "event_id", 21_600, 4, "10 minutes"))


@query("""
with x as (select user_id as conv_id, event_id, ts, floor(value * 3)::bigint as bytes from events),
w as (select *, sum(bytes - 160) over (partition by conv_id order by ts, event_id rows unbounded preceding) as walk from x),
m as (select *, walk - least(0, min(walk) over (partition by conv_id order by ts, event_id rows unbounded preceding)) as waiting from w)
select conv_id, event_id, waiting::bigint as waiting, (coalesce(lag(waiting) over (partition by conv_id order by ts, event_id), 0) + bytes - waiting)::bigint as played from m
""")
def stream_carry_over(t: Tables) -> DataFrame:
    """Audio that waits for later ticks, its amount kept as state over three starts."""
    own = lambda d: d.select(F.col("user_id").alias("conv_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 3).cast("long").alias("bytes"))
    return _in_thirds(t, lambda d: ST.carry_over(own(d), "conv_id", ["ts", "event_id"], 160)).select("conv_id", "event_id", "waiting", "played")


@query("""
with x as (select user_id as conv_id, event_id, event_type, count(*) filter (where event_type <> 'error') over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before, row_number() over (partition by user_id order by ts, event_id) as n from events),
q as (select conv_id, before, string_agg(event_id::varchar, ',' order by n) as results from x where event_type = 'error' group by 1, 2)
select x.conv_id, x.event_id as tick, lag(x.event_type) over (partition by x.conv_id order by n) as seen, coalesce(q.results, '') as results from x left join q using (conv_id, before) where event_type <> 'error'
""")
def stream_tick_views(t: Tables) -> DataFrame:
    """What each tick sees of the one before, and the results of tools that came since, over three starts."""
    text = F.col("event_id").cast("string")
    own = lambda d: d.select(F.col("user_id").alias("conv_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tick"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("chunk"), F.when(F.col("event_type") == "error", text).alias("result"))
    return _in_thirds(t, lambda d: ST.tick_views(own(d), "conv_id", ["ts", "tick"])).withColumn("results", F.array_join("results", ","))


@query("""
with e as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as n, epoch_us(ts) as us from events)
select a.user_id as run_id, 'noise' as effect, 'user' as who, a.us as start, b.us as "end" from e a join e b on a.user_id = b.user_id and b.n = case a.n % 9 when 1 then a.n + 3 when 2 then a.n + 1 when 5 then a.n + 3 when 6 then a.n + 2 when 7 then a.n + 1 end where a.n % 9 in (1, 2, 5, 6, 7)
""")
def stream_interval_log(t: Tables) -> DataFrame:
    """Opens and closes of a log as a stream, what is open kept as a list over three starts: two open and close, three open and all close, one closes nothing."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.when((F.col("n") % 9).isin(1, 2, 5, 6, 7), "open").when(F.col("n") % 9 == 8, "close_all").otherwise("close")
    numbered = t.events.withColumn("n", n).select("event_id", kind.alias("event"))
    path = scratch(t.spark, "log")
    numbered.write.parquet(path)
    kinds = t.spark.read.parquet(path)
    own = lambda d: d.join(kinds, "event_id").select(F.col("user_id").alias("run_id"), F.lit("noise").alias("effect"), F.lit("user").alias("who"), "event", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    return _in_thirds(t, lambda d: ST.interval_log(own(d), "run_id"))


@query("select user_id, epoch_us(time_bucket(interval 1 day, ts)) as start_us, count(*) as events from events group by 1, 2")
def batch_windows(t: Tables) -> DataFrame:
    d = S.windows(t.events, "ts", "1 day", ["user_id"])
    return d.select("user_id", F.unix_micros("start").alias("start_us"), "events")


# --- ticks -----------------------------------------------------------------------

_TICKS = """
t as (select user_id as conv_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as tick_id, ts,
  case when event_type in ('view', 'signup') then 'a' || event_id end as self_text, case when event_type in ('click', 'signup') then 'b' || event_id end as other_text,
  case when event_type = 'purchase' then event_id::varchar end as call_id, case when event_type = 'error' then event_id::varchar end as result_id from events)
"""


def ticks(t: Tables) -> DataFrame:
    n = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("int")
    is_ = lambda *x: F.col("event_type").isin(*x)
    said = lambda p, *x: F.when(is_(*x), F.concat(F.lit(p), F.col("event_id").cast("string")))
    item = F.struct(F.col("event_id").cast("string").alias("id"), F.lit("tool").alias("name"))
    return t.events.select(
        F.col("user_id").alias("conv_id"), n.alias("tick_id"), "ts", said("a", "view", "signup").alias("self_text"), said("b", "click", "signup").alias("other_text"),
        F.when(is_("purchase"), F.array(item)).alias("self_calls"), F.when(is_("error"), F.array(item)).alias("other_results"),
    )


def _linear(first: int, second: int) -> str:
    return f"""
with {_TICKS}, e as (select conv_id, tick_id, 'other' as side, {first} as p, case when result_id is not null then 'result' else 'speech' end as kind, coalesce(result_id, other_text) as text from t where coalesce(result_id, other_text) is not null
  union all select conv_id, tick_id, 'self', {second}, case when call_id is not null then 'call' else 'speech' end, coalesce(call_id, self_text) from t where coalesce(call_id, self_text) is not null),
o as (select *, row_number() over w as pos, lag(side || kind) over w as b from e window w as (partition by conv_id order by tick_id, p)),
g as (select *, sum(case when side || kind is distinct from b then 1 else 0 end) over (partition by conv_id order by pos) as grp from o),
c as (select conv_id, grp, side, kind, string_agg(text, '' order by pos) as text, min(pos) as pos from g group by 1, 2, 3, 4)
select conv_id, row_number() over (partition by conv_id order by pos) as place, side, kind, text from c
"""


@query(_linear(0, 1))
def linearise_other_first(t: Tables) -> DataFrame:
    return K.linearise(ticks(t), "other").withColumn("place", long("place"))


@query(_linear(1, 0))
def linearise_self_first(t: Tables) -> DataFrame:
    return K.linearise(ticks(t), "self").withColumn("place", long("place"))


@query()
def linearise_containment(t: Tables) -> DataFrame:
    return K.linearise_containment(ticks(t), 2, 3)


@query()
def linearise_overlap(t: Tables) -> DataFrame:
    return K.linearise_overlap(ticks(t), 2)


_SEG = f"""
with {_TICKS}, v as (select conv_id, tick_id, self_text as text, tick_id - lag(tick_id) over (partition by conv_id order by tick_id) as gap from t where self_text is not null),
g as (select *, sum(case when gap > 2 then 1 else 0 end) over (partition by conv_id order by tick_id rows unbounded preceding)::bigint as segment from v)
"""


@query(_SEG + "select conv_id, segment, min(tick_id) as start, max(tick_id) as \"end\", string_agg(text, '' order by tick_id) as text from g group by 1, 2")
def speech_segments(t: Tables) -> DataFrame:
    return K.segments(ticks(t), "self", 2)


@query(f"""
with {_TICKS}, q as (select conv_id, tick_id, row_number() over (partition by conv_id order by tick_id) as rn, self_text is null and other_text is null as quiet from t),
i as (select *, rn - row_number() over (partition by conv_id order by tick_id) as g from q where quiet), s as (select conv_id, min(tick_id) as start, count(*) as ticks from i group by conv_id, g having count(*) >= 3)
select conv_id, start, ticks, '[Both parties silent for ' || printf('%.1f', ticks * 0.2) || ' seconds]' as text from s
""")
def silence_notes(t: Tables) -> DataFrame:
    return K.silence_periods(ticks(t), 3, 0.2)


@query(f"""
with {_TICKS}, p as (select conv_id, tick_id, other_text is not null as o, sum(case when other_text is null then 1 else 0 end) over (partition by conv_id order by tick_id desc rows unbounded preceding) as pauses from t)
select conv_id, count(*) filter (where o) as total, count(*) filter (where pauses = 0) as ongoing from p group by 1
""")
def speech_counters(t: Tables) -> DataFrame:
    return K.speech_counters(ticks(t))


@query(f"""
with {_TICKS}, x as (select conv_id, tick_id, result_id is not null as r, other_text is not null as s, call_id from t) select conv_id, count(*) as ticks, count(*) filter (where r) as results from x group by 1
""")
def expand_environment(t: Tables) -> DataFrame:
    d = K.expand_environment(ticks(t))
    return d.groupBy("conv_id").agg(F.count("*").alias("ticks"), F.count_if(F.size("other_results") > 0).alias("results"))


@query(_SEG + """
, s as (select conv_id, segment, min(tick_id) as s, max(tick_id) as e from g group by 1, 2),
vo as (select conv_id, tick_id, tick_id - lag(tick_id) over (partition by conv_id order by tick_id) as gap from t where other_text is not null),
go as (select *, sum(case when gap > 2 then 1 else 0 end) over (partition by conv_id order by tick_id rows unbounded preceding) as segment from vo), o as (select conv_id, segment, min(tick_id) as s, max(tick_id) as e from go group by 1, 2),
c as (select *, lead(s) over (partition by conv_id order by s) as nx from o),
a as (select c.*, exists (select 1 from s where s.conv_id = c.conv_id and s.e >= c.s and (c.nx is null or s.s < c.nx)) as ok from c),
r as (select conv_id, s, ok, row_number() over (partition by conv_id order by s) - row_number() over (partition by conv_id, ok order by s) as i from a),
l as (select conv_id, count(*) as n from r where not ok group by conv_id, i)
select x.conv_id, coalesce(max(n), 0)::bigint as longest, coalesce(max(n), 0) >= 3 as unresponsive from (select distinct conv_id from a) x left join l using (conv_id) group by 1
""")
def responsiveness(t: Tables) -> DataFrame:
    d = ticks(t)
    calls = K.segments(d, "other", 2).select("conv_id", "start", "end")
    answers = K.segments(d, "self", 2).select("conv_id", "start", "end")
    r = J.response_windows(calls, answers, "conv_id", "start", "end")
    g = O.longest_run(r, ["conv_id"], ~F.col("answered"), [F.col("start")])
    return g.withColumn("unresponsive", F.col("longest") >= 3)


@query("""
with x as (select user_id as conv_id, row_number() over (partition by user_id order by ts, event_id) - 1 as tick_id, floor(value * 3)::bigint as bytes from events),
w as (select *, sum(bytes - 160) over (partition by conv_id order by tick_id rows unbounded preceding) as walk from x), m as (select *, walk - least(0, min(walk) over (partition by conv_id order by tick_id rows unbounded preceding)) as waiting from w)
select conv_id, tick_id, bytes, waiting::bigint as waiting, (coalesce(lag(waiting) over (partition by conv_id order by tick_id), 0) + bytes - waiting)::bigint as played from m
""")
def audio_carry_over(t: Tables) -> DataFrame:
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    d = t.events.select(F.col("user_id").alias("conv_id"), long(n).alias("tick_id"), F.floor(F.col("value") * 3).cast("long").alias("bytes"))
    return K.carry_over(d, 160)


@query("""
select user_id as conv_id, event_id, lag(event_type) over (partition by user_id order by ts, event_id) as seen from events
""")
def tick_loop_view(t: Tables) -> DataFrame:
    d = S.lagged(t.events, "user_id", "ts", ["event_type"], [F.col("ts"), F.col("event_id")])
    return d.select(F.col("user_id").alias("conv_id"), "event_id", F.col("seen_event_type").alias("seen"))


@query()
def stateful_policy(t: Tables) -> DataFrame:
    d = ticks(t).select("conv_id", "tick_id", F.col("self_text").isNotNull().alias("own"), F.col("other_text").isNotNull().alias("other"), F.col("other_results").isNotNull().alias("tool"))
    return S.decisions(d, S.Policy(wait_self=2, backchannel_every=10))
