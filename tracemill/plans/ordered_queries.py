"""Ordered analytics and joins on the test tables: a user's events stand for a conversation's ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.operators import joins as J
from tracemill.operators import ordered as O
from tracemill.plans.registry import Tables, long, micros, query


def by_time():
    return [F.col("ts"), F.col("event_id")]


@query("""
with x as (select user_id, event_type, ts, event_id, lag(event_type) over w as before, row_number() over w as pos from events window w as (partition by user_id order by ts, event_id))
select user_id, string_agg(event_type, '->' order by pos) as chain, count(*) as length from x where event_type is distinct from before group by 1
""")
def chain_collapse(t: Tables) -> DataFrame:
    return O.chain(t.events, ["user_id"], by_time(), "event_type")


@query("""
with x as (select user_id, event_type, lag(event_type) over w as before, row_number() over w as pos from events where event_type in ('purchase', 'signup') window w as (partition by user_id order by ts, event_id))
select user_id, string_agg(event_type, '->' order by pos) as chain, count(*) as length from x where event_type is distinct from before group by 1
""")
def write_chain(t: Tables) -> DataFrame:
    return O.chain(t.events, ["user_id"], by_time(), "event_type", where=F.col("event_type").isin("purchase", "signup"))


@query("""
with x as (select user_id, sum(case when event_type in ('view', 'click') then 0 else 1 end) over (partition by user_id order by ts desc, event_id desc rows unbounded preceding) as broken from events)
select user_id, count(*) filter (where broken = 0) as streak from x group by 1
""")
def leading_streak(t: Tables) -> DataFrame:
    return O.leading_streak(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], F.col("event_type").isin("view", "click"))


_SEGMENTS = """
x as (select *, epoch_us(ts) as us, lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as before from events),
s as (select *, sum(case when us - before > 1800000000 then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as segment from x)
"""


@query(f"with {_SEGMENTS} select user_id, segment, min(us) as start_us, max(us) as end_us, count(*) as events from s group by 1, 2")
def gap_segments(t: Tables) -> DataFrame:
    d = O.gap_segments(t.events.withColumn("us", micros("ts")), ["user_id"], F.col("us"), by_time(), 1_800_000_000)
    return d.groupBy("user_id", "segment").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("events"))


@query("""
with x as (select user_id, epoch_us(ts) as start, lead(epoch_us(ts)) over (partition by user_id order by ts, event_id) as "end" from events)
select user_id, start, "end", "end" - start as duration from x where "end" - start >= 36000000000
""")
def silence_gaps(t: Tables) -> DataFrame:
    return O.silences(t.events.withColumn("us", micros("ts")), ["user_id"], F.col("us"), by_time(), 36_000_000_000)


@query("""
with x as (select user_id, event_id, event_type in ('view', 'click') as ok, row_number() over w as rn from events window w as (partition by user_id order by ts, event_id)),
g as (select *, rn - row_number() over (partition by user_id order by rn) as island from x where ok)
select user_id, min(rn)::bigint as start, max(rn)::bigint as "end", count(*) as length from g group by user_id, island having count(*) >= 4
""")
def silence_islands(t: Tables) -> DataFrame:
    rn = F.row_number().over(W.partitionBy("user_id").orderBy(*by_time()))
    d = O.islands(t.events.withColumn("rn", long(rn)), ["user_id"], F.col("rn"), F.col("event_type").isin("view", "click"), by_time(), 4)
    return d


@query("""
with x as (select user_id, event_id, event_type, epoch_us(ts) as s, epoch_us(ts) + (value * 60000000)::bigint as e from events),
y as (select *, max(e) over (partition by user_id order by s, event_id rows between unbounded preceding and 1 preceding) as reach, row_number() over (partition by user_id order by s, event_id) as place from x),
z as (select *, sum(case when s > reach + 600000000 or reach is null then 1 else 0 end) over (partition by user_id order by s, event_id rows unbounded preceding)::bigint as grp from y)
select user_id, grp, min(s) as s, max(e) as e, count(*) as parts, string_agg(event_type, ' ' order by place) as event_type from z group by 1, 2
""")
def interval_merge(t: Tables) -> DataFrame:
    d = t.events.withColumn("s", micros("ts")).withColumn("e", F.col("s") + F.round(F.col("value") * 60_000_000).cast("long"))
    return O.merge_intervals(d, ["user_id"], "s", "e", [F.col("s"), F.col("event_id")], 600_000_000, text="event_type")


@query("""
with x as (select conv_id, turn, role = 'user' and coalesce(lead(role) over (partition by conv_id order by turn) <> 'assistant', true) as open, row_number() over (partition by conv_id order by turn) as rn from conversations where role <> 'system'),
g as (select conv_id, rn - row_number() over (partition by conv_id order by rn) as island from x where open), r as (select conv_id, count(*) as n from g group by conv_id, island)
select c.conv_id, coalesce(max(r.n), 0)::bigint as longest from (select distinct conv_id from x) c left join r using (conv_id) group by 1
""")
def max_unanswered_run(t: Tables) -> DataFrame:
    d = t.conversations.where("role <> 'system'")
    answered = F.coalesce(F.lead("role").over(W.partitionBy("conv_id").orderBy("turn")) == "assistant", F.lit(False))
    d = d.withColumn("open", (F.col("role") == "user") & ~answered)
    return O.longest_run(d, ["conv_id"], F.col("open"), [F.col("turn")])


@query("""
with x as (select *, case when event_id % 5 = 0 then null else epoch_us(ts) / 1000000.0 end as tm from events),
y as (select *, last_value(tm ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as k, first_value(tm ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following) as f from x),
z as (select *, coalesce(k, f) as known, coalesce(lag(coalesce(k, f)) over (partition by user_id order by ts, event_id), f) as b from y)
select event_id, round(greatest(coalesce(b - f, 0.0), 0.0), 3) as "offset", round(greatest(coalesce(known - b, 0.0), 0.0), 3) as wait from z
""")
def gap_timing(t: Tables) -> DataFrame:
    d = t.events.withColumn("at", F.when(F.col("event_id") % 5 == 0, None).otherwise(micros("ts") / 1e6))
    return O.gap_timing(d, ["user_id"], "at", by_time()).select("event_id", "offset", "wait")


@query("select conv_id, turn, role, (row_number() over (partition by conv_id order by turn desc) - 1)::bigint as turn_idx from conversations")
def turn_reindex(t: Tables) -> DataFrame:
    return O.reindex(t.conversations, ["conv_id"], [F.desc("turn")]).select("conv_id", "turn", "role", long("turn_idx").alias("turn_idx"))


@query("select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by floor(s_acctbal / 1000) desc, s_suppkey) as rank from supplier")
def row_rank(t: Tables) -> DataFrame:
    d = O.rank_rows(t.supplier, ["s_nationkey"], [F.desc(F.floor(F.col("s_acctbal") / 1000)), F.col("s_suppkey")])
    return d.select("s_nationkey", "s_suppkey", long("rank").alias("rank"))


@query("""
with x as (select *, max(s_acctbal) over (partition by s_nationkey order by s_suppkey rows between unbounded preceding and 1 preceding) as best from supplier)
select s_nationkey, s_suppkey, s_acctbal from x where best is null or s_acctbal > best
""")
def frontier(t: Tables) -> DataFrame:
    return O.frontier(t.supplier, ["s_nationkey"], "s_acctbal", [F.col("s_suppkey")]).select("s_nationkey", "s_suppkey", "s_acctbal")


@query("""
with x as (select *, nullif(event_type, 'error') as pattern, event_type = 'signup' as alone from events),
y as (select *, last_value(pattern ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as held from x),
z as (select *, lag(held) over w as b, lag(alone) over w as ba, row_number() over w as rn from y window w as (partition by user_id order by ts, event_id)),
g as (select *, sum(case when rn > 1 and (held is distinct from b or alone or coalesce(ba, false)) then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as grp from z)
select user_id, grp, count(*) as ticks, min(event_id) as first_id from g group by 1, 2
""")
def tick_groups(t: Tables) -> DataFrame:
    d = t.events.withColumn("pattern", F.when(F.col("event_type") != "error", F.col("event_type")))
    d = O.pattern_groups(d, ["user_id"], "pattern", by_time(), F.col("event_type") == "signup")
    return d.groupBy("user_id", "grp").agg(F.count("*").alias("ticks"), F.min("event_id").alias("first_id"))


@query("""
with x as (select conv_id, turn, first_value(text) over (partition by conv_id order by turn) as text from conversations),
y as (select *, max(least(ceil(((turn * 7) % 10) / 9.0 * length(text)), length(text))) over (partition by conv_id order by turn rows unbounded preceding)::bigint as released from x),
z as (select *, coalesce(lag(released) over (partition by conv_id order by turn), 0)::bigint as f from y)
select conv_id, turn, released, substr(text, f + 1, released - f) as part from z
""")
def proportional_release(t: Tables) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    d = t.conversations.withColumn("text", F.first("text").over(w))
    d = O.proportional_release(d, ["conv_id"], [F.col("turn")], (F.col("turn") * 7) % 10 / F.lit(9.0), "text")
    return d.select("conv_id", "turn", long("released").alias("released"), "part")


@query("""
with x as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as pos, count(*) over (partition by user_id) as n from events),
y as (select *, greatest(1, n // 6) as width from x)
select user_id, (pos // width)::bigint as bucket, min(value) as low, max(value) as high from y where pos // width < n // width group by 1, 2
""")
def waveform_envelope(t: Tables) -> DataFrame:
    pos = F.row_number().over(W.partitionBy("user_id").orderBy(*by_time())) - 1
    return O.envelope(t.events.withColumn("pos", pos), ["user_id"], F.col("pos"), "value", 6)


@query("""
with x as (select user_id, event_id, case event_type when 'signup' then 0 when 'purchase' then 0 when 'view' then 1 else 2 end as depth from events)
select event_id, case when depth = 1 then max(case when depth < 1 then event_id end) over w when depth = 2 then max(case when depth < 2 then event_id end) over w end as parent
from x window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)
""")
def trace_parents(t: Tables) -> DataFrame:
    depth = F.when(F.col("event_type").isin("signup", "purchase"), 0).when(F.col("event_type") == "view", 1).otherwise(2)
    return O.nearest_shallower(t.events.withColumn("depth", depth), ["user_id"], "event_id", "depth", 2).select("event_id", "parent")


# --- joins ---------------------------------------------------------------------


@query("""
select a.event_id as first, b.event_id as second, a.user_id from events a join events b on a.user_id = b.user_id and b.ts >= a.ts and b.ts <= a.ts + interval 1 hour
where a.event_type = 'click' and b.event_type = 'purchase'
""")
def self_theta_onestop(t: Tables) -> DataFrame:
    at = t.events.withColumn("start", micros("ts")).select("user_id", "event_id", "event_type", "start")
    hour = 3_600_000_000
    a = at.where("event_type = 'click'").withColumn("end", F.col("start") + hour)
    b = at.where("event_type = 'purchase'").withColumn("end", F.col("start"))
    d = J.overlap_join(a, b, ["user_id"], hour)
    return d.select(F.col("a_event_id").alias("first"), F.col("b_event_id").alias("second"), "user_id")


@query("""
select a.p_partkey as first, b.p_partkey as second, a.p_brand from part a join part b on (a.p_brand = b.p_brand and b.p_size = a.p_size and b.p_retailprice >= a.p_retailprice and a.p_partkey <> b.p_partkey and a.p_type = b.p_type)
""")
def connecting_legs(t: Tables) -> DataFrame:
    legs = t.part.withColumn("hub", F.concat_ws("|", "p_brand", "p_size", "p_type"))
    d = J.one_stop(legs, "p_brand", "hub", "hub", "p_retailprice", "p_retailprice", "p_partkey")
    return d.where("first <> second")


@query("""
select p.event_id, p.user_id, c.event_id as prev_event_id from (select * from events where event_type = 'purchase') p
asof left join (select * from events where event_type = 'click') c on p.user_id = c.user_id and p.ts > c.ts
""")
def asof_pair(t: Tables) -> DataFrame:
    d = J.asof_backward(t.events.where("event_type = 'purchase'"), t.events.where("event_type = 'click'"), ["user_id"], "ts", ["event_id"])
    return d.select("event_id", "user_id", "prev_event_id")


_SPANS = f"""
with {_SEGMENTS}, v as (select user_id, event_type, epoch_us(ts) as us, ts, event_id from events where event_type in ('view', 'click')),
w as (select *, lag(us) over (partition by user_id, event_type order by ts, event_id) as b from v),
g as (select *, sum(case when us - b > 36000000000 then 1 else 0 end) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding)::bigint as segment from w),
spans as (select user_id, event_type, segment, min(us) as s, max(us) as e from g group by 1, 2, 3)
"""


def _spans(t: Tables) -> DataFrame:
    d = t.events.where(F.col("event_type").isin("view", "click")).withColumn("us", micros("ts"))
    d = O.gap_segments(d, ["user_id", "event_type"], F.col("us"), by_time(), 36_000_000_000)
    return d.groupBy("user_id", "event_type", "segment").agg(F.min("us").alias("start"), F.max("us").alias("end"))


@query(_SPANS + "select a.user_id, a.segment as a_segment, b.segment as b_segment from spans a join spans b on a.user_id = b.user_id and a.s >= b.s and a.e <= b.e where a.event_type = 'view' and b.event_type = 'click'")
def interval_contain(t: Tables) -> DataFrame:
    s = _spans(t)
    d = J.overlap_join(s.where("event_type = 'view'"), s.where("event_type = 'click'"), ["user_id"], 86_400_000_000, contained=True)
    return d.select("user_id", "a_segment", "b_segment")


@query(_SPANS + "select a.user_id, a.segment as a_segment, b.segment as b_segment from spans a join spans b on a.user_id = b.user_id and a.s <= b.e and b.s <= a.e where a.event_type = 'view' and b.event_type = 'click'")
def interval_overlap(t: Tables) -> DataFrame:
    s = _spans(t)
    d = J.overlap_join(s.where("event_type = 'view'"), s.where("event_type = 'click'"), ["user_id"], 86_400_000_000)
    return d.select("user_id", "a_segment", "b_segment")


@query("""
select count(*) filter (where l_quantity < 30 and coalesce(nullif(case when l_linenumber % 3 = 0 then null when l_linenumber % 3 = 1 then 0 else l_quantity + 5 end, 0)::double, 'inf'::double) > 20) as hits from lineitem
""")
def open_interval_overlap(t: Tables) -> DataFrame:
    k = F.col("l_linenumber") % 3
    end = F.when(k == 0, None).when(k == 1, 0).otherwise(F.col("l_quantity") + 5)
    return t.lineitem.agg(F.count_if(J.open_overlap(F.col("l_quantity"), end, F.lit(20), F.lit(30))).alias("hits"))


@query(_SPANS + """, c as (select *, lead(s) over (partition by user_id order by s) as next_s from spans where event_type = 'view')
select c.user_id, c.segment, exists (select 1 from spans a where a.event_type = 'click' and a.user_id = c.user_id and a.e >= c.s and (c.next_s is null or a.s < c.next_s)) as answered from c
""")
def response_window(t: Tables) -> DataFrame:
    s = _spans(t)
    d = J.response_windows(s.where("event_type = 'view'"), s.where("event_type = 'click'"), "user_id", "start", "end")
    return d.select("user_id", "segment", "answered")


@query("""
select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity >= 45 and l_returnflag = 'R') as matched from orders
""")
def exists_match(t: Tables) -> DataFrame:
    gold = t.orders.select("o_orderkey")
    calls = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_returnflag")
    return J.exists_match(gold, calls, "o_orderkey", "b.l_quantity >= 45 and b.l_returnflag = 'R'").select("o_orderkey", "matched")


@query("""
select doc_id, 'missing' as side from (select doc_id from documents except select doc_id from labels) union all select doc_id, 'extra' as side from (select doc_id from labels except select doc_id from documents)
""")
def integrity_anti(t: Tables) -> DataFrame:
    return J.missing_and_extra(t.documents, t.labels, "doc_id")


@query("""
with a as (select r_name as x from region union all select null), b as (select n_name as x from nation where n_regionkey = 0 union all select null), c as (select n_name as x from nation where n_regionkey = 1 union all select null)
select array_to_string(list_sort(list_filter([a.x, b.x, c.x], lambda z: z is not null)), ',') as combo from a, b, c where (a.x is not null)::int + (b.x is not null)::int + (c.x is not null)::int >= 2
""")
def compose_product(t: Tables) -> DataFrame:
    sets = [t.region.select(F.col("r_name").alias("x")), *[t.nation.where(f"n_regionkey = {k}").select(F.col("n_name").alias("x")) for k in (0, 1)]]
    return J.compose(sets, "x", F.size("combo") >= 2).select(F.array_join("combo", ",").alias("combo"))


@query("""
with need as (select l_orderkey, l_suppkey % 4 as i, count(*) as n from lineitem where l_linenumber <= 2 group by 1, 2), have as (select l_orderkey, l_suppkey % 4 as i, count(*) as n from lineitem where l_linenumber > 2 group by 1, 2)
select l_orderkey, bool_and(need.n <= coalesce(have.n, 0)) as contained from need left join have using (l_orderkey, i) group by 1
""")
def multiset_contained(t: Tables) -> DataFrame:
    d = t.lineitem.withColumn("i", F.col("l_suppkey") % 4)
    return J.multiset_contained(d.where("l_linenumber <= 2"), d.where("l_linenumber > 2"), "l_orderkey", "i")


@query("""
with b as (select o_custkey, max(o_totalprice) as v from orders where o_orderstatus = 'F' group by 1), c as (select o_custkey, max(o_totalprice) as v from orders where o_orderstatus = 'O' group by 1)
select c_custkey as o_custkey, coalesce(b.v, 0.0) as baseline, coalesce(c.v, 0.0) as candidate from customer left join b on b.o_custkey = c_custkey left join c on c.o_custkey = c_custkey
""")
def paired_default(t: Tables) -> DataFrame:
    best = lambda s: t.orders.where(f"o_orderstatus = '{s}'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("v"))
    return J.paired(t.customer.select(F.col("c_custkey").alias("o_custkey")), best("F"), best("O"), "o_custkey", "v")


@query("""
with i as (select c_custkey, unnest(list_distinct([c_custkey % 25, (c_custkey * 7) % 25])) as n_nationkey from customer) select c_custkey, n_name from i join nation using (n_nationkey)
""")
def id_array_join(t: Tables) -> DataFrame:
    ids = F.array_distinct(F.array(F.col("c_custkey") % 25, (F.col("c_custkey") * 7) % 25))
    d = t.customer.select("c_custkey", F.explode(ids).alias("n"))
    return d.join(t.nation, F.col("n") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query(_SPANS + """, i as (select user_id, event_id, epoch_us(ts) as us from events where event_type = 'purchase'), sv as (select * from spans where event_type = 'view'), l as (select user_id, max(segment) as last from sv group by 1)
select i.user_id, i.event_id as item, coalesce(min(sv.segment), any_value(l.last))::bigint as segment from i left join sv on sv.user_id = i.user_id and ((sv.s <= i.us and i.us <= sv.e) or sv.e < i.us) left join l on l.user_id = i.user_id group by 1, 2
""")
def assign_first_segment(t: Tables) -> DataFrame:
    seg = _spans(t).where("event_type = 'view'").select("user_id", "segment", "start", "end")
    items = t.events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("item"), micros("ts").alias("start"), micros("ts").alias("end"))
    return J.assign_first(items, seg, "user_id").select("user_id", "item", long("segment").alias("segment"))


@query("""
with x as (select *, count(*) filter (where o_orderstatus = 'F') over (partition by o_custkey) as s from orders) select o_custkey, o_orderkey from x where s = 0
""")
def all_trials_failed(t: Tables) -> DataFrame:
    s = F.count_if(F.col("o_orderstatus") == "F").over(W.partitionBy("o_custkey"))
    return t.orders.withColumn("s", s).where("s = 0").select("o_custkey", "o_orderkey")


@query("select count(*) filter (where map_extract(map(['a', 'b'], [l_linenumber, l_suppkey]), 'a')[1] = 1) as gold, count(*) filter (where l_suppkey % 2 = 0) as hits from lineitem")
def argument_match(t: Tables) -> DataFrame:
    gold = F.create_map(F.lit("a"), F.col("l_linenumber").cast("string"), F.lit("b"), F.lit("0"), F.lit("c"), F.lit("x"))
    first = F.create_map(F.lit("a"), F.lit("1"))
    second = F.create_map(F.lit("b"), (F.col("l_suppkey") % 2).cast("string"))
    null = F.lit(None).cast("array<string>")
    return t.lineitem.agg(F.count_if(J.args_match(gold, first, null)).alias("gold"), F.count_if(J.args_match(gold, second, F.array(F.lit("b")))).alias("hits"))
