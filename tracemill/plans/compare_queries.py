"""Comparison, traces, state, clusters and changes of tables on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.operators import clustering as C
from tracemill.operators import compare as K
from tracemill.operators import dml as D
from tracemill.operators import guards as G
from tracemill.operators import statediff as Z
from tracemill.operators import traces as T
from tracemill.plans.registry import Tables, long, query

_HALVES = """
m as (select median(epoch_us(o_orderdate)) as m from orders), h as (select o_custkey, epoch_us(o_orderdate) > (select m from m) as late, case when o_orderstatus = 'F' then 1.0 else 0.0 end as r from orders)
"""


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    d = t.orders.select("o_custkey", us.alias("us"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("r"))
    d = d.crossJoin(F.broadcast(d.agg(F.median("us").alias("m"))))
    return d.where("us <= m"), d.where("us > m")


@query(f"""
with {_HALVES}, a as (select o_custkey, avg(r) as v from h where not late group by 1), b as (select o_custkey, avg(r) as v from h where late group by 1),
j as (select coalesce(a.o_custkey, b.o_custkey) as o_custkey, coalesce(a.v, 0.0) as before, coalesce(b.v, 0.0) as after from a full join b on a.o_custkey = b.o_custkey)
select o_custkey, round(before, 6) as before, round(after, 6) as after, round(after - before, 6) as delta, case when before < 0.999 and after >= 0.999 then 'improved' when before >= 0.999 and after < 0.999 then 'regressed' else 'same' end as flip from j
""")
def compare_full_outer(t: Tables) -> DataFrame:
    a, b = (d.groupBy("o_custkey").agg(F.avg("r").alias("v")) for d in _halves(t))
    d = K.compare_runs(a, b, "o_custkey", "v")
    return d.select("o_custkey", *[F.round(c, 6).alias(c) for c in ("before", "after", "delta")], "flip")


@query(f"""
with {_HALVES}, a as (select o_custkey, avg(r) >= 0.999 as p from h where not late group by 1), b as (select o_custkey, avg(r) >= 0.999 as q from h where late group by 1)
select case when coalesce(p, false) and coalesce(q, false) then 'both' when coalesce(p, false) then 'lost' when coalesce(q, false) then 'gained' else 'neither' end as flow, count(*) as tasks from a full join b on a.o_custkey = b.o_custkey group by 1
""")
def outcome_flow(t: Tables) -> DataFrame:
    a, b = _halves(t)
    return K.outcome_flow(a, b, "o_custkey", "r")


@query("""
with a as (select event_type, count(*) as n from events where event_id % 2 = 0 group by 1), b as (select event_type, count(*) as n from events where event_id % 2 = 1 and event_type <> 'error' group by 1)
select coalesce(a.event_type, b.event_type) as event_type, coalesce(a.n, 0) as before, coalesce(b.n, 0) as after, coalesce(b.n, 0) - coalesce(a.n, 0) as shift from a full join b on a.event_type = b.event_type
""")
def mode_shift(t: Tables) -> DataFrame:
    return K.mode_shift(t.events.where("event_id % 2 = 0"), t.events.where("event_id % 2 = 1 and event_type <> 'error'"), "event_type")


@query(f"""
with {_HALVES}, spec as (select c_custkey as o_custkey, case when c_custkey % 4 = 0 then 'control' else 'target' end as role from customer where c_mktsegment = 'BUILDING'),
b as (select o_custkey, max(r) as b from h where not late group by 1), c as (select o_custkey, max(r) as c from h where late group by 1),
j as (select role, coalesce(b, 0) as b, coalesce(c, 0) as c from spec left join b using (o_custkey) left join c using (o_custkey)),
s as (select count(*) filter (where b < 0.999 and c >= 0.999) as improved, count(*) filter (where role = 'target' and b < 0.999 and c >= 0.999) as target_improved, count(*) filter (where b >= 0.999 and c < 0.999) as regressed,
      count(*) filter (where role = 'control' and b >= 0.999 and c < 0.999) as control_regressed, count(*) as tasks from j)
select *, case when control_regressed > 0 then 'fail' when target_improved > 0 then 'pass' when improved > 0 then 'review' else 'fail' end as verdict from s
""")
def subset_verdict(t: Tables) -> DataFrame:
    a, b = _halves(t)
    spec = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 4 == 0, "control").otherwise("target").alias("role"))
    return K.subset_verdict(spec, a, b, "o_custkey", "r")


@query("""
with x as (select *, row_number() over (partition by c_mktsegment order by c_acctbal, c_custkey) as r from customer) select c_custkey, c_mktsegment from x where r = 1
""")
def representatives(t: Tables) -> DataFrame:
    return K.representatives(t.customer, "c_mktsegment", [F.col("c_acctbal"), F.col("c_custkey")]).select("c_custkey", "c_mktsegment")


@query("""
with u as (select c_custkey, 0 as part, row_number() over (order by c_acctbal, c_custkey) as pos from customer qualify pos <= 8
  union all select c_custkey, 1, row_number() over (order by c_acctbal desc, c_custkey) as pos from customer qualify pos <= 4 union all select c_custkey, 2, c_custkey from customer where c_custkey in (1, 2, 3))
select c_custkey from u group by 1
""")
def subset_union(t: Tables) -> DataFrame:
    top = lambda n, *o: t.customer.orderBy(*o).limit(n).withColumn("pos", F.row_number().over(W.orderBy(*o)))
    parts = [top(8, F.col("c_acctbal"), F.col("c_custkey")), top(4, F.desc("c_acctbal"), F.col("c_custkey")), t.customer.where("c_custkey in (1, 2, 3)").withColumn("pos", F.col("c_custkey"))]
    return K.ordered_union(parts, "c_custkey")


_ENTRIES = """
e as (select p_brand as model, p_type as domain, max(p_size) / 100.0 as pass_1, max(p_size) / 125.0 as pass_2, max(p_size) / 150.0 as pass_3, max(p_size) / 200.0 as pass_4 from part group by 1, 2)
"""


@query(f"""
with {_ENTRIES} select model, count(domain) as domains, round(avg(pass_1), 6) as pass_1, round(avg(pass_4), 6) as pass_4, round(avg(pass_4) / nullif(avg(pass_1), 0), 6) as consistency from e group by 1
""")
def leaderboard(t: Tables) -> DataFrame:
    e = t.part.groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("domain")).agg(*[(F.max("p_size") / d).alias(f"pass_{k}") for k, d in ((1, 100.0), (2, 125.0), (3, 150.0), (4, 200.0))])
    d = K.leaderboard(e, "model", "domain")
    return d.select("model", "domains", *[F.round(c, 6).alias(c) for c in ("pass_1", "pass_4", "consistency")])


@query("""
with x as (select p_brand, p_partkey, p_retailprice, coalesce(case when p_size > 25 then 'r' || p_size end, case when p_size > 10 then 'e' || p_size end, 's' || p_size) as date from part),
r as (select *, row_number() over (partition by p_brand order by p_retailprice desc nulls last, p_partkey desc) as r from x) select p_brand, p_partkey, date from r where r = 1
""")
def best_submission(t: Tables) -> DataFrame:
    k = F.col("p_size").cast("string")
    d = t.part.withColumns({"release_date": F.when(F.col("p_size") > 25, F.concat(F.lit("r"), k)), "evaluation_date": F.when(F.col("p_size") > 10, F.concat(F.lit("e"), k)), "submission_date": F.concat(F.lit("s"), k)})
    return K.best_entry(d, "p_brand", "p_retailprice", "p_partkey").select("p_brand", "p_partkey", "date")


@query("select s_suppkey, case when s_suppkey % 7 = 0 then s_acctbal + 1 else s_acctbal end as s_acctbal from supplier where s_suppkey % 7 = 0")
def metric_check(t: Tables) -> DataFrame:
    sub = t.supplier.select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("s_acctbal"))
    return K.metric_check(sub, t.supplier.select("s_suppkey", "s_acctbal"), ["s_suppkey"], "s_acctbal").select("s_suppkey", "s_acctbal")


def _steps(t: Tables) -> DataFrame:
    d = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("s"))
    d = d.select("conv_id", F.transform("s", lambda x: x["role"]).alias("a"))
    return d.alias("x").join(d.alias("y"), F.col("y.conv_id") == F.col("x.conv_id") + 1).select(F.col("x.conv_id").alias("conv_id"), F.col("x.a").alias("a"), F.col("y.a").alias("b"))


@query()
def lcs_align(t: Tables) -> DataFrame:
    return K.align(_steps(t), "conv_id", "a", "b")


@query()
def word_diff(t: Tables) -> DataFrame:
    d = t.benchmark.select("item_id", "text")
    pairs = d.alias("x").join(d.alias("y"), F.col("y.item_id") == F.col("x.item_id") + 1).select(F.col("x.item_id").alias("item_id"), F.col("x.text").alias("a"), F.col("y.text").alias("b"))
    return K.word_diff(pairs, "item_id", "a", "b")


# --- traces -----------------------------------------------------------------------


@query("""
with x as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 as seq from events),
g as (select user_id, min(seq) filter (where event_type = 'purchase') as w, min(seq) filter (where event_type = 'signup') as a, count(*) filter (where event_type = 'error') as e from x group by 1)
select user_id, case when w is null then true else coalesce(a < w, false) end as auth_before_mutate, case when w is null then null else false end as confirm_before_write, true as single_tool_per_turn, e as num_env_errors from g
""")
def policy_flags(t: Tables) -> DataFrame:
    seq = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    calls = t.events.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), (F.col("event_type") == "error").alias("error"), seq.alias("seq")).withColumn("turn", F.col("seq"))
    messages = t.spark.createDataFrame([], f"run_id {dict(t.events.dtypes)['user_id']}, pos long, role string, calls array<struct<id:string,name:string>>, content string")
    d = T.policy_flags(calls, messages, ["purchase"], ["signup"])
    return d.withColumnRenamed("run_id", "user_id")


@query("""
with g as (select user_id, count(*) filter (where event_type = 'purchase') as p, count(*) filter (where event_type = 'signup') as s, count(*) filter (where event_type = 'error') as e, count(*) as n, min(value) < 1 as lost from events group by 1),
f as (select *, case when e < 9 then 'pass' when e < 11 then 'termination' when e < 13 then 'nl_only' when e < 15 then 'db_only' else 'mixed' end as failure, s > 12 as escalated, p < 12 as idle, user_id % 4 as kind from g)
select user_id, case when failure = 'pass' then 'pass' when failure = 'termination' then 'premature_termination' when failure = 'nl_only' then case when escalated then 'bailed_transfer' else 'comm_miss' end
  when idle and lost and escalated then 'identification_failure' when escalated then 'bailed_transfer' when idle then 'stalled_no_action' when kind in (1, 2) then 'wrong_params' when kind = 3 then 'incomplete_multitask' else 'other' end as mechanism from f
""")
def mechanism_rules(t: Tables) -> DataFrame:
    n = lambda e: F.count_if(F.col("event_type") == e)
    g = t.events.groupBy("user_id").agg(n("purchase").alias("p"), n("signup").alias("s"), n("error").alias("e"), (F.min("value") < 1).alias("lost"))
    failure = F.when(F.col("e") < 9, "pass").when(F.col("e") < 11, "termination").when(F.col("e") < 13, "nl_only").when(F.col("e") < 15, "db_only").otherwise("mixed")
    writes = F.when(F.col("p") < 12, F.array().cast("array<string>")).otherwise(F.array(F.lit("purchase")))
    k = F.col("user_id") % 4
    kinds = F.when(k == 1, F.array(F.lit("wrong"))).when(k == 2, F.array(F.lit("extra"), F.lit("missed"))).when(k == 3, F.array(F.lit("missed"))).otherwise(F.array().cast("array<string>"))
    errors = F.when(F.col("lost"), F.array(F.lit("User Not Found"))).otherwise(F.array().cast("array<string>"))
    return g.select("user_id", T.mechanism(failure, F.col("s") > 12, writes, kinds, errors).alias("mechanism"))


@query("""
with s as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type <> 'signup')
select user_id, count(*) as calls, count(*) filter (where event_type = 'error') as errors from s group by 1
""")
def tool_sequences(t: Tables) -> DataFrame:
    e = t.events.where("event_type <> 'signup'")
    call = e.select(F.col("user_id").alias("run_id"), (F.col("event_id") * 2).alias("pos"), F.lit("assistant").alias("role"), F.array(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"))).alias("calls"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(False).alias("error"))
    result = e.select(F.col("user_id").alias("run_id"), (F.col("event_id") * 2 + 1).alias("pos"), F.lit("tool").alias("role"), F.lit(None).cast(call.schema["calls"].dataType).alias("calls"), F.col("event_id").cast("string").alias("tool_call_id"), (F.col("event_type") == "error").alias("error"))
    d = T.tool_sequence(call.unionByName(result))
    return d.groupBy(F.col("run_id").alias("user_id")).agg(F.count("*").alias("calls"), F.count_if("error").alias("errors"))


# --- state -----------------------------------------------------------------------

_STATES = """
i as (select o_orderkey, 'F' as st, o_orderpriority as pr from orders), g as (select o_orderkey, o_orderstatus as st, o_orderpriority as pr from orders where o_orderkey % 10 <> 0),
p as (select o_orderkey, case when o_orderkey % 3 = 0 then 'P' else o_orderstatus end as st, case when o_orderkey % 5 = 0 then 'X' else o_orderpriority end as pr from orders where o_orderkey % 11 <> 0),
u as (select o_orderkey, 'st' as field, st as v, 'i' as s from i union all select o_orderkey, 'pr', pr, 'i' from i union all select o_orderkey, 'st', st, 'g' from g union all select o_orderkey, 'pr', pr, 'g' from g union all select o_orderkey, 'st', st, 'p' from p union all select o_orderkey, 'pr', pr, 'p' from p),
x as (select o_orderkey, field, max(v) filter (where s = 'i') as i, max(v) filter (where s = 'g') as g, max(v) filter (where s = 'p') as p from u group by 1, 2),
d as (select o_orderkey, field, case when p is not distinct from i and g is distinct from i then 'missed' when p is distinct from i and g is not distinct from i then 'extra' else 'wrong' end as kind from x where g is distinct from p)
"""


@query(f"with {_STATES} select * from d")
def state_diff(t: Tables) -> DataFrame:
    o, k = t.orders, F.col("o_orderkey")
    i = o.select("o_orderkey", F.lit("F").alias("st"), F.col("o_orderpriority").alias("pr"))
    g = o.where(k % 10 != 0).select("o_orderkey", F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"))
    p = o.where(k % 11 != 0).select("o_orderkey", F.when(k % 3 == 0, "P").otherwise(F.col("o_orderstatus")).alias("st"), F.when(k % 5 == 0, "X").otherwise(F.col("o_orderpriority")).alias("pr"))
    return Z.kind_rows(["st", "pr"], i, g, p, "o_orderkey")


@query(f"with {_STATES}, k as (select o_orderkey, string_agg(distinct kind || ':orders.*.' || field, ';' order by kind || ':orders.*.' || field) as s from d group by 1) select o.o_orderkey, coalesce(s, 'no_db_diff') as db_signature from orders o left join k using (o_orderkey)")
def state_signature(t: Tables) -> DataFrame:
    d = state_diff(t).select("o_orderkey", "kind", F.array(F.lit("orders"), F.col("o_orderkey").cast("string"), F.col("field")).alias("path"))
    return Z.signatures(d, t.orders, "o_orderkey", ["orders", "st", "pr"]).select("o_orderkey", "db_signature")


@query("""
select c_custkey, case when c_custkey % 3 = 0 then 'missed:orders.*.status' when c_custkey % 3 = 1 then 'extra:orders.*.items[].n;wrong:orders.*.status' else 'no_db_diff' end as db_signature from customer
""")
def state_tree_diff(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    state = lambda s, n: F.format_string('{"orders": {"w%d": {"status": "%s", "items": [{"n": %d}]}}}', k, s, n)
    d = t.customer.select("c_custkey", state(F.lit("a"), F.lit(1)).alias("i"), F.when(k % 3 == 2, state(F.lit("a"), F.lit(1))).otherwise(state(F.lit("b"), F.lit(1))).alias("g"), F.when(k % 3 == 1, state(F.lit("c"), F.lit(2))).otherwise(state(F.lit("a"), F.lit(1))).alias("p"))
    diff = Z.three_way(d, "c_custkey", "i", "g", "p")
    return Z.signatures(diff, d, "c_custkey", ["orders", "status", "items", "n"]).select("c_custkey", "db_signature")


def _apply(state: dict, name: str, args: dict) -> object:
    state[args["type"]] = state.get(args["type"], 0) + 1
    return None


@query("select user_id, count(*) filter (where event_type in ('purchase', 'signup')) as applied from events group by 1")
def replay_fold(t: Tables) -> DataFrame:
    calls = t.events.select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("name"), F.format_string('{"type": "%s"}', "event_type").alias("arguments"), F.lit(None).cast("string").alias("response"))
    initial = t.events.select("user_id").distinct().withColumn("state", F.lit("{}"))
    return Z.replay(calls, initial, "user_id", _apply, ["purchase", "signup"]).select("user_id", "applied")


# --- clusters --------------------------------------------------------------------

_PRED = "x as (select vec_id, label as t, case when vec_id % 7 = 0 then (label + 1) % 10 else label // 2 end as p from embeddings)"


def _pred(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("label").alias("t"), F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.floor(F.col("label") / 2)).cast("int").alias("p"), "embedding")


@query(f"""
with {_PRED}, c as (select t, p, count(*)::double as n from x group by 1, 2), a as (select t, sum(n) as m from c group by 1), b as (select p, sum(n) as m from c group by 1), n as (select sum(n) as n from c),
v as (select (select sum(n * (n - 1) / 2) from c) as cells, (select sum(m * (m - 1) / 2) from a) as tp, (select sum(m * (m - 1) / 2) from b) as pp, (select n * (n - 1) / 2 from n) as al,
  (select -sum(m / n * ln(m / n)) from a, n) as ht, (select -sum(m / n * ln(m / n)) from b, n) as hp, (select -sum(c.n / n.n * ln(c.n / b.m)) from c join b using (p), n) as htp, (select -sum(c.n / n.n * ln(c.n / a.m)) from c join a using (t), n) as hpt),
s as (select (cells - tp * pp / al) / ((tp + pp) / 2 - tp * pp / al) as ari, 1 - htp / ht as h, 1 - hpt / hp as c from v)
select round(ari, 6) as ari, round(h, 6) as homogeneity, round(c, 6) as completeness, round(2 * h * c / (h + c), 6) as v_measure from s
""")
def ari_vmeasure(t: Tables) -> DataFrame:
    d = C.agreement(_pred(t), "t", "p")
    return d.select(*[F.round(c, 6).alias(c) for c in d.columns])


@query(f"""
with {_PRED}, c as (select p, t, count(*) as n from x group by 1, 2), r as (select *, sum(n) over (partition by p)::bigint as size, row_number() over (partition by p order by n desc, t) as r from c) select p as cluster, t as label, size, round(n / size, 6) as purity from r where r = 1
""")
def purity(t: Tables) -> DataFrame:
    return C.purity(_pred(t), "t", "p").withColumn("purity", F.round("purity", 6))


@query(f"with {_PRED}, g as (select p, count(*) as n from x group by 1) select count(*) as clusters, count(*) filter (where n = 1) as singletons, round(max(n) / sum(n), 6) as largest_share, round(avg(n), 6) as mean_size from g")
def cluster_structure(t: Tables) -> DataFrame:
    d = C.structure(_pred(t), "p")
    return d.select("clusters", "singletons", F.round("largest_share", 6).alias("largest_share"), F.round("mean_size", 6).alias("mean_size"))


@query("""
with u as (select vec_id as key, label as c, list_transform(embedding, lambda x: x::double) as v from embeddings), n as (select label as c, count(*) as n from embeddings group by 1),
d as (select a.key, a.c as own, b.c, sum(1 - list_cosine_similarity(a.v, b.v)) as s, count(*) as n from u a, u b where a.key <> b.key group by 1, 2, 3),
g as (select key, any_value(own) as own, max(case when c = own then s / n end) as a, min(case when c <> own then s / n end) as b from d group by 1)
select key, round(case when a is null or b is null then 0 else (b - a) / greatest(a, b) end, 6) as silhouette from g
""")
def silhouette(t: Tables) -> DataFrame:
    return C.silhouette(t.embeddings, "vec_id", "label", "embedding").select("key", F.round("silhouette", 6).alias("silhouette"))


@query("""
with p as (select label as cluster, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as k from embeddings), m as (select cluster, k, avg(x) as x from p group by 1, 2)
select cluster, round(sum(x * x), 6) as square, count(*) as dims from m group by 1
""")
def cluster_centroids(t: Tables) -> DataFrame:
    from tracemill.operators.retrieval import dot

    d = C.centroids(t.embeddings, "label", "embedding")
    return d.select("cluster", F.round(dot(F.col("centroid"), F.col("centroid")), 6).alias("square"), long(F.size("centroid")).alias("dims"))


@query()
def agglomerative(t: Tables) -> DataFrame:
    return C.cluster_groups(t.embeddings, "vec_id", "embedding", "label")


@query()
def density_clusters(t: Tables) -> DataFrame:
    return C.cluster_groups(t.embeddings, "vec_id", "embedding", "label", algorithm="density").drop("threshold")


@query()
def diverse_sample(t: Tables) -> DataFrame:
    d = t.events.select("event_id", "user_id", "event_type", (F.col("user_id") % 20).alias("task"), F.col("props").alias("chain"))
    return C.diverse(d, 12, "event_type", "task", "chain", "user_id", "event_id").select("event_type", "event_id", "pick")


@query("""
with m as (select user_id, event_type as name, user_id % 9 as task, value > 80 as fail from events), k as (select *, case when fail then name else 'pass' end as nm from m),
t as (select nm, task, avg(case when fail then 1.0 else 0.0 end) as rate, count(*) as n from k group by 1, 2), g as (select nm as name, avg(rate) as failure_rate, sum(n)::bigint as count, count(*) as tasks from t group by 1)
select name, failure_rate, count, tasks, printf('l0_%03d', row_number() over (order by name) - 1) as id from g
""")
def cluster_level0(t: Tables) -> DataFrame:
    fail = F.col("value") > 80
    d = t.events.select((F.col("user_id") % 9).alias("task_id"), F.col("event_type").alias("mechanism"), F.when(fail, "db_only").otherwise("pass").alias("failure_type"))
    return C.level0(d).select("name", "failure_rate", "count", "tasks", "id")


@query("""
with g as (select event_type as mechanism, 'k' || (event_id % 997) as signature, count(*) as count, count(distinct user_id) as tasks from events where value > 80 group by 1, 2)
select *, printf('c_%03d', row_number() over (order by count desc, mechanism, signature) - 1) as id from g
""")
def cluster_level1(t: Tables) -> DataFrame:
    d = t.events.select(F.col("user_id").alias("task_id"), F.col("event_type").alias("mechanism"), F.concat(F.lit("k"), (F.col("event_id") % 997).cast("string")).alias("signature"), F.when(F.col("value") > 80, "db_only").otherwise("pass").alias("failure_type"))
    return C.level1(d)


# --- changes of tables -----------------------------------------------------------------


@query("select s_suppkey, s_name, s_acctbal from supplier union all select 1000000 + s_suppkey, 'new', 0.0 from supplier where s_suppkey < 5")
def dml_insert(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    fresh = s.where("s_suppkey < 5").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), F.lit("new").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return D.insert_absent(s, fresh.unionByName(s.where("s_suppkey < 10").withColumn("s_name", F.lit("ignored"))), ["s_suppkey"])


@query("select s_suppkey, case when s_suppkey % 10 = 0 then 'changed' else s_name end as s_name, s_acctbal from supplier")
def dml_upsert(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    return D.upsert(s, s.where("s_suppkey % 10 = 0").withColumn("s_name", F.lit("changed")), ["s_suppkey"])


@query("select s_suppkey, case when s_suppkey = 7 then 'renamed' else s_name end as s_name, case when s_suppkey = 7 then 'gold' end as tier, case when s_suppkey % 2 = 0 then s_acctbal + 1 else s_acctbal end as s_acctbal from supplier")
def dml_update(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    s = D.update_from(s, s.where("s_suppkey % 2 = 0").select("s_suppkey", (F.col("s_acctbal") + 1).alias("s_acctbal")), ["s_suppkey"])
    return D.update_by_key(s, "s_suppkey", 7, {"s_name": "renamed", "tier": "gold"})


@query("select s_suppkey, s_acctbal < 0 as deleted from supplier")
def dml_delete(t: Tables) -> DataFrame:
    kept, gone = D.delete_where(t.supplier, F.col("s_acctbal") < 0)
    return kept.select("s_suppkey", F.lit(False).alias("deleted")).unionByName(gone.select("s_suppkey", F.lit(True).alias("deleted")))


@query("with x as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) select user_id, event_id, event_type from x where r = 1")
def ledger_latest(t: Tables) -> DataFrame:
    return D.latest(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""
with a as (select o_custkey, bool_or(o_orderstatus = 'O' and date_diff('day', o_orderdate::date, date '1998-01-01') >= 500) as seasoned, bool_or(o_orderstatus = 'P' or o_totalprice < 2000) as barred from orders group by 1)
select o_custkey as user_id, seasoned and not barred as eligible, seasoned, barred from a
""")
def guard_eligibility(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "Closed").otherwise("frozen")
    d = t.orders.select(F.col("o_custkey").alias("user_id"), status.alias("status"), F.date_format("o_orderdate", "MM/dd/yyyy").alias("date_opened"), F.format_string("$%.2f", F.col("o_totalprice") - 2000).alias("balance"))
    return G.account_eligibility(d, "1998-01-01", 500)


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P') and c_mktsegment not in ('BUILDING')")
def guard_pending(t: Tables) -> DataFrame:
    pending = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status"))
    d = G.without_pending(t.customer, "c_custkey", (pending, ["PENDING", "in_review"]))
    return d.where(G.in_standing(F.col("c_mktsegment"), ["building"])).select("c_custkey")


@query("""
with p as (select o_custkey, count(*) filter (where o_orderstatus = 'P') as pending, count(*) filter (where o_orderstatus = 'F') as active from orders group by 1)
select c_custkey, case when coalesce(pending, 0) > 0 then 'pending_order' when coalesce(active, 0) >= 8 then 'card_limit' when c_acctbal < 25 then 'minimum_balance' when c_nationkey * 20.0 > c_acctbal then 'fee_above_balance' else 'ok' end as rule
from customer left join p on o_custkey = c_custkey
""")
def guard_order(t: Tables) -> DataFrame:
    a = t.customer.select("c_custkey", F.col("c_acctbal").alias("balance"), "c_nationkey")
    of = lambda s, n: t.orders.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("c_custkey"), F.lit(n).alias("status"))
    return G.order_guard(a, of("P", "pending"), of("F", "Active"), "c_custkey", F.col("c_nationkey") * 20.0, most_cards=8)


@query("""
with x as (select p_partkey, ['2G', '3G', '4G', '5G'][p_size % 4 + 1] as net, ['none', 'poor', 'fair', 'good', 'excellent'][p_size % 5 + 1] as sig, p_size % 3 = 0 as vpn, p_size % 7 = 0 as saver from part),
y as (select *, round(case net when '2G' then 0.25 when '3G' then 3.0 when '4G' then 55.0 else 275.0 end * case sig when 'none' then 0 when 'poor' then 0.2 when 'fair' then 0.5 when 'good' then 0.8 else 1.0 end * case when vpn then 0.1 else 1.0 end * case when saver then 0.2 else 1.0 end, 2)::double as speed from x)
select p_partkey, speed, case when speed < 1 then 'Very Poor' when speed < 5 then 'Poor' when speed < 25 then 'Fair' when speed < 100 then 'Good' else 'Excellent' end as band from y
""")
def speed_test(t: Tables) -> DataFrame:
    pick = lambda *x: F.get(F.array(*[F.lit(v) for v in x]), (F.col("p_size") % len(x)).cast("int"))
    speed, band = G.speed_test(pick("2G", "3G", "4G", "5G"), pick("none", "poor", "fair", "good", "excellent"), F.col("p_size") % 3 == 0, F.col("p_size") % 7 == 0)
    return t.part.select("p_partkey", speed.alias("speed"), band.alias("band"))
