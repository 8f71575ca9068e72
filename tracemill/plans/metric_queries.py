"""Metrics and predicates on the test tables: a customer's orders stand for a task's trials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions.values import money, money_text
from tracemill.operators import metrics as M
from tracemill.operators import predicates as P
from tracemill.operators import retrieval as R
from tracemill.plans.registry import Tables, long, query



def done():
    return F.col("o_orderstatus") == "F"


@query("""
with t as (select o_custkey, count(*) as n, count(*) filter (where o_orderstatus = 'F') as c from orders group by 1 having count(*) >= 3)
select o_custkey, n, c, round(c / n, 9) as pass_1,
       round(case when c < 2 then 0 else c * (c - 1) / (n * (n - 1.0)) end, 9) as pass_2,
       round(case when c < 3 then 0 else c * (c - 1) * (c - 2) / (n * (n - 1) * (n - 2.0)) end, 9) as pass_3 from t
""")
def passk_by_task(t: Tables) -> DataFrame:
    d = M.pass_table(t.orders, "o_custkey", done(), (1, 2, 3)).where("n >= 3")
    return d.select("o_custkey", "n", "c", *[F.round(f"pass_{k}", 9).alias(f"pass_{k}") for k in (1, 2, 3)])


@query("""
with t as (select o_custkey, count(*) as n, count(*) filter (where o_orderstatus = 'F') as c from orders group by 1 having count(*) >= 3)
select c_mktsegment, count(*) as tasks, round(avg(c / n), 6) as pass_1,
       round(avg(case when c < 2 then 0 else c * (c - 1) / (n * (n - 1.0)) end), 6) as pass_2,
       round(avg(case when c < 3 then 0 else c * (c - 1) * (c - 2) / (n * (n - 1) * (n - 2.0)) end), 6) as pass_3
from t join customer on o_custkey = c_custkey group by 1
""")
def passk_macro(t: Tables) -> DataFrame:
    d = M.pass_table(t.orders, "o_custkey", done(), (1, 2, 3)).where("n >= 3")
    d = d.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    return d.groupBy("c_mktsegment").agg(F.count("*").alias("tasks"), *[F.round(F.avg(f"pass_{k}"), 6).alias(f"pass_{k}") for k in (1, 2, 3)])


@query("""
with t as (select o_custkey, count(*) as n, max(c_nationkey % 5 + 8) as d from orders join customer on o_custkey = c_custkey group by 1 having count(*) >= 4)
select least(max(d), min(n))::bigint as max_k from t
""")
def max_k_rule(t: Tables) -> DataFrame:
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    busy = d.groupBy("o_custkey").agg(F.count("*").alias("runs")).where("runs >= 4").select("o_custkey")
    return M.max_k(d.join(busy, "o_custkey", "left_semi"), "o_custkey", F.col("c_nationkey") % 5 + 8)


@query("""
select l_orderkey, l_linenumber, o_custkey, o_orderstatus, c_mktsegment, l_quantity from lineitem
left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey
""")
def run_task_left(t: Tables) -> DataFrame:
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    d = d.join(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    d = d.join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return d.select("l_orderkey", "l_linenumber", "o_custkey", "o_orderstatus", "c_mktsegment", "l_quantity")


@query("""
with c as (select *, case when c_custkey % 7 = 0 then null else c_mktsegment end as seg from customer)
select op, n from (
  select count(*) filter (where seg is not distinct from 'BUILDING') as eq, count(*) filter (where seg is distinct from 'BUILDING') as ne,
    count(*) filter (where c_acctbal > 5000) as gt, count(*) filter (where c_acctbal >= 5000) as gte, count(*) filter (where c_acctbal < 0) as lt, count(*) filter (where c_acctbal <= 0) as lte,
    count(*) filter (where contains(seg, 'I')) as contains, count(*) filter (where starts_with(c_name, 'Customer')) as startswith, count(*) filter (where ends_with(c_custkey::varchar, '7')) as endswith,
    count(*) filter (where seg in ('BUILDING', 'MACHINERY') or seg is null) as "in", count(*) filter (where not (seg in ('BUILDING', 'MACHINERY')) or seg is null) as nin,
    count(*) filter (where seg is not distinct from 'BUILDING') as unknown, 0 as mismatch, count(*) as missing
  from c) unpivot (n for op in (eq, ne, gt, gte, lt, lte, contains, startswith, endswith, "in", nin, unknown, mismatch, missing))
""")
def constraint_ops(t: Tables) -> DataFrame:
    c = t.customer.withColumn("seg", F.when(F.col("c_custkey") % 7 == 0, None).otherwise(F.col("c_mktsegment")))
    tests = {
        "eq": {"seg": "BUILDING"}, "ne": {"seg__ne": "BUILDING"}, "gt": {"c_acctbal__gt": 5000}, "gte": {"c_acctbal__gte": 5000}, "lt": {"c_acctbal__lt": 0}, "lte": {"c_acctbal__lte": 0},
        "contains": {"seg__contains": "I"}, "startswith": {"c_name__startswith": "Customer"}, "endswith": {"c_custkey__endswith": 7}, "in": {"seg__in": ["BUILDING", "MACHINERY", None]},
        "nin": {"seg__nin": ["BUILDING", "MACHINERY"]}, "unknown": {"seg__like": "BUILDING"}, "mismatch": {"c_acctbal__gt": "5000"}, "missing": {"nothing__eq": None},
    }
    d = c.agg(*[F.count_if(P.compile_constraints(c.schema, k)).alias(n) for n, k in tests.items()])
    return d.unpivot([], list(tests), "op", "n")


@query("select c_custkey, c_acctbal from customer where c_acctbal >= 1000 and contains(c_name, '1') and c_mktsegment in ('BUILDING', 'AUTOMOBILE') order by c_custkey limit 50")
def constraint_query(t: Tables) -> DataFrame:
    catalog = P.Catalog({"customer": t.customer})
    text = '{"c_acctbal__gte": 1000, "c_name__contains": "1", "c_mktsegment__in": ["BUILDING", "AUTOMOBILE"]}'
    return catalog.query_json("customer", text, order=["c_custkey"], limit=50).select("c_custkey", "c_acctbal")


@query("select c_custkey, c_name from customer where lower(c_mktsegment) = 'building' and c_nationkey = 7 order by c_custkey limit 1")
def first_case_match(t: Tables) -> DataFrame:
    return P.first_match(t.customer.where("c_nationkey = 7"), "c_custkey", c_mktsegment="Building").select("c_custkey", "c_name")


@query("select p_partkey, p_size from part where p_brand = 'Brand#1' or (p_brand <> '' and p_size >= 40 and starts_with(p_type, 'S'))")
def optional_filters(t: Tables) -> DataFrame:
    a = P.optional_filter(t.part, p_brand="Brand#1", p_size__gte=None)
    b = P.optional_filter(t.part, p_size__gte=40, p_type__startswith="S", p_brand__ne="Brand#1")
    return a.unionByName(b).select("p_partkey", "p_size")


@query("""
select c_custkey from customer where c_mktsegment = 'BUILDING' and c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')
order by c_custkey limit 100
""")
def task_selection(t: Tables) -> DataFrame:
    split = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return P.select_tasks(t.customer.where("c_mktsegment = 'BUILDING'"), split=split, first=100, key="c_custkey", order="c_custkey").select("c_custkey")


@query("""
with x as (select case l_linenumber % 4 when 0 then 1.0 when 1 then 0.9995 when 2 then 1.0000005 else 0.5 end as r from lineitem)
select count(*) filter (where r between 1 - 1e-6 and 1 + 1e-6) as near_one, count(*) filter (where r >= 0.999) as threshold, count(*) filter (where r = 1.0) as exact from x
""")
def success_predicates(t: Tables) -> DataFrame:
    k = F.col("l_linenumber") % 4
    r = F.when(k == 0, 1.0).when(k == 1, 0.9995).when(k == 2, 1.0000005).otherwise(0.5)
    return t.lineitem.select(r.alias("r")).agg(F.count_if(M.successful(F.col("r"))).alias("near_one"), F.count_if(M.passed(F.col("r"))).alias("threshold"), F.count_if(M.exactly_one(F.col("r"))).alias("exact"))


@query("select count(*) filter (where url glob 'http*example.com/*' and not url glob '*/fr/*') as allowed, count(*) as n from pages")
def path_allowlist(t: Tables) -> DataFrame:
    return t.pages.agg(F.count_if(P.allowed(F.col("url"), ["http*example.com/*"], ["*/fr/*"])).alias("allowed"), F.count("*").alias("n"))


@query("""
select event_type, count(*) as n, count(*) filter (where value > 50) as high, count(*) filter (where value <= 50) as low, count(distinct user_id) as users,
       count(*) filter (where props is null) as no_props from events group by 1
""")
def cond_counts(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value") <= 50).alias("low"),
        F.count_distinct("user_id").alias("users"), F.count_if(F.col("props").isNull()).alias("no_props"),
    )


@query("""
select user_id,
  arg_max(event_type, (case event_type when 'error' then 2 when 'purchase' then 1 else 0 end) * 1e12 - event_id) as worst
from events group by 1
""")
def severity_rank(t: Tables) -> DataFrame:
    s = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "minor").otherwise(F.col("event_type"))
    d = t.events.groupBy("user_id").agg(M.agent_max_severity(s, F.col("event_id")).alias("worst"))
    return d.select("user_id", F.when(F.col("worst") == "critical", "error").when(F.col("worst") == "minor", "purchase").otherwise(F.col("worst")).alias("worst"))


@query("""
select user_id,
  arg_max(event_type, case event_type when 'error' then 2e12 + event_id when 'purchase' then 1e12 - event_id else -event_id end) as worst
from events group by 1
""")
def severity_last_critical(t: Tables) -> DataFrame:
    s = F.when(F.col("event_type") == "error", "critical_helped").when(F.col("event_type") == "purchase", "minor").otherwise(F.col("event_type"))
    d = t.events.groupBy("user_id").agg(M.user_max_severity(s, F.col("event_id")).alias("worst"))
    return d.select("user_id", F.when(F.col("worst") == "critical_helped", "error").when(F.col("worst") == "minor", "purchase").otherwise(F.col("worst")).alias("worst"))


@query("""
select user_id, coalesce(arg_min(event_type, (case when value > 95 then value else 1e9 end, event_id)) filter (where event_type in ('error', 'purchase')), 'none') as first_source from events group by 1
""")
def first_critical(t: Tables) -> DataFrame:
    at = F.when(F.col("value") > 95, F.col("value"))
    return t.events.groupBy("user_id").agg(M.first_critical(F.col("event_type"), F.col("event_type").isin("error", "purchase"), at, F.col("event_id")).alias("first_source"))


@query("""
with x as (select l_returnflag, l_linestatus, l_quantity > 25 as hit from lineitem), n as (select count(*) as n from x)
select l_returnflag, count(*) as n, round(count(*) filter (where hit and l_linestatus = 'F') / nullif(count(*) filter (where l_linestatus = 'F'), 0), 6) as "rate_F",
       round(count(*) filter (where hit and l_linestatus = 'O') / nullif(count(*) filter (where l_linestatus = 'O'), 0), 6) as "rate_O", round(count(*) / any_value(n.n), 6) as frequency
from x, n group by 1
""")
def action_pivot(t: Tables) -> DataFrame:
    d = M.rate_pivot(t.lineitem, ["l_returnflag"], "l_linestatus", ["F", "O"], F.col("l_quantity") > 25)
    return d.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("rate_F", "rate_O", "frequency")])


@query("select p_brand, round(avg(p_retailprice), 6) as mean, round(stddev_samp(p_retailprice), 6) as std_samp, round(stddev_pop(p_retailprice), 6) as std_pop from part group by 1")
def std_pop_samp(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("mean"), F.round(F.stddev_samp("p_retailprice"), 6).alias("std_samp"), F.round(F.stddev_pop("p_retailprice"), 6).alias("std_pop"))


@query("""
with s as (select distinct o_orderpriority from orders), f as (select unnest(['F', 'O', 'P', 'X']) as o_orderstatus),
g as (select s.o_orderpriority, f.o_orderstatus, count(o_orderkey) as n from s cross join f left join orders o on o.o_orderpriority = s.o_orderpriority and o.o_orderstatus = f.o_orderstatus group by 1, 2)
select *, round(n * 100.0 / sum(n) over (), 6) as percent from g
""")
def value_counts_norm(t: Tables) -> DataFrame:
    spine = t.orders.select("o_orderpriority").distinct().withColumn("o_orderstatus", F.explode(F.array(*[F.lit(x) for x in "FOPX"])))
    d = M.value_counts(t.orders, ["o_orderpriority", "o_orderstatus"], spine)
    return d.select("o_orderpriority", "o_orderstatus", "n", F.round("percent", 6).alias("percent"))


@query("""
select doc_id, case when doc_id % 5 = 0 then 0.0 else quality * (1.0 - toxic) end as reward, quality::double as one_component,
       case when doc_id % 3 = 0 then null else quality = 1 end as component from labels
""")
def recombine_reward(t: Tables) -> DataFrame:
    breakdown = F.create_map(F.lit("Q"), F.col("quality").cast("double"), F.lit("T"), F.lit(1.0) - F.col("toxic"))
    reason = F.when(F.col("doc_id") % 5 == 0, "max_steps").otherwise("user_stop")
    basis = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("T"))).otherwise(F.array(F.lit("Q"), F.lit("T")))
    return t.labels.select("doc_id", M.recombine(breakdown, ["Q", "T", "ABSENT"], reason).alias("reward"), M.recombine(breakdown, ["Q"]).alias("one_component"), M.component_success(breakdown, basis, "Q").alias("component"))


@query("""
select o_custkey, count(*) filter (where o_orderstatus = 'F') as passes, count(*) filter (where o_orderstatus <> 'F') as fails,
       arg_min(o_orderkey, (o_orderdate, o_orderkey)) filter (where o_orderstatus = 'F') as first_pass,
       arg_min(o_orderkey, (o_orderdate, o_orderkey)) filter (where o_orderstatus <> 'F') as first_fail
from orders group by 1 having passes > 0 and fails > 0
""")
def flaky_tasks(t: Tables) -> DataFrame:
    return M.flaky(t.orders, "o_custkey", done(), "o_orderkey", F.struct("o_orderdate", "o_orderkey"))


@query("""
select o_custkey, count(*) as n from orders group by 1 having min(case when o_orderstatus <> 'P' then 1.0 else 0.0 end) >= 0.999 order by o_custkey::varchar limit 20
""")
def stable_top_n(t: Tables) -> DataFrame:
    return M.stable_pass(t.orders, "o_custkey", F.when(F.col("o_orderstatus") != "P", 1.0).otherwise(0.0), 20).select("o_custkey", "n")


@query("select o_custkey, max(o_totalprice) as best from orders group by 1")
def max_reward(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))


@query("""
with n as (select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1) select * from n where n <> 10
""")
def trial_audit(t: Tables) -> DataFrame:
    return M.trial_audit(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", 10)


@query("""
with g as (select user_id, event_type, count(*) as n from events group by 1, 2),
r as (select *, row_number() over (partition by user_id order by n desc, event_type) as r from g)
select user_id, string_agg(event_type || ':' || n, ',' order by r) as top from r where r <= 3 group by 1
""")
def group_top_values(t: Tables) -> DataFrame:
    return M.top_values(t.events, ["user_id"], "event_type", 3)


@query("""
select l_orderkey, case when bool_or(l_linenumber <= 6 and l_quantity > 49) then null else coalesce(sum(case when l_linenumber <= 6 and l_linenumber % 2 = 1 then l_quantity end), 0.0) end as agent_cost,
       case when bool_or(l_linenumber <= 6 and l_quantity > 49) then null else coalesce(sum(case when l_linenumber <= 6 and l_linenumber % 2 = 0 then l_quantity end), 0.0) end as user_cost,
       sum(case when l_linenumber <> 3 then l_suppkey end)::bigint as tokens
from lineitem group by 1
""")
def cost_totals(t: Tables) -> DataFrame:
    k = F.col("l_linenumber")
    role = F.when(k > 6, "tool").when(k % 2 == 1, "assistant").otherwise("user")
    m = t.lineitem.select("l_orderkey", role.alias("role"), F.when(F.col("l_quantity") <= 49, F.col("l_quantity")).alias("cost"), F.when(k != 3, F.col("l_suppkey")).alias("tokens"))
    return M.cost_totals(m, "l_orderkey")


@query("""
with t as (select c_mktsegment, o_custkey, 1 - avg(case when o_orderstatus = 'F' then 1.0 else 0.0 end) as rate, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2)
select c_mktsegment, round(avg(rate), 6) as failure_rate, count(*) as tasks, sum(n)::bigint as runs from t group by 1
""")
def fail_rate_macro(t: Tables) -> DataFrame:
    d = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return M.macro_failure_rate(d, ["c_mktsegment"], "o_custkey", done()).withColumn("failure_rate", F.round("failure_rate", 6))


@query("""
with g as (select user_id, event_type, count(*) as n, min(event_id) as seen from events group by 1, 2)
select user_id, arg_max(event_type, n * 1e12 - seen) as event_type, max(n) as n from g group by 1
""")
def dominant_label(t: Tables) -> DataFrame:
    return M.dominant(t.events, ["user_id"], "event_type", F.col("event_id"))


@query("""
select c_nationkey, count(*) filter (where c_custkey % 3 = 1) as auth_missing, count(*) filter (where c_custkey % 4 = 1) as confirm_missing,
       count(*) filter (where c_custkey % 5 = 0) as multi_tool_turn, count(*) filter (where c_custkey % 6 > 3) as env_errors from customer group by 1
""")
def flag_summary(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    tri = lambda n: F.when(k % n == 0, None).when(k % n == 1, False).otherwise(True)
    d = t.customer.select("c_nationkey", tri(3).alias("auth_before_mutate"), tri(4).alias("confirm_before_write"), (k % 5 != 0).alias("single_tool_per_turn"), F.when(k % 6 > 3, 2).otherwise(0).alias("num_env_errors"))
    return M.flag_counts(d, ["c_nationkey"])


@query("""
select (select count(*) from customer) as customers, (select count(*) from orders) as orders, (select sum(len(embedding))::bigint from embeddings) as numbers,
       (select count(distinct conv_id) from conversations) as conversations
""")
def table_statistics(t: Tables) -> DataFrame:
    one = lambda d, e, n: d.agg(e.alias(n))
    d = one(t.customer, F.count("*"), "customers").crossJoin(one(t.orders, F.count("*"), "orders"))
    return d.crossJoin(one(t.embeddings, F.sum(long(F.size("embedding"))), "numbers")).crossJoin(one(t.conversations, F.count_distinct("conv_id"), "conversations"))


@query("select o_orderpriority, round(avg(o_totalprice), 4) as mean_cost, round(sum(o_totalprice), 2) as total_cost, count(*) as n from orders group by 1")
def cost_by_model(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_cost"), F.round(F.sum("o_totalprice"), 2).alias("total_cost"), F.count("*").alias("n"))


@query("""
select o_orderpriority, round(avg(o_totalprice) filter (where o_orderstatus = 'F'), 4) as "F", round(avg(o_totalprice) filter (where o_orderstatus = 'O'), 4) as "O",
       round(avg(o_totalprice) filter (where o_orderstatus = 'P'), 4) as "P" from orders group by 1
""")
def trial_pivot(t: Tables) -> DataFrame:
    d = t.orders.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return d.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in "FOP"])


@query("select event_type, count(*) filter (where value > 90) / count(value) as failed, count(value) as known from events group by 1")
def failure_proportions(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg((F.count_if(F.col("value") > 90) / F.count("value")).alias("failed"), F.count("value").alias("known"))


@query("select c_custkey, round(c_acctbal, 2) as parsed, 0.0 as broken from customer")
def money_parse(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", money(F.format_string("$%,.2f", "c_acctbal")).alias("parsed"), money(F.lit("n/a")).alias("broken"))


@query("select c_custkey, case when c_acctbal < 0 then '$-' else '$' end || printf('%.2f', abs(c_acctbal)) as text from customer")
def money_format(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", money_text(F.col("c_acctbal")).alias("text"))


@query("select label, count(*) as entries, sum(len(embedding))::bigint as numbers from embeddings group by 1")
def cache_stats(t: Tables) -> DataFrame:
    d = R.cache_stats(t.embeddings, ["label"])
    return d.select("label", "entries", long("numbers").alias("numbers"))
