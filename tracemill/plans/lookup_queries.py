"""Lookups, guards, domain operations, experiments and tick helpers on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.domains import telecom
from tracemill.functions import text as X
from tracemill.operators import dml as D
from tracemill.operators import guards as G
from tracemill.operators import metrics as M
from tracemill.operators import predicates as P
from tracemill.operators import reports as Y
from tracemill.operators import statediff as SD
from tracemill.operators import traces as TR
from tracemill.plans.registry import Tables, long, query
from tracemill.streaming import streams as S
from tracemill.streaming import ticks as K

# --- lookups -------------------------------------------------------------------


@query("select 'nation' as name, (select count(*) from nation) as n union all values ('part', (select count(*) from part)), ('region', (select count(*) from region))")
def catalog_listing(t: Tables) -> DataFrame:
    c = P.Catalog({"part": t.part, "region": t.region, "nation": t.nation})
    out = None
    for name in c.names():
        d = c.fetch(name).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = d if out is None else out.unionByName(d)
    return out


@query("select c_custkey, c_name from customer where c_custkey = 42 union all select n_nationkey, n_name from nation where n_name = 'FRANCE'")
def point_lookups(t: Tables) -> DataFrame:
    a = P.point_lookup(t.customer, "c_custkey", 42).select("c_custkey", "c_name")
    b = P.point_lookup(t.nation, "n_name", "FRANCE").select(F.col("n_nationkey").cast("long").alias("c_custkey"), F.col("n_name").alias("c_name"))
    return a.withColumn("c_custkey", long("c_custkey")).unionByName(b)


@query("select 'C' || c_custkey as id, c_name as name from customer where c_custkey = 17 union all select 'P' || p_partkey, p_name from part where p_partkey = 23")
def routed_lookups(t: Tables) -> DataFrame:
    """The table follows from the id's first letter."""
    c = t.customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    p = t.part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    tables = {"C": (c, "id"), "P": (p, "id")}
    return P.routed_lookup(tables, "C17").unionByName(P.routed_lookup(tables, "P23"))


@query("select c_custkey, c_name from customer where lower(c_mktsegment) = 'building'")
def all_case_matches(t: Tables) -> DataFrame:
    return P.all_matches(t.customer, c_mktsegment="BuildinG").select("c_custkey", "c_name")


@query("select ps as item_id, p_partkey, p_size * k as price from part, (select unnest(['a', 'b']) as ps, unnest([2, 3]) as k) where p_size * k > 60")
def nested_item_search(t: Tables) -> DataFrame:
    """Items of a map column across all parents."""
    item = lambda k: F.struct((F.col("p_size") * k).alias("price"))
    d = t.part.withColumn("items", F.create_map(F.lit("a"), item(2), F.lit("b"), item(3)))
    return P.nested_items(d, "items", "p_partkey").select("item_id", "p_partkey", "item.price").where("price > 60")


@query("select count(*) as n, count(*) filter (where o_clerk is null) as without_reason from (select case when o_orderstatus = 'P' then null else o_orderstatus end as o_clerk from orders) where o_clerk is distinct from 'O'")
def infra_excluded(t: Tables) -> DataFrame:
    """Infrastructure errors leave before any metric; rows without a reason stay."""
    reason = F.when(F.col("o_orderstatus") == "O", M.INFRA).when(F.col("o_orderstatus") == "F", "user_stop")
    return M.evaluated(t.orders.select(reason.alias("termination_reason"))).agg(F.count("*").alias("n"), F.count_if(F.col("termination_reason").isNull()).alias("without_reason"))


# --- telecom -------------------------------------------------------------------


def _telecom(t: Tables) -> dict[str, DataFrame]:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    own = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(key("L", "o_orderkey"))).alias("line_ids"), F.sort_array(F.collect_list(key("B", "o_orderkey"))).alias("bill_ids"))
    customers = t.customer.join(own, F.col("c_custkey") == F.col("o_custkey")).select(key("C", "c_custkey").alias("customer_id"), F.col("c_name").alias("full_name"), F.col("c_custkey").cast("string").alias("phone_number"), "line_ids", "bill_ids")
    lines = t.orders.select(key("L", "o_orderkey").alias("line_id"), F.concat(F.lit("555"), F.col("o_orderkey").cast("string")).alias("phone_number"), (F.col("o_orderkey") % 3).alias("plan_id"), F.when(F.col("o_orderstatus") == "O", "Active").when(F.col("o_orderstatus") == "F", "Suspended").otherwise("Closed").alias("status"), F.lit(None).cast("string").alias("suspension_start"), (F.col("o_orderkey") % 2 == 0).alias("roaming_enabled"), (F.col("o_orderkey") % 10 / 2).alias("data_used_gb"), F.lit(0.0).alias("data_refueling_gb"))
    bills = t.orders.select(key("B", "o_orderkey").alias("bill_id"), key("C", "o_custkey").alias("customer_id"), F.when(F.col("o_orderkey") % 97 == 0, "Awaiting Payment").otherwise("Paid").alias("status"), F.col("o_orderdate").cast("date").alias("issue_date"), F.col("o_totalprice").alias("total_due"))
    plans = t.spark.createDataFrame([(0, 5.0, 2.0), (1, 10.0, 3.0), (2, 20.0, 4.0)], "plan_id long, data_limit_gb double, refuel_price double")
    return {"customers": customers, "lines": lines, "bills": bills, "plans": plans}


@query("select 'B' || o_orderkey as bill_id, o_totalprice as total_due from orders where o_custkey = (select min(o_custkey) from orders) order by o_orderdate desc, 'B' || o_orderkey limit 12")
def newest_bills(t: Tables) -> DataFrame:
    """A customer's bills, newest first, twelve at most."""
    d = _telecom(t)
    least = t.orders.agg(F.min("o_custkey")).first()[0]
    return telecom.bills_of(d["customers"], d["bills"], f"C{least}").select("bill_id", "total_due")


@query("""
with o as (select min(o_orderkey) as k from orders)
select 'L' || o_orderkey as line_id, (o_orderkey % 10 / 2.0)::double as data_used_gb, [5.0, 10.0, 20.0][(o_orderkey % 3 + 1)::int]::double as data_limit_gb from orders, o where o_orderkey = k
""")
def line_usage(t: Tables) -> DataFrame:
    """Customer, line and plan in one chain, for a line that the customer owns."""
    d = _telecom(t)
    k = t.orders.agg(F.min_by(F.struct("o_orderkey", "o_custkey"), "o_orderkey").alias("x")).first()["x"]
    out = telecom.data_usage(d["customers"], d["lines"], d["plans"], f"C{k.o_custkey}", f"L{k.o_orderkey}", "2025-02-25")
    return out.select("line_id", "data_used_gb", "data_limit_gb")


@query("select 'L' || o_orderkey as line_id, case when o_orderkey % 5 = 0 then 'no_line' when o_orderstatus <> 'O' then 'not_active' else 'ok' end as rule, case when o_orderstatus = 'O' and o_orderkey % 5 <> 0 or o_orderstatus = 'F' then 'Suspended' when o_orderstatus = 'O' then 'Active' else 'Closed' end as status from orders")
def suspend_lines(t: Tables) -> DataFrame:
    """Lines are suspended if their customer asks; each request says what came of it."""
    d = _telecom(t)
    asks = t.orders.select(F.concat(F.lit("C"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(-1)).otherwise(F.col("o_custkey")).cast("string")).alias("customer_id"), F.concat(F.lit("L"), F.col("o_orderkey").cast("string")).alias("line_id"))
    lines, outcome = telecom.suspend_lines(d["customers"], d["lines"], asks, "2025-02-25")
    return outcome.join(lines.select("line_id", "status"), "line_id")


# --- guards -----------------------------------------------------------------------


@query("""
select o_orderkey::varchar as request_id, case when not regexp_full_match((o_orderkey % 20000)::varchar, '[0-9]{4}') then 'last4' when o_custkey % 11 = 0 then 'cvv' when o_orderkey % 3 <> 0 then 'wrong_tool' when o_orderstatus <> 'O' then 'account_not_open' else 'ok' end as rule from orders
""")
def activation_rules(t: Tables) -> DataFrame:
    d = t.orders.select(
        F.col("o_orderkey").cast("string").alias("request_id"),
        F.col("o_orderkey").alias("account_id"),
        (F.col("o_orderkey") % 20000).cast("string").alias("last4"),
        F.when(F.col("o_custkey") % 11 == 0, "12").otherwise("123").alias("cvv"),
        F.lit("07/29").alias("expiry"),
        F.when(F.col("o_orderkey") % 3 == 0, "lost").otherwise("new").alias("issue_reason"),
    )
    accounts = t.orders.select(F.col("o_orderkey").alias("account_id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("frozen").alias("status"))
    return G.activation_guard(d, accounts, {"lost": "replace", "new": "first"}, "replace")


@query("""
select o_orderkey as account_id, case when o_orderkey % 2 = 0 and date_diff('day', o_orderdate::date, date '1998-12-31') < 400 then 25.0 else 0.0 end as fee,
  round(o_shippriority + o_orderkey % 4 * 12.5 - case when o_orderkey % 2 = 0 and date_diff('day', o_orderdate::date, date '1998-12-31') < 400 then 25.0 else 0.0 end, 2)::double as remaining from (select *, 0 as o_shippriority from orders)
""")
def closure_fees(t: Tables) -> DataFrame:
    """A fee for closing early, and what is left."""
    d = t.orders.select(F.col("o_orderkey").alias("account_id"), F.when(F.col("o_orderkey") % 2 == 0, "saver").otherwise("plain").alias("account_type"), F.date_format(F.col("o_orderdate").cast("date"), "MM/dd/yyyy").alias("date_opened"), (F.col("o_orderkey") % 4 * 12.5).alias("balance"))
    w = t.spark.createDataFrame([("saver", 400, 25.0)], "account_type string, window_days int, early_fee double")
    return G.closure_fee(d, w, "1998-12-31").select("account_id", "fee", "remaining")


@query("""
with p as (select p_partkey, p_retailprice from part)
select o_orderkey, round(a2.p_retailprice - a1.p_retailprice + b2.p_retailprice - b1.p_retailprice, 2) as difference from orders
join p a1 on a1.p_partkey = o_custkey % 20 + 1 join p b1 on b1.p_partkey = o_custkey % 30 + 2 join p a2 on a2.p_partkey = o_orderkey % 20 + 1 join p b2 on b2.p_partkey = o_orderkey % 30 + 2
""")
def price_differences(t: Tables) -> DataFrame:
    """Old and new items side by side."""
    pair = lambda c: F.array(F.col(c) % 20 + 1, F.col(c) % 30 + 2)
    prices = t.part.select(F.col("p_partkey").alias("item_id"), F.col("p_retailprice").alias("price"))
    return G.price_difference(pair("o_custkey"), pair("o_orderkey"), prices, t.orders, "o_orderkey")


@query("select c_custkey, coalesce(not (c_custkey % 2 = 0 or c_custkey % 5 = 0 or c_custkey % 3 = 0 and c_custkey % 4 <> 0), false) as works from customer")
def device_state(t: Tables) -> DataFrame:
    """Whether mobile data works, from the state of a device."""
    k = F.col("c_custkey")
    no = F.lit(False)
    state = F.struct((k % 2 == 0).alias("airplane_mode"), F.when(k % 5 == 0, "none").otherwise("good").alias("signal"), F.lit("connected").alias("status"), (k % 3 == 0).alias("is_abroad"), (k % 4 == 0).alias("roaming_enabled"), F.lit(True).alias("roaming_allowed"), F.lit(True).alias("data_enabled"), no.alias("usage_exceeded"))
    return t.customer.select("c_custkey", G.mobile_data_works(state).alias("works"))


@query("""
select c_custkey, case when c_custkey % 2 = 0 then 'connected' else 'no_service' end as status, case when c_custkey % 2 <> 0 then 'none' when c_custkey % 3 = 0 then '5G' else '4G' end as network,
  case when c_custkey % 2 <> 0 then 'none' when c_custkey % 3 = 0 then 'good' else 'fair' end as signal from customer
""")
def network_search(t: Tables) -> DataFrame:
    """Status, network and signal after a search."""
    k = F.col("c_custkey")
    signals = F.create_map(F.lit("4G"), F.lit("fair"), F.lit("5G"), F.when(k % 3 == 0, "good").otherwise("none"))
    no = F.lit(False)
    state = F.struct(signals.alias("signals"), F.lit("4g_5g_preferred").alias("preference"), F.when(k % 2 == 0, "active").otherwise("locked").alias("sim"), no.alias("airplane_mode"), no.alias("apn_broken"), F.lit(True).alias("line_active"))
    return t.customer.select("c_custkey", G.network_search(state).alias("s")).select("c_custkey", "s.*")


@query("select o_orderkey, o_orderkey % 2 = 0 as near from orders")
def float_tolerance(t: Tables) -> DataFrame:
    """Equality of amounts within a millionth."""
    other = F.col("o_totalprice") + F.when(F.col("o_orderkey") % 2 == 0, 1e-8).otherwise(1e-3)
    return t.orders.select("o_orderkey", G.close_to(F.col("o_totalprice"), other).alias("near"))


# --- experiments and metrics ---------------------------------------------------------


@query("""
with r as (select o_custkey, o_orderstatus as model, o_orderkey, case when o_orderkey % 4 = 0 then 0.0 when o_orderkey % 4 = 1 then 0.0 else o_orderkey % 3 / 2.0 end as reward from orders)
select o_custkey, arg_max(reward, o_orderkey) filter (where model = 'F')::double as f, arg_max(reward, o_orderkey) filter (where model = 'O')::double as o, arg_max(reward, o_orderkey) filter (where model = 'P')::double as p from r group by 1
""")
def wide_rewards(t: Tables) -> DataFrame:
    """One row a task, one column a model: its last run, where a run in four has no reward."""
    k = F.col("o_orderkey")
    runs = t.orders.select("o_custkey", "o_orderstatus", "o_orderkey", F.when(k % 4 == 0, None).when(k % 4 == 1, 0.0).otherwise(k % 3 / 2).alias("reward"))
    d = M.wide_rewards(runs, "o_custkey", "o_orderstatus", ("F", "O", "P"), "reward", "o_orderkey")
    return d.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("""
select o_custkey, max(case when o_orderkey % 4 = 0 then 0 else o_orderkey % 3 / 2.0 end) filter (where o_orderstatus = 'F')::double as f, max(case when o_orderkey % 4 = 0 then 0 else o_orderkey % 3 / 2.0 end) filter (where o_orderstatus = 'O')::double as o from orders group by 1
""")
def wide_best_rewards(t: Tables) -> DataFrame:
    """One row a task, one column a model: its best run."""
    runs = t.orders.select("o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 3 / 2).alias("reward"))
    d = M.wide_rewards(runs, "o_custkey", "o_orderstatus", ("F", "O"), "reward")
    return d.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"))


@query("""
with r as (select 'base' as experiment, o_custkey as task_id, o_orderkey as trial, case when o_orderstatus = 'F' then 1.0 else 0.0 end as reward from orders where o_orderkey % 2 = 0
union all select 'new', o_custkey, o_orderkey, case when o_orderstatus = 'O' then 1.0 else 0.3 end from orders where o_orderkey % 2 = 1)
select experiment, task_id, trial, reward = 1.0 as success, row_number() over (partition by experiment, task_id order by trial) as run_of_task, count(*) over (partition by experiment, task_id) as runs_of_task from r
""")
def experiment_concat(t: Tables) -> DataFrame:
    """Runs of several experiments in one table with metrics of each run."""
    part = lambda r, hit, miss: t.orders.where(F.col("o_orderkey") % 2 == r).select(F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("trial"), F.when(F.col("o_orderstatus") == hit, 1.0).otherwise(miss).alias("reward"))
    d = M.concat_experiments({"base": part(0, "F", 0.0), "new": part(1, "O", 0.3)})
    return d.select("experiment", "task_id", "trial", "success", long("run_of_task").alias("run_of_task"), "runs_of_task")


_RUNS = """
r as (select o_orderpriority as task, [null, 'agent_stop', 'max_steps', 'user_stop', 'too_many_errors', 'timeout', 'infrastructure_error'][(o_orderkey % 7 + 1)::int] as reason, case o_orderkey % 4 when 0 then 'succeeded' when 1 then 'failed' when 2 then 'not_needed' end as auth,
  case when o_orderkey % 5 > 0 then o_orderkey % 5 = 1 end as db, case when o_orderstatus = 'F' then 1.0::double when o_orderstatus = 'O' then 1.0::double - o_orderkey % 2 * 1e-9::double end as reward from orders)
"""


def _summary_runs(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        F.col("o_orderpriority").alias("task"),
        F.get(F.array(*[F.lit(x) for x in (None, "agent_stop", "max_steps", "user_stop", "too_many_errors", "timeout", "infrastructure_error")]), (k % 7).cast("int")).alias("termination_reason"),
        F.when(k % 4 == 0, "succeeded").when(k % 4 == 1, "failed").when(k % 4 == 2, "not_needed").alias("auth_status"),
        F.when(k % 5 > 0, k % 5 == 1).alias("db_match"),
        F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 1.0 - k % 2 * 1e-9).alias("reward"),
    )


@query(f"""
with {_RUNS} select task, count(*) as n, count(*) filter (where reason in ('max_steps', 'too_many_errors', 'infrastructure_error')) as failed_terminations, count(*) filter (where auth = 'succeeded') as auth_num, count(*) filter (where auth in ('succeeded', 'failed')) as auth_den,
  count(*) filter (where db) as db_num, count(db) as db_den, count(*) filter (where reward = 1) as reward_num, count(*) as reward_den,
  round(count(*) filter (where auth = 'succeeded') / count(*) filter (where auth in ('succeeded', 'failed')), 6) as auth_rate, round(count(*) filter (where db) / count(db), 6) as db_rate, round(count(*) filter (where reward = 1) / count(*), 6) as reward_rate from r group by 1
""")
def run_summary(t: Tables) -> DataFrame:
    """Numerators and denominators of a run's measures."""
    return M.run_summary(_summary_runs(t), "task")


@query(f"""
with {_RUNS} select task, 'db' as measure, round(avg(db::int) * 100, 6) as percent, count(db) as base from r group by 1 union all select task, 'reward', round(avg((reward between 1 - 1e-6 and 1 + 1e-6)::int) * 100, 6), count(reward) from r group by 1
""")
def bar_feed(t: Tables) -> DataFrame:
    """Shares by group and measure, as rows of a chart."""
    return M.share_rows(_summary_runs(t), ["task"], {"db": F.col("db_match"), "reward": M.successful(F.col("reward"))})


_ERRORS = "e as (select o_orderpriority as source, case o_orderkey % 3 when 0 then 'critical' when 1 then 'minor' else 'unknown' end as severity, o_orderkey as k from orders)"


def _errors(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(F.col("o_orderpriority").alias("source"), F.when(k % 3 == 0, "critical").when(k % 3 == 1, "minor").alias("severity"), F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("error_tags"))


@query(f"with {_ERRORS} select source, severity, count(*) as errors from e group by 1, 2")
def severity_counts(t: Tables) -> DataFrame:
    return M.severity_histogram(_errors(t), "source")


@query(f"with {_ERRORS} select 'a' as tag, severity, count(*) as errors from e group by 1, 2 union all select 'b', severity, count(*) from e where k % 2 = 0 group by 1, 2")
def tag_counts(t: Tables) -> DataFrame:
    return M.tag_histogram(_errors(t))


@query("select l_orderkey, (row_number() over (partition by l_orderkey order by l_linenumber, l_linestatus, l_returnflag = 'R') - 1)::int as action_pos, l_linestatus as name, l_returnflag = 'R' as action_match from lineitem")
def action_rows(t: Tables) -> DataFrame:
    """One row a gold action check."""
    check = F.struct("l_linenumber", F.col("l_linestatus").alias("name"), (F.col("l_returnflag") == "R").alias("action_match"))
    runs = t.lineitem.groupBy("l_orderkey").agg(F.struct(F.sort_array(F.collect_list(check)).alias("action_checks")).alias("reward_info"))
    return M.action_rows(runs, "l_orderkey").select("l_orderkey", "action_pos", "name", "action_match")


# --- texts, maps and states ------------------------------------------------------------


@query(r"select p_partkey, regexp_extract(p_brand, '#(\d)', 1) as digit, len(string_split(p_type, ' ')) as words from part")
def capture_and_split(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.captured(F.col("p_brand"), r"#(\d)").alias("digit"), long(F.size(F.split("p_type", " "))).alias("words"))


@query(r"select page_id, substr(regexp_replace(replace(url, '..', '_'), '[^\p{L}\p{N}._-]', '_', 'g'), 1, 255) as name from pages")
def safe_file_names(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.file_name(F.col("url")).alias("name"))


@query("select o_orderkey, o_orderstatus as status, 'new' as note, o_custkey::varchar as cust from orders")
def map_merge(t: Tables) -> DataFrame:
    """A partial update of a map."""
    old = F.create_map(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("status"), F.lit("?"))
    m = D.merge_maps(old, F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("note"), F.lit("new")))
    return t.orders.select("o_orderkey", m.alias("m")).select("o_orderkey", F.col("m")["status"].alias("status"), F.col("m")["note"].alias("note"), F.col("m")["cust"].alias("cust"))


@query("select o_orderkey, o_orderkey % 4 <> 1 as db_match from orders")
def end_states(t: Tables) -> DataFrame:
    """Whether two runs end in the same state, in both of its parts."""
    state = lambda c, f: F.to_json(F.struct(F.when(f, F.lit("x")).otherwise(F.col(c).cast("string")).alias("v")))
    a = t.orders.select("o_orderkey", state("o_custkey", F.lit(False)).alias("agent_db"), state("o_orderstatus", F.lit(False)).alias("user_db"))
    b = t.orders.select("o_orderkey", state("o_custkey", F.col("o_orderkey") % 4 == 1).alias("agent_db"), state("o_orderstatus", F.lit(False)).alias("user_db"))
    return SD.end_states_equal(a, b, "o_orderkey", ["agent_db", "user_db"])


@query("""
with m as (select conv_id as run_id, turn, 'error in part ' || chr((97 + turn % 2)::int) as e from conversations where role = 'user'),
f as (select run_id, e, min(turn) as p from m group by 1, 2)
select run_id, string_agg(e, '|' order by p) as errors from f group by 1
""")
def first_seen_errors(t: Tables) -> DataFrame:
    """The different error texts of a run, in order of their first occurrence."""
    m = t.conversations.where("role = 'user'").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("pos"), F.lit("tool").alias("role"), F.lit(True).alias("error"), F.concat(F.lit("Error in part "), F.chr(97 + F.col("turn") % 2)).alias("content"))
    return TR.tool_errors(m).select("run_id", F.array_join("tool_errors", "|").alias("errors"))


#: Signatures that decide between the rules, and their glosses worked out by hand.
_SIGNED = (
    ("missed:orders.*.cancel_reason;missed:orders.*.return_items;missed:orders.*.status", "missing: cancel order, return items"),
    ("wrong:orders.*.items[].options.*;wrong:users.*.payment_methods.*.balance", "wrong: modify order items, gift-card balance"),
    ("extra:users.*.address.city;missed:orders.*.address.zip", "missing: change order address · extra: change user address"),
    ("wrong:orders.*.payment_history[].amount;wrong:orders.*.status", "wrong: order payment/refund"),
    ("missed:orders.*.status", "missing: order status"),
    ("missed:products.*.variants.*.price;missed:orders.*.note;odd", "missing: note, price"),
    ("no_db_diff", ""),
    ("extra:orders.*.exchange_new_items;wrong:users.*.payment_methods.*.brand;extra:orders.*.return_payment_method_id", "wrong: modify payment method · extra: return items, exchange items"),
)
_NTH = "[(o_orderkey % 8 + 1)::int]"


@query(f"""
with x as (select o_orderkey, o_orderstatus, {[g for _, g in _SIGNED]}{_NTH} as g from orders)
select o_orderkey, 'missed items ' || lower(o_orderstatus) || ' wrong balance' as words, case when g = '' then '' else g || ' | ' end || 'says: no ' || o_orderstatus || ' | tools: a → b | ' || o_orderstatus as gloss from x
""")
def signature_words(t: Tables) -> DataFrame:
    """Signatures as words for clustering and as a line for readers."""
    s = F.concat(F.lit("missed:orders.*.items[]."), F.lower("o_orderstatus"), F.lit(";wrong:users.*.balance"))
    signed = F.get(F.array(*[F.lit(x) for x, _ in _SIGNED]), (F.col("o_orderkey") % 8).cast("int"))
    whole = F.concat(F.lit("db="), signed, F.lit(" | nl=no "), "o_orderstatus", F.lit(" | chain=a->b | "), "o_orderstatus")
    return t.orders.select("o_orderkey", X.signature_tokens(s).alias("words"), X.signature_gloss(whole).alias("gloss"))


@query("""select o_orderkey, '{"k":"' || o_orderkey || '","open":"' || case when o_orderstatus = 'O' then 'True' else 'False' end || '","day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","ids":["' || o_custkey || '","7"],"none":null}' as response from orders""")
def json_of_texts(t: Tables) -> DataFrame:
    """Responses whose numbers and booleans are texts."""
    d = t.orders.select("o_orderkey", F.struct(F.col("o_orderkey").alias("k"), (F.col("o_orderstatus") == "O").alias("open"), F.col("o_orderdate").cast("date").alias("day"), F.array(F.col("o_custkey").cast("long"), F.lit(7).cast("long")).alias("ids"), F.lit(None).cast("double").alias("none")).alias("r"))
    return d.select("o_orderkey", X.json_of_texts(F.col("r"), d.schema["r"].dataType).alias("response"))


@query("""
select o_orderkey, 'status' as path, 'changed' as kind, '"?"' as old, '"' || o_orderstatus || '"' as new from orders union all select o_orderkey, 'x.note', 'added', null, '1' from orders where o_custkey % 2 = 0 union all select o_orderkey, 'old', 'removed', 'true', null from orders
""")
def structural_diff(t: Tables) -> DataFrame:
    """Leaves that two nested states do not share."""
    a = F.concat(F.lit('{"status": "?", "x": {"same": 1}, "old": true}'))
    b = F.concat(F.lit('{"status": "'), F.col("o_orderstatus"), F.lit('", "x": {"same": 1'), F.when(F.col("o_custkey") % 2 == 0, ', "note": 1').otherwise(""), F.lit("}}"))
    return SD.structural_diff(t.orders.select("o_orderkey", a.alias("a"), b.alias("b")), "o_orderkey", "a", "b")


@query("""
with w as (select o_custkey, arg_max('B' || o_orderkey, 'B' || o_orderkey) filter (where o_orderkey % 13 = 0) as bill from orders group by 1)
select 'U' || o_orderkey as user_id, o_orderstatus = 'O' as line_active, o_orderkey % 2 = 0 as roaming_allowed, o_orderkey % 10 / 2.0 >= [5.0, 10.0, 20.0][(o_orderkey % 3 + 1)::int] as usage_exceeded, w.bill as request_bill_id from orders join w using (o_custkey)
""")
def world_sync(t: Tables) -> DataFrame:
    """What a line's state tells the device, and the bill that a user is asked to pay: the first that waits in the customer's list, which runs backwards here."""
    d = _telecom(t)
    d["customers"] = d["customers"].withColumn("bill_ids", F.reverse("bill_ids"))
    d["bills"] = d["bills"].withColumn("status", F.when(F.substring("bill_id", 2, 20).cast("long") % 13 == 0, "Awaiting Payment").otherwise("Paid"))
    null = lambda k: F.lit(None).cast(k)
    users = t.orders.select(F.concat(F.lit("U"), F.col("o_orderkey").cast("string")).alias("user_id"), F.concat(F.lit("555"), F.col("o_orderkey").cast("string")).alias("phone_number"), null("string").alias("request_bill_id"), null("double").alias("request_amount"), null("boolean").alias("request_paid"))
    now, _ = telecom.sync_world(users, d["customers"], d["lines"], d["plans"], d["bills"])
    return now.select("user_id", "line_active", "roaming_allowed", "usage_exceeded", "request_bill_id")


# --- ticks and reports --------------------------------------------------------------------


@query("""
with x as (select *, row_number() over (partition by user_id order by event_id) as pos, case when event_type is distinct from lag(event_type) over (partition by user_id order by event_id) then 1 else 0 end as new from events),
y as (select *, sum(new) over (partition by user_id order by event_id rows unbounded preceding) as grp from x)
select user_id as conv_id, row_number() over (partition by user_id order by min(pos)) as place, any_value(event_type) as kind, string_agg(event_id::varchar, '' order by pos) as text from y group by user_id, grp
""")
def consolidate_runs(t: Tables) -> DataFrame:
    """Adjacent rows of one kind in one."""
    d = t.events.select(F.col("user_id").alias("conv_id"), "event_id", F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("text"))
    return K.consolidate(d, ["event_id"], ["kind"]).select("conv_id", long("place").alias("place"), "kind", "text")


@query("select event_id, event_id % 3 > 0 as spoken, event_id % 3 > 0 or event_id % 5 = 0 as meaningful, case when event_id % 4 = 0 or event_id % 7 = 0 then null when event_id % 4 >= event_id % 7 then 'other' else 'self' end as initiator from events")
def tick_predicates(t: Tables) -> DataFrame:
    """Whether a tick speaks or matters, and who broke in."""
    k = F.col("event_id")
    text = F.when(k % 3 == 0, "  ").otherwise("hm")
    items = F.when(k % 5 == 0, F.array(F.lit(1)))
    return t.events.select("event_id", K.speech(text).alias("spoken"), K.active(text, items).alias("meaningful"), K.overlap_initiator(k % 4, k % 7).alias("initiator"))


@query("""
with e as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n, count(*) over (partition by user_id) as total from events)
select a.user_id as run_id, a.event_id as start, coalesce(b.event_id, 10000000000) as "end" from e a left join e b on a.user_id = b.user_id and b.n = case when a.n % 4 = 1 then a.n + 3 else a.n + 1 end where a.n % 4 in (1, 2)
""")
def interval_log(t: Tables) -> DataFrame:
    """Opens and closes of a log, paired last opened first: two open, two close, over and over."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    log = t.events.select(F.col("user_id").alias("run_id"), F.lit("noise").alias("effect"), F.lit("user").alias("who"), F.col("event_id").alias("at"), F.col("event_id").alias("seq"), n.alias("n"))
    log = log.withColumn("event", F.when((F.col("n") % 4).isin(1, 2), "open").otherwise("close"))
    return K.close_intervals(log, F.lit(10_000_000_000)).select("run_id", "start", "end")


@query("select o_orderkey as item_id, o_custkey as start, o_custkey + 5 as \"end\", o_orderstatus as text from orders where o_orderkey % 3 <> 0")
def transcript_items(t: Tables) -> DataFrame:
    """Items from their events; one that completes before it starts is ignored."""
    e = lambda name, at, text=None: t.orders.select(F.col("o_orderkey").alias("item_id"), F.lit(name).alias("event"), at.alias("at"), (F.lit(None).cast("string") if text is None else F.col(text)).alias("text"))
    at = F.col("o_custkey")
    done = F.when(F.col("o_orderkey") % 3 == 0, at - 1).otherwise(at + 9)
    return K.transcripts(e("start", at).unionByName(e("stop", at + 5)).unionByName(e("completed", done, "o_orderstatus")))


@query("""
with c as (select event_id, user_id, 0 as side, 'u' || event_id as call from events where event_id % 2 = 0 union all select event_id, user_id, 1, 'a' || event_id from events where event_id % 3 = 0)
select user_id as conv_id, call, row_number() over (partition by user_id order by event_id, side) - 1 as pos from c
""")
def replay_of_ticks(t: Tables) -> DataFrame:
    """Calls in order of replay: at one tick the user's first."""
    k = F.col("event_id")
    none = F.array().cast("array<string>")
    call = lambda p, m: F.when(k % m == 0, F.array(F.concat(F.lit(p), k.cast("string")))).otherwise(none)
    d = t.events.select(F.col("user_id").alias("conv_id"), k.alias("tick_id"), call("u", 2).alias("user_calls"), call("a", 3).alias("agent_calls"))
    return K.replay_order(d).select("conv_id", "call", long("pos").alias("pos"))


@query("select user_id as conv_id, printf('%.6f', event_id * 0.2::double) as start_s, printf('%.6f', (event_id + 1) * 0.2::double) as end_s, event_type as label from events")
def label_rows(t: Tables) -> DataFrame:
    """Segments as rows of a label file."""
    d = t.events.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("start"), F.col("event_id").alias("end"), F.col("event_type").alias("text"))
    return Y.label_track(d, 0.2)


@query("select o_orderpriority as id, case when o_orderpriority like '1%' then 'first' else 'c_' || o_orderpriority end as label, count(*) as n from orders group by 1, 2")
def labelled_clusters(t: Tables) -> DataFrame:
    """Clusters with their label, or their own name."""
    c = t.orders.groupBy(F.col("o_orderpriority").alias("id")).agg(F.count("*").alias("n")).withColumn("name", F.concat(F.lit("c_"), "id"))
    labels = t.orders.where("o_orderpriority like '1%'").select(F.col("o_orderpriority").alias("id"), F.lit("first").alias("label")).distinct()
    return Y.cluster_table(c, labels).select("id", "label", "n")


@query("select event_id, case when event_id % 3 = 0 or event_id % 20 < 5 then false when event_id % 20 >= 15 then true else event_id % 100 / 100.0 < 1 - exp(-0.5) end as acknowledge from events")
def backchannel_rule(t: Tables) -> DataFrame:
    """Acknowledgements: never early, always late, by chance between."""
    k = F.col("event_id")
    return t.events.select("event_id", S.backchannel(k % 20, k % 3, 5, 15, 2.5, 0.2, k % 100 / 100).alias("acknowledge"))


@query("""
with g as (select user_id, min(event_id) as a, max(event_id) as z, min(event_id) filter (where event_type = 'purchase') as p from events group by 1)
select user_id, least(coalesce(p, z), a + 2999) as "end", case when p <= a + 2999 then 'done' when z >= a + 2999 then 'max_steps' else 'open' end as reason from g
""")
def end_reasons(t: Tables) -> DataFrame:
    """Where a conversation ends: done, out of steps, or open."""
    return S.end_reasons(t.events, "user_id", "event_id", F.col("event_type") == "purchase", 3000)


@query("select event_id, least(event_id % 50, 20) as played, 0 as waiting from events")
def audio_discarded(t: Tables) -> DataFrame:
    """Audio beyond a tick's share is discarded."""
    d = t.events.select("event_id", F.col("user_id").alias("conv_id"), F.col("event_id").alias("tick_id"), (F.col("event_id") % 50).alias("bytes"))
    return K.carry_over(d, 20, discard=True).select("event_id", "played", "waiting")
