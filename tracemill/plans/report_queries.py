"""Frames and feeds of reports on the test tables: a customer's orders are the runs of a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import metrics as M
from tracemill.plans.registry import Tables, query

_FRAME = """
r as (select o_orderpriority as llm, o_orderstatus as domain, ['default', 'no-user', 'oracle-plan'][(o_custkey % 3 + 1)::int] as mode, o_custkey % 50 as task, 'p' || (o_custkey % 50 % 4) as persona, o_custkey % 50 % 7 as actions, o_totalprice > 150000 as ok from orders),
t as (select llm, domain, mode, task, persona, actions, count(*) as n, count(*) filter (where ok) as c from r group by 1, 2, 3, 4, 5, 6),
f as (select llm, domain, mode, task, persona, actions, c / n::double as pass_1, c * (c - 1) / (n * (n - 1))::double as pass_2 from t where n >= 2)
"""
_KEYS = ["llm", "domain", "mode", "task", "persona", "actions"]


def _frame(t: Tables) -> DataFrame:
    """pass^1 and pass^2 of every task of a model, domain and mode with two runs or more."""
    task = F.col("o_custkey") % 50
    mode = F.get(F.array(*[F.lit(m) for m in ("default", "no-user", "oracle-plan")]), (F.col("o_custkey") % 3).cast("int"))
    r = t.orders.select(F.col("o_orderpriority").alias("llm"), F.col("o_orderstatus").alias("domain"), mode.alias("mode"), task.alias("task"), F.concat(F.lit("p"), (task % 4).cast("string")).alias("persona"), (task % 7).alias("actions"), (F.col("o_totalprice") > 150000).alias("ok"))
    g = r.groupBy(*_KEYS).agg(F.count("*").alias("n"), F.count_if("ok").alias("c")).where("n >= 2")
    c, n = F.col("c").cast("double"), F.col("n")
    return g.select(*_KEYS, (c / n).alias("pass_1"), (c * (c - 1) / (n * (n - 1))).alias("pass_2"))


def _rounded(d: DataFrame) -> DataFrame:
    return d.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


def _feed(by: str, where: str = "true", measures: tuple[str, ...] = ("pass_1", "pass_2")) -> str:
    one = "select {by}, '{m}' as measure, round(avg({m}), 6) as mean, round(stddev_samp({m}), 6) as std, count({m}) as n from f where {where} group by all"
    return f"with {_FRAME} " + " union all ".join(one.format(by=by, m=m, where=where) for m in measures)


@query(_feed("llm, domain"))
def feed_by_domain(t: Tables) -> DataFrame:
    """Bars of pass^k by model and domain."""
    return _rounded(M.mean_rows(_frame(t), ["llm", "domain"], ["pass_1", "pass_2"]))


@query(f"with {_FRAME}, a as (select llm, mode, (pass_1 + pass_2) / 2 as average from f) select llm, mode, 'average' as measure, round(avg(average), 6) as mean, round(stddev_samp(average), 6) as std, count(*) as n from a group by 1, 2")
def feed_average_by_mode(t: Tables) -> DataFrame:
    """Bars of the average over k by model and mode."""
    d = _frame(t).withColumn("average", (F.col("pass_1") + F.col("pass_2")) / 2)
    return _rounded(M.mean_rows(d, ["llm", "mode"], ["average"]))


@query(_feed("llm, mode", "domain = 'O'"))
def feed_by_mode_of_domain(t: Tables) -> DataFrame:
    """Bars of pass^k by model and mode within one domain."""
    return _rounded(M.mean_rows(_frame(t).where("domain = 'O'"), ["llm", "mode"], ["pass_1", "pass_2"]))


@query(_feed("mode", "domain = 'F'", ("pass_1",)))
def feed_first_by_mode(t: Tables) -> DataFrame:
    """Bars of pass^1 by mode with error bars over all models."""
    return _rounded(M.mean_rows(_frame(t).where("domain = 'F'"), ["mode"], ["pass_1"]))


@query(_feed("persona, mode", "mode in ('default', 'no-user')", ("pass_1",)))
def feed_by_persona(t: Tables) -> DataFrame:
    """Bars of pass^1 by persona, with a user and without."""
    return _rounded(M.mean_rows(_frame(t).where("mode in ('default', 'no-user')"), ["persona", "mode"], ["pass_1"]))


@query(f"with {_FRAME} select llm, domain, mode, task, actions, row_number() over (order by actions, llm, domain, mode, task) as place from f")
def frame_by_actions(t: Tables) -> DataFrame:
    """The frame of metrics in order of the actions a task needs."""
    order = [F.asc(c) for c in ("actions", "llm", "domain", "mode", "task")]
    return M.placed(_frame(t), *order).select("llm", "domain", "mode", "task", "actions", "place")


@query("""
with g as (select o_orderstatus as domain, o_custkey as model, avg(case when o_orderkey % 3 > 0 then o_totalprice end) as pass_1 from orders group by 1, 2)
select domain, model, round(pass_1, 6) as pass_1, row_number() over (order by domain, pass_1 desc nulls last, model) as place from g
""")
def frame_by_domain(t: Tables) -> DataFrame:
    """Submissions by domain, the best first, those without a result last."""
    price = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice"))
    r = t.orders.select(F.col("o_orderstatus").alias("domain"), F.col("o_custkey").alias("model"), "o_orderkey", price.alias("price"))
    g = M.ordered_means(r, ["domain", "model"], "price", ["o_orderkey"], "pass_1")
    d = M.placed(g, F.asc_nulls_last("domain"), F.desc_nulls_last("pass_1"), F.asc_nulls_last("model"))
    return d.select("domain", "model", M.rounded(F.col("pass_1"), 6).alias("pass_1"), "place")


@query("""
select o_orderkey, case when o_orderkey % 5 > 0 then strftime(o_orderdate, '%m/%d/%Y') end as day from orders order by coalesce(case when o_orderkey % 5 > 0 then strftime(o_orderdate, '%m/%d/%Y') end, '') desc, o_orderkey limit 40
""")
def newest_by_text(t: Tables) -> DataFrame:
    """The first payments by their date as text, as a history with a limit has them."""
    day = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
    return M.newest(t.orders.select("o_orderkey", day.alias("day")), "day", 40, F.asc("o_orderkey"))


@query("""
with g as (select props as action, count(*) as n from events group by 1) select action, n, round(n / (select count(*) from events), 9) as frequency from g where n / (select count(*) from events) > 0.0105
""")
def top_actions(t: Tables) -> DataFrame:
    """Actions that make up more than a share of all, most frequent first."""
    d = M.frequent(t.events.withColumnRenamed("props", "action"), "action", 0.0105)
    return d.select("action", "n", F.round("frequency", 9).alias("frequency"))


@query("select distinct o_orderpriority as model, o_orderstatus as organisation from orders")
def distinct_models(t: Tables) -> DataFrame:
    """Models and organisations, each pair once."""
    return t.orders.select(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("organisation")).distinct()
