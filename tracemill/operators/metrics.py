"""Reliability metrics over run tables: pass^k, rewards, severities, rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.operators.ordered import running_total

INFRA = "infrastructure_error"
EPS = 1e-6


# --- success predicates --------------------------------------------------------


def successful(reward: Column) -> Column:
    return reward.between(1 - EPS, 1 + EPS)


def passed(reward: Column) -> Column:
    return reward >= 0.999


def exactly_one(reward: Column) -> Column:
    return reward == 1.0


def evaluated(runs: DataFrame, reason: str = "termination_reason") -> DataFrame:
    """Runs that took place: infrastructure errors go, null reasons stay."""
    return runs.where(~F.col(reason).eqNullSafe(INFRA))


# --- pass^k --------------------------------------------------------------------


def pass_hat_k(n: Column, c: Column, k: int) -> Column:
    """C(c,k)/C(n,k) as a product of k ratios; null where n < k."""
    out = F.lit(1.0)
    for i in range(k):
        out = out * (c - i).cast("double") / (n - i).cast("double")
    return F.when(n >= k, F.when(c < k, F.lit(0.0)).otherwise(out))


def pass_table(runs: DataFrame, task: str, success: Column, ks: Sequence[int], attributes: Mapping[str, Column] | None = None, order: Column | None = None) -> DataFrame:
    """One row a task: ``n, c`` and ``pass_k`` for each k; attributes are those of its first run."""
    firsts = [(F.min_by(v, order) if order is not None else F.first(v)).alias(k) for k, v in (attributes or {}).items()]
    g = runs.groupBy(task).agg(F.count("*").alias("n"), F.count_if(success).alias("c"), *firsts)
    return g.select("*", *[pass_hat_k(F.col("n"), F.col("c"), k).alias(f"pass_{k}") for k in ks])


def max_k(runs: DataFrame, task: str, declared: Column) -> DataFrame:
    """One row: the smaller of the largest declared trial count and the least number of runs of a task."""
    per_task = runs.groupBy(task).agg(F.count("*").alias("n"), F.max(declared).alias("d"))
    return per_task.agg(F.least(F.max("d").cast("long"), F.min("n")).alias("max_k"))


def macro_pass(table: DataFrame, ks: Sequence[int]) -> DataFrame:
    """The mean over tasks of each pass^k."""
    return table.agg(F.count("*").alias("tasks"), *[F.avg(f"pass_{k}").alias(f"pass_{k}") for k in ks])


def metric_bundle(runs: DataFrame) -> DataFrame:
    """One row of counts over the evaluated runs, from the nested run record (``reward_info``, ``review``, ...)."""
    infra = F.col("termination_reason").eqNullSafe(INFRA)
    runs = runs.withColumn("infra", infra)
    checks = F.coalesce(F.col("reward_info.action_checks"), F.array().cast("array<struct<tool_type:string,action_match:boolean>>"))
    live = ~F.col("infra")
    kind = lambda t: F.sum(F.when(live, F.size(F.filter(checks, lambda a: a["tool_type"] == t)))).alias(f"total_{t}_actions")
    right = lambda t: F.sum(F.when(live, F.size(F.filter(checks, lambda a: (a["tool_type"] == t) & a["action_match"])))).alias(f"correct_{t}_actions")
    count = lambda c, name: F.count_if(live & F.coalesce(c, F.lit(False))).alias(name)
    reason = F.col("termination_reason")
    match = F.col("reward_info.db_check.db_match")
    checked = F.col("reward_info.db_check").isNotNull()
    auth = F.col("auth_status")
    return runs.agg(
        F.avg(F.when(live, F.col("reward"))).alias("avg_reward"),
        F.avg(F.when(live, F.col("agent_cost"))).alias("avg_agent_cost"),
        count(F.lit(True), "total_simulations"),
        F.count_distinct(F.when(live, F.col("task_id"))).alias("total_tasks"),
        F.count_if(F.col("infra")).alias("infra_error_count"),
        kind("read"), right("read"), kind("write"), right("write"),
        count(match, "db_match_count"),
        count(checked & ~F.coalesce(match, F.lit(False)), "db_mismatch_count"),
        count(~checked, "db_not_checked"),
        count(auth == "succeeded", "auth_succeeded"),
        count(auth == "failed", "auth_failed"),
        count(auth.isNotNull() & ~auth.isin("succeeded", "failed"), "auth_not_needed"),
        count(auth.isNull(), "auth_not_checked"),
        count(reason == "user_stop", "termination_user_stop"),
        count(reason == "agent_stop", "termination_agent_stop"),
        count(reason == "max_steps", "termination_max_steps"),
        count(reason.isin("too_many_errors", "agent_error", "user_error"), "termination_error"),
        count(F.col("had_unresponsive_period").isNotNull(), "sims_with_responsiveness_info"),
        count(F.col("had_unresponsive_period"), "sims_with_unresponsive_period"),
    )


# --- review severities -----------------------------------------------------------


def agent_max_severity(severity: Column, pos: Column) -> Column:
    """Aggregate: critical over minor over the first of anything else (null reads as unknown)."""
    s = F.coalesce(severity, F.lit("unknown"))
    rank = F.when(s == "critical", 2).when(s == "minor", 1).otherwise(0)
    return F.coalesce(F.max_by(s, F.struct(rank, -pos)), F.lit("none"))


def user_max_severity(severity: Column, pos: Column) -> Column:
    """Aggregate: the last critical one, or minor, or the first of anything else."""
    s = F.coalesce(severity, F.lit("unknown"))
    critical = s.isin("critical_helped", "critical_hindered")
    rank = F.when(critical, 2).when(s == "minor", 1).otherwise(0)
    return F.coalesce(F.max_by(s, F.struct(rank, F.when(critical, pos).otherwise(-pos))), F.lit("none"))


def first_critical(source: Column, critical: Column, at: Column, pos: Column) -> Column:
    """Aggregate: the source of the critical error with the least position, ties by order, ``none`` without any."""
    key = F.struct(F.coalesce(at.cast("double"), F.lit(float("inf"))), pos)
    return F.coalesce(F.min_by(F.when(critical, source), F.when(critical, key)), F.lit("none"))


def severity_histogram(errors: DataFrame, *by: str) -> DataFrame:
    return errors.groupBy(*by, F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(F.count("*").alias("errors"))


def tag_histogram(errors: DataFrame, *by: str) -> DataFrame:
    tagged = errors.select(*by, F.coalesce("severity", F.lit("unknown")).alias("severity"), F.explode("error_tags").alias("tag"))
    return tagged.groupBy(*by, "tag", "severity").agg(F.count("*").alias("errors"))


# --- rewards ---------------------------------------------------------------------


def product_of(components: Column) -> Column:
    """The product of an array of component rewards; 1 for none."""
    return F.aggregate(components, F.lit(1.0), lambda a, x: a * x)


def all_true(flags: Column) -> Column:
    return F.when(F.forall(flags, lambda x: F.coalesce(x, F.lit(False))), 1.0).otherwise(0.0)


def recombine(breakdown: Column, basis: Sequence[str], reason: Column | None = None) -> Column:
    """The reward under another basis: missing components count one, a premature end gives zero."""
    out = product_of(F.array(*[F.coalesce(F.try_element_at(breakdown, F.lit(b)), F.lit(1.0)) for b in basis]))
    return out if reason is None else F.when(reason.isin("agent_stop", "user_stop"), out).otherwise(0.0)


def component_success(breakdown: Column, basis: Column, name: str) -> Column:
    """Null outside the basis, false without a breakdown, else whether the component succeeded."""
    return F.when(F.array_contains(basis, name), F.coalesce(successful(F.try_element_at(breakdown, F.lit(name))), F.lit(False)))


def action_rows(runs: DataFrame, *keep: str) -> DataFrame:
    """One row a gold action check."""
    return runs.select(*keep, F.posexplode("reward_info.action_checks").alias("action_pos", "a")).select(*keep, "action_pos", "a.*")


# --- rates and distributions --------------------------------------------------------


def rate_pivot(df: DataFrame, rows: Sequence[str], pivot: str, values: Sequence, hit: Column) -> DataFrame:
    """Success rate by row and pivot value, and each row's share of all rows as ``frequency``."""
    cells = [
        (F.count_if(hit & (F.col(pivot) == v)).cast("double") / F.nullif(F.count_if(F.col(pivot) == v), F.lit(0))).alias(f"rate_{v}")
        for v in values
    ]
    g = df.groupBy(*rows).agg(F.count("*").alias("n"), *cells)
    return g.withColumn("frequency", F.col("n") / F.sum("n").over(W.partitionBy()))


def value_counts(df: DataFrame, by: Sequence[str], spine: DataFrame | None = None) -> DataFrame:
    """Counts and percentages by group; groups of ``spine`` that don't occur count zero."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"))
    if spine is not None:
        g = spine.join(g, list(by), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return g.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


def macro_failure_rate(runs: DataFrame, group: Sequence[str], task: str, success: Column) -> DataFrame:
    """The mean over a group's tasks of each task's share of failures."""
    t = runs.groupBy(*group, task).agg((F.lit(1.0) - F.avg(success.cast("double"))).alias("rate"), F.count("*").alias("n"))
    return t.groupBy(*group).agg(F.avg("rate").alias("failure_rate"), F.count("*").alias("tasks"), F.sum("n").alias("runs"))


def dominant(df: DataFrame, group: Sequence[str], label: str, order: Column) -> DataFrame:
    """The most frequent label of each group, ties to the one seen first."""
    g = df.groupBy(*group, label).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    top = F.max_by(F.struct(label, "n"), F.struct("n", (-F.col("seen").cast("double"))))
    return g.groupBy(*group).agg(top.alias("t")).select(*group, F.col(f"t.{label}").alias(label), F.col("t.n").alias("n"))


def flaky(runs: DataFrame, task: str, success: Column, run_id: str, order: Column) -> DataFrame:
    """Tasks with both outcomes, and the first run of each."""
    g = runs.groupBy(task).agg(
        F.count_if(success).alias("passes"),
        F.count_if(~success).alias("fails"),
        F.min_by(F.when(success, F.col(run_id)), F.when(success, order)).alias("first_pass"),
        F.min_by(F.when(~success, F.col(run_id)), F.when(~success, order)).alias("first_fail"),
    )
    return g.where("passes > 0 and fails > 0")


def stable_pass(runs: DataFrame, task: str, reward: Column, first: int) -> DataFrame:
    """The first N tasks, by their name as text, all of whose runs pass."""
    g = runs.groupBy(task).agg(F.min(reward).alias("least"), F.count("*").alias("n")).where("least >= 0.999")
    return g.orderBy(F.col(task).cast("string")).limit(first)


def flag_counts(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Policy flags that are violated; an unknown flag is none."""
    return df.groupBy(*group).agg(
        F.count_if(F.col("auth_before_mutate") == F.lit(False)).alias("auth_missing"),
        F.count_if(F.col("confirm_before_write") == F.lit(False)).alias("confirm_missing"),
        F.count_if(~F.col("single_tool_per_turn")).alias("multi_tool_turn"),
        F.count_if(F.col("num_env_errors") > 0).alias("env_errors"),
    )


def trial_audit(tasks: DataFrame, runs: DataFrame, task: str, declared: int) -> DataFrame:
    """Tasks whose number of runs is not the declared one, none included."""
    g = runs.groupBy(task).agg(F.count("*").alias("n"))
    return tasks.select(task).join(g, task, "left").select(task, F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") != declared)


def top_values(df: DataFrame, group: Sequence[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each group, ties by value, as text ``value:count`` in one column."""
    g = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    r = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("n"), value))
    top = g.withColumn("r", r).where(F.col("r") <= k).groupBy(*group)
    item = F.concat_ws(":", F.col(value).cast("string"), F.col("n").cast("string"))
    return top.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", item.alias("i")))), lambda x: x["i"]), ",").alias("top"))


def cost_totals(messages: DataFrame, run: str) -> DataFrame:
    """Cost by role, null for a run in which any message but a tool's has none; tokens skip missing ones."""
    talk = F.col("role").isin("assistant", "user")
    missing = F.bool_or(talk & F.col("cost").isNull())
    of = lambda role: F.when(missing, None).otherwise(F.coalesce(F.sum(F.when(F.col("role") == role, F.col("cost"))), F.lit(0.0)))
    return messages.groupBy(run).agg(of("assistant").alias("agent_cost"), of("user").alias("user_cost"), F.sum("tokens").alias("tokens"))


# --- experiments ------------------------------------------------------------------


def wide_rewards(runs: DataFrame, task: str, model: str, models: Sequence[str], reward: str, order: str | None = None) -> DataFrame:
    """One row a task, one column a model: the reward of its last run there by ``order`` (none given: the best), 0 for a run without one, null without a run."""
    value = F.coalesce(F.col(reward).cast("double"), F.lit(0.0))
    kept = F.max(value) if order is None else F.max_by(value, order)
    # The models are named, so one pass does.
    return runs.groupBy(task).pivot(model, list(models)).agg(kept)


def concat_experiments(experiments: Mapping[str, DataFrame], task: str = "task_id", reward: str = "reward") -> DataFrame:
    """Runs of several experiments in one table, each with its experiment, whether it succeeded and its place among its task's runs."""
    out = None
    for name, runs in experiments.items():
        d = runs.withColumn("experiment", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    order = W.partitionBy("experiment", task).orderBy("trial")
    return out.withColumns({"success": successful(F.col(reward)), "run_of_task": F.row_number().over(order), "runs_of_task": F.count("*").over(W.partitionBy("experiment", task))})


#: The reasons that count as failed terminations in a summary.
FAILED_REASONS = ("max_steps", "too_many_errors", "infrastructure_error")


def run_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Runs, failed terminations, and numerators with denominators of authentication, state and reward.

    A run succeeds with a reward of exactly 1, out of all runs: one without a reward has 0.
    """
    reason, auth, db = F.col("termination_reason"), F.col("auth_status"), F.col("db_match")
    d = runs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(reason.isin(*FAILED_REASONS)).alias("failed_terminations"),
        F.count_if(auth == "succeeded").alias("auth_num"),
        F.count_if(auth.isin("succeeded", "failed")).alias("auth_den"),
        F.count_if(db).alias("db_num"),
        F.count(db).alias("db_den"),
        F.count_if(exactly_one(F.col("reward"))).alias("reward_num"),
        F.count("*").alias("reward_den"),
    )
    share = lambda k: F.round(F.try_divide(f"{k}_num", f"{k}_den"), 6).alias(f"{k}_rate")
    return d.select("*", share("auth"), share("db"), share("reward"))


def mean_rows(frame: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Feed of a chart with error bars: one row a group and measure with its mean, sample deviation and count, nulls apart."""
    g = frame.groupBy(*by).agg(*[f(m).alias(f"{m}_{n}") for m in measures for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("n", F.count))])
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), *[F.col(f"{m}_{n}").alias(n) for n in ("mean", "std", "n")]) for m in measures])
    return g.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def ordered_means(rows: DataFrame, by: Sequence[str], value: str, order: Sequence[str], name: str) -> DataFrame:
    """``by`` and the mean of ``value`` as ``name``, null where there is none: doubles are added one by one in the order of ``order``, as a reader of sorted rows adds them, so the last digits do not depend on how rows are dealt. A group is a window's rows, not a list in memory."""
    w = W.partitionBy(*by).orderBy(*order, value)
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    d = rows.select(*by, F.row_number().over(w).alias("n"), F.sum(value).over(so_far).alias("total"), F.count(value).over(so_far).alias("values"))
    g = d.groupBy(*by).agg(F.max_by(F.struct("total", "values"), "n").alias("last"))
    return g.select(*by, F.when(F.col("last.values") > 0, F.col("last.total") / F.col("last.values")).alias(name))


def rounded(value: Column, digits: int) -> Column:
    """A double rounded as SQL engines on doubles do it: scaled, to the nearest whole number, halves away from zero, and back. ``F.round`` rounds the shortest decimal text and differs on halves."""
    return F.when(F.abs(value) < 1e300, F.round(value * 10.0**digits) / 10.0**digits).otherwise(value)


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """``df`` with each row's place in the order, from 1."""
    return running_total(df, list(order), F.lit(1), name)


def newest(df: DataFrame, date: str, first: int, *ties: Column) -> DataFrame:
    """The first rows by their date as text, the latest first and a missing one last: texts are compared, so a month goes before a year."""
    return df.orderBy(F.desc(F.coalesce(F.col(date), F.lit(""))), *ties).limit(first)


def frequent(df: DataFrame, value: str, least: float) -> DataFrame:
    """``value, n, frequency`` of the values that make up more than a share of all rows, most frequent first."""
    g = df.groupBy(value).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    g = g.crossJoin(F.broadcast(total)).select(value, "n", (F.col("n") / F.col("total")).alias("frequency"))
    return g.where(F.col("frequency") > least).orderBy(F.desc("frequency"), value)


def share_rows(runs: DataFrame, by: Sequence[str], flags: Mapping[str, Column]) -> DataFrame:
    """Feed of a bar chart: one row a group and measure with its share in percent and the size of its base (rows where it is not null)."""
    g = runs.groupBy(*by).agg(*[x for k, c in flags.items() for x in (F.avg(c.cast("double")).alias(f"{k}_share"), F.count(c).alias(f"{k}_base"))])
    rows = F.array(*[F.struct(F.lit(k).alias("measure"), F.round(F.col(f"{k}_share") * 100, 6).alias("percent"), F.col(f"{k}_base").alias("base")) for k in flags])
    return g.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
