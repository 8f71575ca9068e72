"""Reward of a run from its checks: actions, communication, state, assertions; evaluation by type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions.text import mentions, merge_chunks
from tracemill.operators.joins import args_match
from tracemill.operators.metrics import all_true, product_of

#: The kinds of evaluation and the components that each looks at.
KINDS = {
    "env": ("DB", "ENV_ASSERTION"),
    "action": ("ACTION",),
    "communicate": ("COMMUNICATE",),
    "nl_assertions": ("NL_ASSERTION",),
    "all": ("DB", "ENV_ASSERTION", "ACTION", "COMMUNICATE"),
    "all_with_nl_assertions": ("DB", "ENV_ASSERTION", "ACTION", "COMMUNICATE", "NL_ASSERTION"),
    "all_ignore_basis": ("DB", "ENV_ASSERTION", "ACTION", "COMMUNICATE"),
    "all_with_nl_assertions_ignore_basis": ("DB", "ENV_ASSERTION", "ACTION", "COMMUNICATE", "NL_ASSERTION"),
}
ENDS = ("agent_stop", "user_stop")


def action_checks(runs: DataFrame, gold: str, calls: str) -> DataFrame:
    """``runs`` with ``action_match``, for each gold action whether some call has its name and arguments.

    Gold: array<struct<name, arguments map, compare_args array>>, calls:
    array<struct<name, arguments map>>. One call may serve several actions.
    """
    hit = lambda g: F.exists(calls, lambda c: (c["name"] == g["name"]) & args_match(g["arguments"], c["arguments"], g["compare_args"]))
    return runs.withColumn("action_match", F.transform(F.coalesce(gold, F.array().cast(runs.schema[gold].dataType)), lambda g: F.coalesce(hit(g), F.lit(False))))


def communicate_checks(runs: DataFrame, info: str, said: str) -> DataFrame:
    """``runs`` with ``communicate_met``: for each piece of information whether an agent message holds it."""
    return runs.withColumn("communicate_met", F.transform(F.coalesce(info, F.array().cast("array<string>")), lambda x: F.coalesce(mentions(F.col(said), x), F.lit(False))))


def spoken(chunks: DataFrame, run: str = "run_id") -> DataFrame:
    """Agent speech of a tick stream as messages: neighbouring chunks that share an utterance id are one.

    Chunks: run, pos, text, ids array. A chunk without ids continues the message before it.
    """
    w = W.partitionBy(run).orderBy("pos")
    held = F.last(F.when(F.size("ids") > 0, F.col("ids")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce((F.size("ids") > 0) & ~F.arrays_overlap("ids", held), F.lit(False)).cast("int")
    d = chunks.withColumn("new", new).withColumn("message", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text", "ids"))), lambda c: F.struct(c["text"].alias("text"), c["ids"].alias("ids")))
    g = d.groupBy(run, "message").agg(merge_chunks(parts).alias("text"))
    return g.groupBy(run).agg(F.transform(F.sort_array(F.collect_list(F.struct("message", "text"))), lambda m: m["text"]).alias("said"))


def component_rewards(runs: DataFrame) -> DataFrame:
    """``breakdown`` of a run from ``db_match``, ``env_met``, ``action_match``, ``communicate_met`` and ``nl_met`` (arrays but the first); nothing to check counts one."""
    score = lambda c: F.when(F.col(c).isNull(), 1.0).otherwise(all_true(F.col(c)))
    db = F.when(F.col("db_match").isNull() | F.col("db_match"), 1.0).otherwise(0.0)
    names = ("DB", "ENV_ASSERTION", "ACTION", "COMMUNICATE", "NL_ASSERTION")
    values = (db, score("env_met"), score("action_match"), score("communicate_met"), score("nl_met"))
    return runs.withColumn("breakdown", F.create_map(*[x for n, v in zip(names, values) for x in (F.lit(n), v)]))


def evaluate(runs: DataFrame, kind: str, basis: str = "reward_basis", reason: str = "termination_reason") -> DataFrame:
    """``runs`` with ``reward``: 0 for a premature end, 1 without criteria (null basis), else the product of what counts.

    ``all`` kinds multiply the components in the basis and raise where the basis
    names one that they don't look at; an assertion in the basis makes ``all``
    look at assertions. Kinds that ignore the basis, and single kinds, multiply
    all of their own.
    """
    seen = KINDS[kind]
    whole = kind.startswith("all") and not kind.endswith("ignore_basis")
    known = list(dict.fromkeys([*seen, *(("NL_ASSERTION",) if whole else ())]))
    part = lambda n: F.element_at("breakdown", n)
    inside = lambda n: F.coalesce(F.array_contains(basis, n), F.lit(False)) if whole else F.lit(True)
    reward = product_of(F.array(*[F.when(inside(n), part(n)).otherwise(1.0) for n in (known if whole else seen)]))
    stray = F.array_except(F.col(basis), F.array(*[F.lit(n) for n in known]))
    checked = F.when(F.size(stray) > 0, F.raise_error(F.concat(F.lit("not evaluated: "), F.array_join(stray, ", "))).cast("double")).otherwise(reward) if whole else reward
    out = F.when(~F.coalesce(F.col(reason).isin(*ENDS), F.lit(False)), 0.0).when(F.col(basis).isNull(), 1.0).otherwise(checked)
    return component_rewards(runs).withColumn("reward", out)


def call_results(messages: DataFrame, run: str = "run_id") -> DataFrame:
    """Calls with the results that follow them in order; a result whose id is not the call's raises.

    Messages: run, pos, role, calls array<struct<id,name>>, tool_call_id, content.
    """
    calls = messages.where(F.size("calls") > 0).select(run, "pos", F.posexplode("calls").alias("k", "c")).select(run, "pos", "k", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.lit(None).cast("string").alias("content"), F.lit(0).alias("kind"))
    got = messages.where("role = 'tool'").select(run, "pos", F.lit(0).alias("k"), F.col("tool_call_id").alias("call_id"), F.lit(None).cast("string").alias("name"), "content", F.lit(1).alias("kind"))
    d = calls.unionByName(got).withColumn("n", F.row_number().over(W.partitionBy(run, "kind").orderBy("pos", "k")))
    a, b = d.where("kind = 0").alias("a"), d.where("kind = 1").alias("b")
    j = a.join(b, (F.col(f"a.{run}") == F.col(f"b.{run}")) & (F.col("a.n") == F.col("b.n")), "full_outer")
    same = F.col("a.call_id").eqNullSafe(F.col("b.call_id"))
    name = F.when(same, F.col("a.name")).otherwise(F.raise_error(F.concat(F.lit("no result for call "), F.coalesce("a.call_id", "b.call_id"))).cast("string"))
    return j.select(F.col(f"a.{run}").alias(run), F.col("a.n").alias("n"), F.col("a.call_id").alias("call_id"), name.alias("name"), F.col("b.content").alias("content"))


def reevaluate(runs: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One reward column for each kind."""
    d = component_rewards(runs)
    for k in kinds:
        d = d.join(evaluate(runs, k).select("run_id", F.col("reward").alias(f"reward_{k}")), "run_id")
    return d
