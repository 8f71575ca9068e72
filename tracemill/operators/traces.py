"""Trace features: tool sequences, failure classes, policy flags, signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators.metrics import successful
from tracemill.operators.ordered import collapse_array

#: Component names and termination reasons of the run record.
DB, NL, COMMUNICATE = "DB", "NL_ASSERTION", "COMMUNICATE"
NORMAL_ENDS = ("user_stop", "agent_stop")


def component_failed(info: Column, name: str, checks: Column | None) -> Column:
    """A component that counts failed: by the breakdown if it has one, else by its checks (true: failed)."""
    value = F.try_element_at(info["reward_breakdown"], F.lit(name))
    by_checks = F.coalesce(checks, F.lit(False)) if checks is not None else F.lit(False)
    inside = F.coalesce(F.array_contains(info["reward_basis"], name), F.lit(False))
    return inside & F.when(value.isNotNull(), ~successful(value)).otherwise(by_checks)


def failure_class(info: Column, reason: Column) -> Column:
    """pass, termination, mixed, db_only, nl_only or communicate_only."""
    unmet = lambda a: F.exists(a, lambda c: ~F.coalesce(c["met"], F.lit(False)))
    db = component_failed(info, DB, ~info["db_check"]["db_match"])
    nl = component_failed(info, NL, unmet(info["nl_assertions"]))
    comm = component_failed(info, COMMUNICATE, unmet(info["communicate_checks"]))
    return (
        F.when(info.isNull(), "termination")
        .when(successful(info["reward"]), "pass")
        .when(reason.isNotNull() & ~reason.isin(*NORMAL_ENDS), "termination")
        .when(db & nl, "mixed")
        .when(db, "db_only")
        .when(nl, "nl_only")
        .when(comm, "communicate_only")
        .otherwise("termination")
    )


def mechanism(failure: Column, escalated: Column, writes: Column, kinds: Column, errors: Column) -> Column:
    """The root cause by a list of rules, first match wins. ``kinds``: array of state-diff kinds, ``errors``: array of messages."""
    has = lambda k: F.coalesce(F.array_contains(kinds, k), F.lit(False))
    lost = F.coalesce(F.contains(F.lower(F.array_join(errors, " ")), F.lit("not found")), F.lit(False))
    idle = F.coalesce(F.size(writes), F.lit(0)) <= 0
    return (
        F.when(failure == "pass", "pass")
        .when(failure == "termination", "premature_termination")
        .when(failure.isin("nl_only", "communicate_only"), F.when(escalated, "bailed_transfer").otherwise("comm_miss"))
        .when(idle & lost & escalated, "identification_failure")
        .when(escalated, "bailed_transfer")
        .when(idle, "stalled_no_action")
        .when(has("wrong") | has("extra"), "wrong_params")
        .when(has("missed"), "incomplete_multitask")
        .otherwise("other")
    )


def tool_sequence(messages: DataFrame, run: str = "run_id") -> DataFrame:
    """Assistant tool calls in order: ``run, seq, turn, call_id, name, error``.

    Messages have ``pos, role, calls array<struct<id,name>>, tool_call_id, error``.
    ``turn`` counts tool-bearing messages; a result's error goes to the last
    earlier call of its id.
    """
    talk = messages.where((F.col("role") == "assistant") & (F.size("calls") > 0))
    talk = talk.withColumn("turn", F.row_number().over(W.partitionBy(run).orderBy("pos")) - 1)
    calls = talk.select(run, "pos", "turn", F.posexplode("calls").alias("k", "c")).select(run, "pos", "turn", "k", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"))
    calls = calls.withColumn("seq", F.row_number().over(W.partitionBy(run).orderBy("pos", "k")) - 1)
    ids = W.partitionBy(run, "call_id").orderBy("seq")
    calls = calls.withColumn("next_pos", F.lead("pos").over(ids))
    results = messages.where((F.col("role") == "tool") & F.col("error")).select(run, F.col("tool_call_id").alias("call_id"), F.col("pos").alias("result_pos"))
    d = calls.alias("c").join(
        results.alias("r"),
        (F.col(f"c.{run}") == F.col(f"r.{run}")) & (F.col("c.call_id") == F.col("r.call_id")) & (F.col("r.result_pos") > F.col("c.pos")) & (F.col("r.result_pos") < F.coalesce(F.col("c.next_pos"), F.lit(2**62))),
        "left",
    )
    return d.groupBy(F.col(f"c.{run}").alias(run), F.col("c.seq").alias("seq"), F.col("c.turn").alias("turn"), F.col("c.call_id").alias("call_id"), F.col("c.name").alias("name")).agg(F.bool_or(F.col("r.result_pos").isNotNull()).alias("error"))


def policy_flags(calls: DataFrame, messages: DataFrame, writes: Sequence[str], auth: Sequence[str], run: str = "run_id") -> DataFrame:
    """Tri-state flags of each run that has calls.

    ``confirm_before_write`` compares the index of the first write with the
    number of tool-bearing turns before a confirming user message.
    """
    w = F.col("name").isin(*writes)
    first = F.min(F.when(w, F.col("seq")))
    per_turn = calls.groupBy(run, "turn").agg(F.count("*").alias("n")).groupBy(run).agg((F.max("n") <= 1).alias("single_tool_per_turn"))
    g = calls.groupBy(run).agg(first.alias("first_write"), F.min(F.when(F.col("name").isin(*auth), F.col("seq"))).alias("first_auth"), F.count_if("error").alias("num_env_errors"))
    order = W.partitionBy(run).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    bearing = ((F.col("role") == "assistant") & (F.coalesce(F.size("calls"), F.lit(0)) > 0)).cast("int")
    said = messages.withColumn("turns_before", F.sum(bearing).over(order))
    said = said.where((F.col("role") == "user") & X.confirms(F.col("content"))).groupBy(run).agg(F.min("turns_before").alias("first_yes"))
    d = g.join(per_turn, run).join(said, run, "left")
    return d.select(
        run,
        F.when(F.col("first_write").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("first_auth") < F.col("first_write"), F.lit(False))).alias("auth_before_mutate"),
        F.when(F.col("first_write").isNotNull(), F.coalesce(F.col("first_yes") < F.col("first_write"), F.lit(False))).alias("confirm_before_write"),
        "single_tool_per_turn",
        "num_env_errors",
    )


def chains(calls: DataFrame, writes: Sequence[str], run: str = "run_id") -> DataFrame:
    """``tool_chain`` and ``write_chain`` of each run; writes are filtered before repeats collapse."""
    names = F.transform(F.sort_array(F.collect_list(F.struct("seq", "name"))), lambda x: x["name"])
    d = calls.groupBy(run).agg(names.alias("names"))
    return d.select(run, collapse_array(F.col("names")).alias("tool_chain"), collapse_array(F.filter("names", lambda n: n.isin(*writes))).alias("write_chain"))


def nl_signature(info: Column) -> Column:
    """The failed assertions without their values, sorted and joined; null if none is left."""
    failed = F.filter(info["nl_assertions"], lambda c: ~F.coalesce(c["met"], F.lit(False)))
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(failed, lambda c: X.denoise_value(c["nl_assertion"])), lambda t: t != "")))
    return F.when(F.size(clean) > 0, F.array_join(clean, "|"))


def primary_signature(failure: Column, db: Column, nl: Column, writes: Column, tools: Column) -> Column:
    """The grouping key of a failure: its state diff, its failed assertions, or else its chain of writes (of tools)."""
    chain = F.when(F.size(writes) > 0, F.array_join(writes, "->")).when(F.size(tools) > 0, F.array_join(tools, "->")).otherwise("no_tools")
    by_db = F.when(failure.isin("db_only", "mixed"), F.concat(F.lit("db="), F.coalesce(db, F.lit("unknown"))))
    by_nl = F.when(failure.isin("nl_only", "mixed"), F.concat(F.lit("nl="), F.coalesce(nl, F.lit("unknown"))))
    return F.coalesce(F.nullif(F.concat_ws(" | ", by_db, by_nl), F.lit("")), F.concat(F.lit("chain="), chain))


def embedding_text(failure: Column, tools: Column, flags: Column, reason: Column, db: Column, nl: Column) -> Column:
    """One line that describes a run for clustering."""
    state = lambda c, name: F.when(c, f"{name}_ok").when(~c, f"{name}_missing")
    words = F.array_compact(
        F.array(
            state(flags["auth_before_mutate"], "auth"),
            state(flags["confirm_before_write"], "confirm"),
            F.when(~flags["single_tool_per_turn"], "multi_tool_turn"),
            F.when(flags["num_env_errors"] > 0, F.concat(F.lit("env_errors="), flags["num_env_errors"].cast("string"))),
        )
    )
    or_none = lambda s: F.coalesce(F.nullif(s, F.lit("")), F.lit("none"))
    optional = lambda name, c: F.when(c != "", F.concat(F.lit(name), c))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("failure_type="), failure),
        F.concat(F.lit("tools="), or_none(F.array_join(tools, ","))),
        F.concat(F.lit("flags="), or_none(F.array_join(words, ","))),
        F.concat(F.lit("termination="), or_none(reason)),
        optional("db_diff=", db),
        optional("nl_diff=", nl),
    )


def last_agent_message(messages: DataFrame, run: str = "run_id") -> DataFrame:
    said = messages.where((F.col("role") == "assistant") & (F.col("content") != ""))
    return said.groupBy(run).agg(F.max_by("content", "pos").alias("content")).select(run, X.denoise_free(F.col("content")).alias("last_message"))


def tool_errors(messages: DataFrame, run: str = "run_id") -> DataFrame:
    """The different error texts of each run, in order of their first occurrence."""
    d = messages.where((F.col("role") == "tool") & F.col("error")).select(run, "pos", X.denoise_free(F.col("content"), 80).alias("e")).where("e <> ''")
    d = d.groupBy(run, "e").agg(F.min("pos").alias("pos"))
    return d.groupBy(run).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "e"))), lambda x: x["e"]).alias("tool_errors"))


def error_counts(messages: DataFrame, run: str = "run_id") -> DataFrame:
    """``run, communication_errors, environment_errors``: messages of the parties, and of tools, that are errors."""
    bad, tool = F.coalesce(F.col("error"), F.lit(False)), F.col("role") == "tool"
    return messages.groupBy(run).agg(F.count_if(bad & ~tool).alias("communication_errors"), F.count_if(bad & tool).alias("environment_errors"))


def features(runs: DataFrame, messages: DataFrame, writes: Sequence[str], auth: Sequence[str], diffs: DataFrame | None = None, run: str = "run_id", transfer: str = "transfer_to_human_agents") -> DataFrame:
    """One wide row a run: outcome, chains, flags, errors, signatures, mechanism and clustering text.

    ``diffs`` (run, db_signature, db_kinds) comes from the state diff of the runs whose state failed.
    """
    calls = tool_sequence(messages, run)
    d = runs.join(chains(calls, writes, run), run, "left").join(policy_flags(calls, messages, writes, auth, run), run, "left")
    d = d.join(last_agent_message(messages, run), run, "left").join(tool_errors(messages, run), run, "left")
    if diffs is None:
        d = d.withColumn("db_signature", F.lit(None).cast("string")).withColumn("db_kinds", F.lit(None).cast("array<string>"))
    else:
        d = d.join(diffs, run, "left")
    empty = F.array().cast("array<string>")
    d = d.withColumns({c: F.coalesce(c, empty) for c in ("tool_chain", "write_chain", "tool_errors")})
    d = d.withColumn("failure_type", failure_class(F.col("reward_info"), F.col("termination_reason")))
    d = d.withColumn("nl_signature", nl_signature(F.col("reward_info")))
    d = d.withColumn("escalated", F.array_contains("tool_chain", transfer))
    d = d.withColumn("mechanism", mechanism(F.col("failure_type"), F.col("escalated"), F.col("write_chain"), F.col("db_kinds"), F.col("tool_errors")))
    d = d.withColumn("signature", primary_signature(F.col("failure_type"), F.col("db_signature"), F.col("nl_signature"), F.col("write_chain"), F.col("tool_chain")))
    flags = F.struct("auth_before_mutate", "confirm_before_write", F.coalesce("single_tool_per_turn", F.lit(True)).alias("single_tool_per_turn"), F.coalesce("num_env_errors", F.lit(0)).alias("num_env_errors"))
    return d.withColumn("embedding_text", embedding_text(F.col("failure_type"), F.col("tool_chain"), flags, F.col("termination_reason"), F.col("db_signature"), F.col("nl_signature")))
