"""State replay and three-way state differences.

A state is a JSON text. ``flatten`` makes it rows of (path, value); a path is an
array of steps, an array index is written ``[n]``. The three-way difference of
initial, gold and predicted states is relational: leaves of gold and predicted
meet in a full outer join, and a subtree that one side lacks counts once, at
its top.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import cut
from pyspark.sql import types as T

_ROWS = T.ArrayType(T.StructType([T.StructField("path", T.ArrayType(T.StringType())), T.StructField("value", T.StringType())]))


def _leaves(text: str | None) -> list[tuple[list[str], str]]:
    """Every node of a JSON value: inner nodes as ``{}`` or ``[]``, leaves as canonical JSON."""
    if text is None:
        return []
    out: list[tuple[list[str], str]] = []
    stack: list[tuple[list[str], object]] = [([], json.loads(text))]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            out.append((path, "{}"))
            stack += [([*path, k], x) for k, x in v.items()]
        elif isinstance(v, list):
            out.append((path, "[]"))
            stack += [([*path, f"[{k}]"], x) for k, x in enumerate(v)]
        else:
            out.append((path, json.dumps(v, sort_keys=True)))
    return out


@F.pandas_udf(_ROWS)
def _flatten(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"path": p, "value": v} for p, v in _leaves(t)])


def flatten(df: DataFrame, key: str, state: str) -> DataFrame:
    """``key, path, value``: one row a node of the state."""
    return df.select(key, F.explode(_flatten(F.col(state))).alias("n")).select(key, "n.path", "n.value")


def structural_diff(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, path, kind, old, new`` for every leaf that is in one of two JSON states only (added, removed) or differs (changed)."""
    both = df.select(key, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col(a).alias("s")), F.struct(F.lit(1).alias("side"), F.col(b).alias("s")))).alias("x"))
    n = both.select(key, "x.side", F.explode(_flatten(F.col("x.s"))).alias("n")).select(key, "side", F.array_join("n.path", ".").alias("path"), F.col("n.value").alias("v"))
    at = lambda k: F.max(F.when(F.col("side") == k, F.col("v")))
    g = n.groupBy(key, "path").agg(at(0).alias("old"), at(1).alias("new")).where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return g.select(key, "path", kind.alias("kind"), "old", "new")


def _nodes(df: DataFrame, key: str, **states: str) -> DataFrame:
    """``key, path`` of every node of any of the JSON columns, with ``<name>`` (its own value) and ``<name>_tree`` (a hash of all at and below it) for each.

    All states are parsed in one pass; a node counts for itself and for each node above it.
    """
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("s")) for n, c in states.items()])
    n = df.select(key, F.explode(sides).alias("x")).select(key, "x.side", F.explode(_flatten(F.col("x.s"))).alias("n")).select(key, "side", "n.path", "n.value")
    up = n.select(key, "side", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda k: F.slice("path", F.lit(1), k))).alias("top"), "path", "value")
    h = F.xxhash64(F.slice("path", F.size("top") + 1, F.size("path")), F.col("value")).cast("decimal(38,0)")
    out = []
    for name in states:
        mine = F.col("side") == name
        own = F.max(F.when(mine & (F.size("top") == F.size("path")), F.col("value")))
        tree = F.when(F.count_if(mine) > 0, F.concat_ws(":", F.sum(F.when(mine, h)).cast("string"), F.count_if(mine).cast("string")))
        out += [own.alias(name), tree.alias(f"{name}_tree")]
    return up.groupBy(key, F.col("top").alias("path")).agg(*out)


def three_way(df: DataFrame, key: str, initial: str, gold: str, predicted: str) -> DataFrame:
    """``key, path, kind`` for every difference between gold and predicted: missed, extra or wrong."""
    d = _nodes(df, key, i=initial, g=gold, p=predicted).where(~F.col("g").eqNullSafe(F.col("p")))
    # What a difference stands on: a node below one that already differs says nothing new.
    tops = d.select(key, F.col("path").alias("top"))
    above = d.select(key, "path", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", F.lit(1), n))).alias("top")).where(F.size("top") < F.size("path"))
    nested = above.join(tops, [key, "top"], "left_semi").select(key, "path").distinct()
    return d.join(nested, [key, "path"], "left_anti").select(key, "path", kind_of(F.col("i_tree"), F.col("g_tree"), F.col("p_tree")).alias("kind"))


def kind_of(initial: Column, gold: Column, predicted: Column) -> Column:
    """missed: the gold change did not happen; extra: a change that gold lacks; wrong: another change."""
    kept, intended = predicted.eqNullSafe(initial), ~gold.eqNullSafe(initial)
    return F.when(kept & intended, "missed").when(~kept & ~intended, "extra").otherwise("wrong")


def abstract_path(path: Column, fields: Sequence[str]) -> Column:
    """Known fields stay, indexes become ``[]``, anything else a star."""
    step = lambda s: F.when(s.rlike(r"^\[\d+\]$"), "[]").when(s.isin(*fields), s).otherwise("*")
    return F.replace(F.array_join(F.transform(path, step), "."), F.lit(".[]"), F.lit("[]"))


def signatures(diff: DataFrame, keys: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """``key, db_signature, db_kinds`` of every key; without differences the signature is ``no_db_diff``."""
    item = F.concat_ws(":", F.col("kind"), abstract_path(F.col("path"), fields))
    g = diff.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(item)), ";").alias("signature_"), F.array_sort(F.collect_set("kind")).alias("kinds_"))
    return keys.select(key).distinct().join(g, key, "left").select(key, F.coalesce("signature_", F.lit("no_db_diff")).alias("db_signature"), F.coalesce("kinds_", F.array().cast("array<string>")).alias("db_kinds"))


def kind_rows(columns: Sequence[str], initial: DataFrame, gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """The difference of three flat tables by key and column, without nesting."""
    stack = lambda d, n: d.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(n)) for c in columns])).alias("x")).select(key, "x.*")
    d = stack(gold, "g").join(stack(predicted, "p"), [key, "field"], "full_outer").join(stack(initial, "i"), [key, "field"], "left")
    d = d.where(~F.col("g").eqNullSafe(F.col("p")))
    return d.select(key, "field", kind_of(F.col("i"), F.col("g"), F.col("p")).alias("kind"))


def replay(calls: DataFrame, initial: DataFrame, key: str, reducer: Callable[[dict, str, dict], object], mutating: Sequence[str], state: str = "state", isolate: bool = False) -> DataFrame:
    """The state of each key after its calls: only mutating ones are applied, in order.

    ``calls``: key, pos, name, arguments (JSON), response (JSON or null);
    ``initial``: key, state (JSON). ``reducer`` changes the state in place and
    returns the call's response; a recorded response that differs raises. A
    trajectory is the unit of the fold; calls that don't mutate never get here.
    With ``isolate`` a failure stays with its key: its state is null, ``applied``
    counts the calls before it and ``reason`` says what was wrong.
    """
    schema = f"{key} {dict(initial.dtypes)[key]}, {state} string, applied long" + ", reason string" * isolate
    live = calls.where(F.col("name").isin(*mutating)).select(key, "pos", "name", "arguments", "response")
    d = initial.select(key, F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.lit(None).cast("string").alias("response"), state)
    d = d.unionByName(live.withColumn(state, F.lit(None).cast("string")).withColumn("pos", F.col("pos").cast("long")))

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        start = frame[frame["name"].isna()]
        columns = [key, state, "applied", *["reason"] * isolate]
        if start.empty:
            return pd.DataFrame({c: [] for c in columns})
        n, reason, after = 0, None, None
        try:
            now = json.loads(start[state].iloc[0])
            for name, args, response in frame[frame["name"].notna()][["name", "arguments", "response"]].itertuples(index=False):
                got = reducer(now, name, json.loads(args or "{}"))
                if response is not None and json.loads(response) != got:
                    raise ValueError(f"replayed response of {name} differs")
                n += 1
            after = json.dumps(now, sort_keys=True)
        except Exception as e:
            if not isolate:
                raise
            reason = f"{type(e).__name__}: {e}"
        return pd.DataFrame([(start[key].iloc[0], after, n, reason)[: len(columns)]], columns=columns)

    return d.groupBy(key).applyInPandas(fold, schema)


def replay_and_diff(initial: DataFrame, gold: DataFrame, predicted: DataFrame, key: str, reducer: Callable[[dict, str, dict], object], mutating: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``key, db_signature, db_kinds, reason``: both trajectories replayed from the initial state, and their three-way difference.

    A trajectory that can't be replayed leaves its key without a signature and
    gives the reason, the gold one's before the predicted one's; all others go on.
    """
    side = lambda calls, n: replay(calls, initial, key, reducer, mutating, isolate=True).select(key, F.col("state").alias(n), F.concat(F.lit(f"{n}: "), "reason").alias(f"{n}_reason"))
    d = initial.select(key, F.col("state").alias("initial")).join(side(gold, "gold"), key, "left").join(side(predicted, "predicted"), key, "left")
    # Both folds are read by the difference and by the reasons.
    d = cut(d)
    whole = d.where("gold is not null and predicted is not null")
    signed = signatures(three_way(whole, key, "initial", "gold", "predicted"), whole, key, fields)
    return d.select(key, F.coalesce("gold_reason", "predicted_reason").alias("reason")).join(signed, key, "left").select(key, "db_signature", "db_kinds", "reason")


def end_states_equal(a: DataFrame, b: DataFrame, key: str, states: Sequence[str]) -> DataFrame:
    """Whether all named states agree, by the hash of their canonical text."""
    h = lambda d, n: d.select(key, *[F.sha2(F.col(s), 256).alias(f"{n}_{s}") for s in states])
    same = F.lit(True)
    for s in states:
        same = same & F.col(f"a_{s}").eqNullSafe(F.col(f"b_{s}"))
    return h(a, "a").join(h(b, "b"), key, "full_outer").select(key, same.alias("db_match"))
