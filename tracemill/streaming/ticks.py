"""Tick streams: two channels of a conversation in step, and their orders as sequences.

A tick row is ``conv_id, tick_id, ts, self_text, other_text, self_calls
array<struct<id,name>>, other_results array<struct<id,content>>``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.operators.ordered import gap_segments

#: Places of the kinds of output at one tick.
SILENCE, OTHER, SELF, TOOL, CONTINUATION = -1, 0, 1, 2, 3


def speech(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def active(text: Column, items: Column) -> Column:
    return speech(text) | F.coalesce(F.size(items) > 0, F.lit(False))


def events(ticks: DataFrame, order: str = "other") -> DataFrame:
    """One row a channel and tick that has content: ``conv_id, tick_id, ts, side, kind, text``; ``order`` says who comes first."""
    first = {"other": (0, 1), "self": (1, 0)}[order]
    channel = lambda side, place, text, items, tool: F.struct(F.lit(side).alias("side"), F.lit(place).alias("place"), F.when(F.size(items) > 0, tool).otherwise("speech").alias("kind"), F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: x["id"]), ",")).otherwise(text).alias("text"), active(text, items).alias("on"))
    both = F.array(channel("other", first[0], F.col("other_text"), F.col("other_results"), "result"), channel("self", first[1], F.col("self_text"), F.col("self_calls"), "call"))
    return ticks.select("conv_id", "tick_id", "ts", F.explode(both).alias("e")).where("e.on").select("conv_id", "tick_id", "ts", "e.side", "e.place", "e.kind", "e.text")


def expand_environment(ticks: DataFrame) -> DataFrame:
    """Ticks with both speech and results of the other side become two, results first; ticks are numbered anew."""
    has = F.coalesce(F.size("other_results") > 0, F.lit(False))
    row = lambda k, text, results, own, calls: F.struct(F.lit(k).alias("k"), text.alias("other_text"), results.alias("other_results"), own.alias("self_text"), calls.alias("self_calls"))
    null = lambda c: F.lit(None).cast(ticks.schema[c].dataType)
    whole = row(0, F.when(has, null("other_text")).otherwise(F.col("other_text")), F.col("other_results"), F.col("self_text"), F.col("self_calls"))
    spoken = row(1, F.col("other_text"), null("other_results"), null("self_text"), null("self_calls"))
    d = ticks.select("conv_id", "tick_id", "ts", F.explode(F.array_compact(F.array(whole, F.when(has & F.col("other_text").isNotNull(), spoken)))).alias("r"))
    w = W.partitionBy("conv_id").orderBy("tick_id", "r.k")
    d = d.withColumn("n", F.row_number().over(w) - 1)
    return d.select("conv_id", F.col("n").cast("int").alias("tick_id"), "ts", "r.self_text", "r.other_text", "r.self_calls", "r.other_results")


def consolidate(rows: DataFrame, order: Sequence[str], by: Sequence[str] = ("side", "kind")) -> DataFrame:
    """Adjacent rows of one side and kind in one: ``conv_id, place, side, kind, text``."""
    w = W.partitionBy("conv_id").orderBy(*order)
    change = F.lit(False)
    for c in by:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    d = rows.withColumn("pos", F.row_number().over(w)).withColumn("new", change.cast("int"))
    d = d.withColumn("grp", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    g = d.groupBy("conv_id", "grp", *by).agg(F.min("pos").alias("pos"), text.alias("text"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy("pos"))).select("conv_id", "place", *by, "text")


def linearise(ticks: DataFrame, strategy: str = "other") -> DataFrame:
    """``other`` or ``self`` first within a tick, or by ``timestamp``; same-speaker runs are joined."""
    e = events(ticks, "self" if strategy == "self" else "other")
    return consolidate(e, ["ts", "tick_id", "place"] if strategy == "timestamp" else ["tick_id", "place"])


def segments(ticks: DataFrame, side: str, integration: int = 1) -> DataFrame:
    """Speech segments of a side: ``conv_id, segment, start, end, text``; gaps up to ``integration`` ticks don't end one."""
    text, tools = (F.col(f"{side}_text"), F.col("self_calls" if side == "self" else "other_results"))
    d = ticks.where(speech(text) & ~F.coalesce(F.size(tools) > 0, F.lit(False))).select("conv_id", "tick_id", text.alias("text"))
    d = gap_segments(d, ["conv_id"], F.col("tick_id"), [F.col("tick_id")], max(1, integration))
    parts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tick_id", "text"))), lambda x: x["text"]), "")
    return d.groupBy("conv_id", "segment").agg(F.min("tick_id").alias("start"), F.max("tick_id").alias("end"), parts.alias("text"))


def silence_periods(ticks: DataFrame, least: int, tick_seconds: float) -> DataFrame:
    """Runs of at least ``least`` ticks in which nobody speaks, with their annotation."""
    quiet = ~speech(F.col("self_text")) & ~speech(F.col("other_text"))
    w = W.partitionBy("conv_id").orderBy("tick_id")
    d = ticks.select("conv_id", "tick_id", quiet.alias("quiet"), F.row_number().over(w).alias("rn")).where("quiet")
    d = d.withColumn("g", F.col("rn") - F.row_number().over(w))
    g = d.groupBy("conv_id", "g").agg(F.min("tick_id").alias("start"), F.count("*").alias("ticks")).where(F.col("ticks") >= least)
    return g.select("conv_id", "start", "ticks", F.format_string("[Both parties silent for %.1f seconds]", F.col("ticks") * F.lit(float(tick_seconds))).alias("text"))


def splice(own: list[tuple[int, int, dict]], other: list[tuple[int, int, dict]]) -> list[tuple[int, int, str, str]]:
    """Order segments (start, end, {tick: text}) of two sides: ``(tick, place, side, text)``.

    A segment inside one of the other side splits it where it ends. Equal spans
    count as own inside other. The parts of an own container and what it holds
    keep the places of the rule: own 1, held 3. Segments that merely cross, and
    all others, stand at their start.
    """
    inside = lambda a, b: b[0] <= a[0] and a[1] <= b[1]
    held_by_other = {j: [i for i, a in enumerate(own) if inside(a, b)] for j, b in enumerate(other)}
    held_by_own = {i: [j for j, b in enumerate(other) if inside(b, a) and not inside(a, b)] for i, a in enumerate(own)}
    out: list[tuple[int, int, str, str]] = []
    done_own: set[int] = set()
    done_other: set[int] = set()

    def text(seg: dict, lo: float, hi: float) -> str:
        return "".join(seg[t] for t in sorted(seg) if lo < t <= hi)

    def cut(outer, holder: str, held: list, holder_place: int, held_name: str, held_place: int, rest_place: int) -> None:
        last = outer[0] - 1
        for seg in sorted(held, key=lambda s: s[1]):
            if part := text(outer[2], last, seg[1]):
                out.append((seg[1], holder_place, holder, part))
            out.append((seg[1], held_place, held_name, text(seg[2], -1, float("inf"))))
            last = seg[1]
        if part := text(outer[2], last, float("inf")):
            out.append((last + 1, rest_place, holder, part))

    for j in sorted((j for j, held in held_by_other.items() if held), key=lambda j: min(held_by_other[j])):
        done_other.add(j)
        done_own.update(held_by_other[j])
        cut(other[j], "other", [own[i] for i in held_by_other[j]], OTHER, "self", SELF, CONTINUATION)
    for i, held in held_by_own.items():
        if held and i not in done_own:
            done_own.add(i)
            done_other.update(held)
            cut(own[i], "self", [other[j] for j in held], SELF, "other", CONTINUATION, SELF)
    out += [(s[0], OTHER, "other", text(s[2], -1, float("inf"))) for j, s in enumerate(other) if j not in done_other]
    out += [(s[0], SELF, "self", text(s[2], -1, float("inf"))) for i, s in enumerate(own) if i not in done_own]
    return sorted(out, key=lambda x: x[:2])


def _collect(frame: pd.DataFrame, column: str, tools: str, integration: int) -> list[tuple[int, int, dict]]:
    found: list[list] = []
    for t, text, items in zip(frame["tick_id"], frame[column], frame[tools]):
        if not isinstance(text, str) or not text.strip() or (items is not None and len(items)):
            continue
        if found and t - found[-1][1] <= integration:
            found[-1][1] = t
            found[-1][2][t] = text
        else:
            found.append([t, t, {t: text}])
    return [tuple(x) for x in found]


def linearise_containment(ticks: DataFrame, integration: int = 1, silence: int = 0, tick_seconds: float = 0.2) -> DataFrame:
    """``conv_id, place, side, text``: speech by the splice rule, calls with their results, silences of ``silence`` ticks or more.

    A conversation's ticks are folded in one task, as its order needs them all.
    """
    schema = f"conv_id {dict(ticks.dtypes)['conv_id']}, place int, side string, text string"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("tick_id")
        out = splice(_collect(f, "self_text", "self_calls", max(1, integration)), _collect(f, "other_text", "other_results", max(1, integration)))
        results: dict[str, str] = {}
        waiting: dict[str, tuple[int, str]] = {}
        for t, calls, got in zip(f["tick_id"], f["self_calls"], f["other_results"]):
            for c in calls if calls is not None else ():
                waiting[c["id"]] = (t, c["id"])
            for r in got if got is not None else ():
                if r["id"] in waiting:
                    results[waiting.pop(r["id"])[1]] = r["id"]
                else:
                    earlier = [(at, i) for i, (at, _) in waiting.items() if at < t]
                    if earlier:
                        call = max(earlier)[1]
                        waiting.pop(call)
                        results[call] = r["id"]
        for t, calls in zip(f["tick_id"], f["self_calls"]):
            if calls is not None and len(calls):
                names = [c["id"] for c in calls]
                out.append((t, TOOL, "tool", ",".join(f"call {n}" for n in names) + "".join(f";result {results[n]}" for n in names if n in results)))
        if silence > 0:
            quiet: list[int] = []
            for t, a, b in [*zip(f["tick_id"], f["self_text"], f["other_text"]), (None, "end", None)]:
                if t is not None and not any(isinstance(x, str) and x.strip() for x in (a, b)):
                    quiet.append(t)
                else:
                    if len(quiet) >= silence:
                        out.append((quiet[0], SILENCE, "system", f"[Both parties silent for {len(quiet) * tick_seconds:.1f} seconds]"))
                    quiet = []
        out.sort(key=lambda x: x[:2])
        return pd.DataFrame([(f["conv_id"].iloc[0], k, s, x) for k, (_, _, s, x) in enumerate(out)], columns=["conv_id", "place", "side", "text"])

    return ticks.groupBy("conv_id").applyInPandas(run, schema)


def linearise_overlap(ticks: DataFrame, integration: int = 1) -> DataFrame:
    """Overlap regions with all of the other side first: ``conv_id, place, side, text``.

    A region opens where both sides speak and lasts while self does not pause
    for ``integration`` ticks; tool ticks end it.
    """
    schema = f"conv_id {dict(ticks.dtypes)['conv_id']}, place int, side string, text string"
    grace = max(1, integration)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for a, b, calls, got in f.sort_values("tick_id")[["self_text", "other_text", "self_calls", "other_results"]].itertuples(index=False):
            call = ",".join(c["id"] for c in calls) if calls is not None and len(calls) else ""
            result = ",".join(c["id"] for c in got) if got is not None and len(got) else ""
            rows.append((call or (a if isinstance(a, str) and a.strip() else ""), result or (b if isinstance(b, str) and b.strip() else ""), bool(call or result)))
        out: list[tuple[str, str]] = []
        k = 0
        while k < len(rows):
            mine, theirs, tool = rows[k]
            if not (mine and theirs) or tool:
                out += [(s, x) for s, x in (("other", theirs), ("self", mine)) if x]
                k += 1
                continue
            region: dict[str, list[str]] = {"other": [], "self": []}
            pause = 0
            while k < len(rows) and not rows[k][2]:
                pause = 0 if rows[k][0] else pause + 1
                if pause >= grace:
                    break
                region["other"] += [rows[k][1]] if rows[k][1] else []
                region["self"] += [rows[k][0]] if rows[k][0] else []
                k += 1
            out += [(s, x) for s in ("other", "self") for x in region[s]]
        return pd.DataFrame([(f["conv_id"].iloc[0], n, s, x) for n, (s, x) in enumerate(out)], columns=["conv_id", "place", "side", "text"])

    return ticks.groupBy("conv_id").applyInPandas(run, schema)


def overlap_initiator(own_run: Column, other_run: Column) -> Column:
    """Who broke in: whoever has spoken for less long; a tie counts for the other side."""
    return F.when((own_run == 0) | (other_run == 0), None).when(own_run >= other_run, "other").otherwise("self")


def speech_counters(ticks: DataFrame) -> DataFrame:
    """Total ticks of the other side's speech, and those since its last pause."""
    w = W.partitionBy("conv_id").orderBy(F.desc("tick_id")).rowsBetween(W.unboundedPreceding, 0)
    on = speech(F.col("other_text"))
    d = ticks.select("conv_id", "tick_id", on.alias("on")).withColumn("pauses", F.sum((~F.col("on")).cast("int")).over(w))
    return d.groupBy("conv_id").agg(F.count_if("on").alias("total"), F.count_if(F.col("pauses") == 0).alias("ongoing"))


def close_intervals(log: DataFrame, last: Column) -> DataFrame:
    """Open and close events of an interval log, paired last opened first: ``run_id, effect, who, start, end``.

    A running depth pairs each close with the latest open at its depth; what
    stays open ends at ``last``. Closes without an open are ignored.
    """
    keys = ["run_id", "effect", "who"]
    w = W.partitionBy(*keys).orderBy("at", "seq").rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("event") == "open", 1).otherwise(-1)
    d = log.withColumn("step", step).withColumn("sum", F.sum("step").over(w))
    # Closes that find nothing open drag the sum below its floor; the floor is taken out again.
    d = d.withColumn("floor", F.least(F.min("sum").over(w), F.lit(0)))
    d = d.withColumn("stray", (F.col("step") < 0) & (F.col("sum") == F.col("floor")) & (F.col("sum") < F.coalesce(F.lag("floor").over(W.partitionBy(*keys).orderBy("at", "seq")), F.lit(0)))).where("not stray")
    d = d.withColumn("depth", F.col("sum") - F.col("floor") + F.when(F.col("step") < 0, 1).otherwise(0))
    pair = W.partitionBy(*keys, "depth").orderBy("at", "seq")
    d = d.withColumn("end", F.lead(F.when(F.col("event") == "close", F.col("at"))).over(pair)).where("event = 'open'")
    return d.select(*keys, F.col("at").alias("start"), F.coalesce("end", last).alias("end"))


def transcripts(events_: DataFrame) -> DataFrame:
    """Items from start, stop and completed events; an item that completes before it starts is ignored."""
    at = lambda e: F.max(F.when(F.col("event") == e, F.col("at")))
    d = events_.groupBy("item_id").agg(at("start").alias("start"), at("stop").alias("stop"), F.max(F.when(F.col("event") == "completed", F.struct("at", "text"))).alias("done"))
    return d.where(F.col("start").isNotNull() & (F.col("done.at") >= F.col("start"))).select("item_id", "start", F.coalesce("stop", F.col("done.at")).alias("end"), F.col("done.text").alias("text"))


def carry_over(ticks: DataFrame, cap: int, discard: bool = False) -> DataFrame:
    """Bytes that play in each tick when at most ``cap`` fit and the rest waits, or is discarded.

    What has waited at tick n is the largest sum of arrivals less capacity over
    any stretch that ends there: a running sum less its running minimum.
    """
    if discard:
        return ticks.withColumns({"waiting": F.lit(0).cast("long"), "played": F.least(F.col("bytes"), F.lit(cap)).cast("long")})
    w = W.partitionBy("conv_id").orderBy("tick_id").rowsBetween(W.unboundedPreceding, 0)
    d = ticks.withColumn("walk", F.sum(F.col("bytes") - cap).over(w))
    d = d.withColumn("waiting", F.col("walk") - F.least(F.lit(0), F.min("walk").over(w)))
    before = F.coalesce(F.lag("waiting").over(W.partitionBy("conv_id").orderBy("tick_id")), F.lit(0))
    return d.withColumn("played", before + F.col("bytes") - F.col("waiting")).drop("walk")


def replay_order(ticks: DataFrame) -> DataFrame:
    """Tool calls of both sides in order of replay: at one tick the user's before the agent's."""
    both = F.array(F.struct(F.lit(0).alias("side"), F.col("user_calls").alias("calls")), F.struct(F.lit(1).alias("side"), F.col("agent_calls").alias("calls")))
    d = ticks.select("conv_id", "tick_id", F.explode(both).alias("b")).select("conv_id", "tick_id", "b.side", F.posexplode("b.calls").alias("k", "call"))
    return d.withColumn("pos", F.row_number().over(W.partitionBy("conv_id").orderBy("tick_id", "side", "k")) - 1)
