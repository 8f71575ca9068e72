"""Comparing runs: flips, verdicts, subsets, leaderboards, alignments."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PASS = 0.999


def flip(before: Column, after: Column) -> Column:
    return F.when((before < PASS) & (after >= PASS), "improved").when((before >= PASS) & (after < PASS), "regressed").otherwise("same")


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison; a missing side counts 0."""
    x = a.select(key, F.col(value).alias("before"))
    y = b.select(key, F.col(value).alias("after"))
    d = x.join(y, key, "full_outer").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("before", "after")})
    return d.withColumn("delta", F.col("after") - F.col("before")).withColumn("flip", flip(F.col("before"), F.col("after")))


def outcome_flow(a: DataFrame, b: DataFrame, key: str, reward: str) -> DataFrame:
    """Counts of the four outcomes of all-trials-pass before and after; a missing side does not pass."""
    mean = lambda d, n: d.groupBy(key).agg((F.avg(reward) >= PASS).alias(n))
    d = mean(a, "p").join(mean(b, "q"), key, "full_outer").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("p", "q")})
    flow = F.when(F.col("p") & F.col("q"), "both").when(F.col("p"), "lost").when(F.col("q"), "gained").otherwise("neither")
    return d.groupBy(flow.alias("flow")).agg(F.count("*").alias("tasks"))


def mode_shift(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """Failure modes with their counts on both sides, most frequent together first."""
    x = a.groupBy(label).agg(F.count("*").alias("before"))
    y = b.groupBy(label).agg(F.count("*").alias("after"))
    d = x.join(y, label, "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("before", "after")})
    return d.withColumn("shift", F.col("after") - F.col("before")).orderBy(F.desc(F.col("before") + F.col("after")), label)


def subset_verdict(spec: DataFrame, baseline: DataFrame, candidate: DataFrame, task: str, reward: str, role: str = "role") -> DataFrame:
    """One row: flips, those of targets and controls, and the verdict.

    Each side's reward of a task is its best trial; a missing side counts 0. A
    control that regresses fails the candidate, a target that improves passes
    it, an improvement elsewhere alone is to be reviewed, none at all fails.
    """
    best = lambda d, n: d.groupBy(task).agg(F.max(reward).alias(n))
    d = spec.join(best(baseline, "b"), task, "left").join(best(candidate, "c"), task, "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("b", "c")})
    f = flip(F.col("b"), F.col("c"))
    d = d.agg(
        F.count_if(f == "improved").alias("improved"),
        F.count_if((F.col(role) == "target") & (f == "improved")).alias("target_improved"),
        F.count_if(f == "regressed").alias("regressed"),
        F.count_if(F.col(role).isin("control", "oracle_stable") & (f == "regressed")).alias("control_regressed"),
        F.count("*").alias("tasks"),
    )
    verdict = F.when(F.col("control_regressed") > 0, "fail").when(F.col("target_improved") > 0, "pass").when(F.col("improved") > 0, "review").otherwise("fail")
    return d.withColumn("verdict", verdict)


def representatives(df: DataFrame, bucket: str, order: Sequence[Column]) -> DataFrame:
    """One row of each bucket, the first by order."""
    return df.withColumn("r", F.row_number().over(W.partitionBy(bucket).orderBy(*order))).where("r = 1").drop("r")


def ordered_union(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """The keys of all parts, each once, where it occurs first."""
    d = None
    for n, p in enumerate(parts):
        x = p.select(F.col(key), (F.lit(n).cast("long")).alias("part"), F.col("pos").cast("long").alias("pos"))
        d = x if d is None else d.unionByName(x)
    return d.groupBy(key).agg(F.min(F.struct("part", "pos")).alias("p")).orderBy("p").select(key)


def best_entry(entries: DataFrame, model: str, score: str, order: str) -> DataFrame:
    """A model's best submission, later ones winning ties; its date is the release, else the evaluation, else the submission."""
    d = entries.withColumn("date", F.coalesce("release_date", "evaluation_date", "submission_date"))
    w = W.partitionBy(model).orderBy(F.desc_nulls_last(score), F.desc(order))
    return d.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def leaderboard(entries: DataFrame, model: str, domain: str, ks: Sequence[int] = (1, 2, 3, 4)) -> DataFrame:
    """Averages over the domains that a model has, consistency pass^4 / pass^1, best first and nulls last."""
    g = entries.groupBy(model).agg(F.count(domain).alias("domains"), *[F.avg(f"pass_{k}").alias(f"pass_{k}") for k in ks])
    top = max(ks)
    g = g.withColumn("consistency", F.col(f"pass_{top}") / F.nullif(F.col(f"pass_{min(ks)}"), F.lit(0.0)))
    return g.orderBy(F.desc_nulls_last(f"pass_{min(ks)}"), model)


def metric_check(submitted: DataFrame, computed: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Submitted values that differ from computed ones, or lack one."""
    d = submitted.join(computed.withColumnRenamed(value, "computed"), list(keys), "left")
    same = (F.abs(F.col(value) - F.col("computed")) <= tolerance) | (F.col(value).isNull() & F.col("computed").isNull())
    return d.where(~F.coalesce(same, F.lit(False)))


# --- alignment ------------------------------------------------------------------


def lcs_pairs(a: list, b: list) -> list[tuple[str, int | None, int | None]]:
    """(op, index in a, index in b) of a longest common subsequence alignment; a removal that an addition follows is a replacement."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        row, below = best[i], best[i + 1]
        for j in reversed(range(m)):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out: list[tuple[str, int | None, int | None]] = []
    removed: list[int] = []
    added: list[int] = []

    def close() -> None:
        for k in range(max(len(removed), len(added))):
            x = removed[k] if k < len(removed) else None
            y = added[k] if k < len(added) else None
            out.append(("replace" if x is not None and y is not None else "remove" if y is None else "add", x, y))
        removed.clear()
        added.clear()

    i = j = 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            close()
            out.append(("equal", i, j))
            i, j = i + 1, j + 1
        elif j >= m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            removed.append(i)
            i += 1
        else:
            added.append(j)
            j += 1
    close()
    return out


def align(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Alignment rows of two arrays of step keys: ``key, pos, op, a_step, b_step``."""
    schema = f"{key} {dict(pairs.dtypes)[key]}, pos int, op string, a_step string, b_step string"

    def run(frames):
        for f in frames:
            rows = []
            for k, x, y in zip(f[key], f[a], f[b]):
                x, y = list(x) if x is not None else [], list(y) if y is not None else []
                rows += [(k, p, op, x[i] if i is not None else None, y[j] if j is not None else None) for p, (op, i, j) in enumerate(lcs_pairs(x, y))]
            yield pd.DataFrame(rows, columns=[key, "pos", "op", "a_step", "b_step"])

    return pairs.select(key, a, b).mapInPandas(run, schema)


def word_diff(pairs: DataFrame, key: str, a: str, b: str, limit: int = 4000) -> DataFrame:
    """Counts of equal, removed and added words of two texts; null where either is longer than ``limit`` characters."""
    schema = f"{key} {dict(pairs.dtypes)[key]}, equal int, removed int, added int"

    def run(frames):
        for f in frames:
            rows = []
            for k, x, y in zip(f[key], f[a], f[b]):
                x, y = x or "", y or ""
                if len(x) > limit or len(y) > limit:
                    rows.append((k, None, None, None))
                    continue
                ops = lcs_pairs(x.split(), y.split())
                rows.append((k, sum(o[0] == "equal" for o in ops), sum(o[1] is not None and o[0] != "equal" for o in ops), sum(o[2] is not None and o[0] != "equal" for o in ops)))
            yield pd.DataFrame(rows, columns=[key, "equal", "removed", "added"]).astype({c: "Int32" for c in ("equal", "removed", "added")})

    return pairs.select(key, a, b).mapInPandas(run, schema)
