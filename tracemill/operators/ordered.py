"""Ordered analytics: streaks, islands, segments, collapses, running values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.session import cut


def rank_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Places 1..n; ties get places of their own."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def reindex(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "turn_idx") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def collapse_array(names: Column) -> Column:
    """An array without repeats of the element before."""
    return F.filter(names, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(names, i - 1)))


def chain(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, where: Column | None = None, sep: str = "->") -> DataFrame:
    """The chain of names in order, repeats collapsed; a filter comes first."""
    d = df if where is None else df.where(where)
    w = W.partitionBy(*by).orderBy(*order)
    d = d.select(*by, F.col(name).alias("name"), F.row_number().over(w).alias("pos"), F.lag(name).over(w).alias("before"))
    d = d.where(~F.col("name").eqNullSafe(F.col("before")))
    steps = F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"])
    return d.groupBy(*by).agg(F.array_join(steps, sep).alias("chain"), F.count("*").alias("length"))


def leading_streak(df: DataFrame, by: Sequence[str], order: Sequence[Column], ok: Column) -> DataFrame:
    """Rows at the head that are all ``ok``; groups without any count zero."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    d = df.withColumn("broken", F.sum(F.when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)).over(w))
    return d.groupBy(*by).agg(F.count_if(F.col("broken") == 0).alias("streak"))


def gap_segments(df: DataFrame, by: Sequence[str], at: Column, order: Sequence[Column], gap: float, name: str = "segment") -> DataFrame:
    """Segment numbers from 0: a step larger than ``gap`` starts a new one, a step of exactly the gap does not."""
    w = W.partitionBy(*by).orderBy(*order)
    new = F.coalesce((at - F.lag(at).over(w)) > gap, F.lit(False)).cast("int")
    d = df.withColumn("new_segment", new)
    return d.withColumn(name, F.sum("new_segment").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("new_segment")


def islands(df: DataFrame, by: Sequence[str], pos: Column, on: Column, order: Sequence[Column], least: int = 1) -> DataFrame:
    """Runs of consecutive rows where ``on`` holds: start, end and length, of at least ``least`` rows."""
    w = W.partitionBy(*by).orderBy(*order)
    d = df.select(*by, pos.alias("pos"), F.coalesce(on, F.lit(False)).alias("on"), F.row_number().over(w).alias("rn"))
    d = d.where("on").withColumn("island", F.col("rn") - F.row_number().over(W.partitionBy(*by).orderBy("rn")))
    g = d.groupBy(*by, "island").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("length"))
    return g.where(F.col("length") >= least).drop("island")


def longest_run(df: DataFrame, by: Sequence[str], on: Column, order: Sequence[Column]) -> DataFrame:
    """The longest run of consecutive rows where ``on`` holds, 0 if there is none."""
    runs = islands(df, by, F.lit(0), on, order).groupBy(*by).agg(F.max("length").alias("longest"))
    return df.select(*by).distinct().join(runs, list(by), "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def silences(df: DataFrame, by: Sequence[str], at: Column, order: Sequence[Column], least: float) -> DataFrame:
    """Gaps of at least ``least`` between neighbours."""
    w = W.partitionBy(*by).orderBy(*order)
    d = df.select(*by, at.alias("start"), F.lead(at).over(w).alias("end"))
    return d.withColumn("duration", F.col("end") - F.col("start")).where(F.col("duration") >= least)


def merge_intervals(df: DataFrame, by: Sequence[str], start: str, end: str, order: Sequence[Column], gap: float, text: str | None = None) -> DataFrame:
    """Intervals no further apart than ``gap`` become one; texts are joined by spaces in order."""
    w = W.partitionBy(*by).orderBy(*order)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    d = df.withColumn("new_group", F.coalesce(F.col(start) > reach + gap, F.lit(True)).cast("int")).withColumn("place", F.row_number().over(w))
    d = d.withColumn("grp", F.sum("new_group").over(w.rowsBetween(W.unboundedPreceding, 0)))
    more = [F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", text))), lambda x: x[text]), " ").alias(text)] if text else []
    return d.groupBy(*by, "grp").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts"), *more)


def carry_forward(df: DataFrame, by: Sequence[str], value: str, order: Sequence[Column], name: str) -> DataFrame:
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def gap_timing(df: DataFrame, by: Sequence[str], at: str, order: Sequence[Column]) -> DataFrame:
    """A row's bar: ``offset``, where the row before stands after the group's first time, and ``wait``, the time from there.

    A null time takes the one before it; nulls at the head take the first time there is.
    """
    w = W.partitionBy(*by).orderBy(*order)
    d = carry_forward(df, by, at, order, "known")
    d = d.withColumn("start", F.first(at, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    d = d.withColumn("known", F.coalesce("known", "start"))
    d = d.withColumn("before", F.coalesce(F.lag("known").over(w), F.col("start")))
    secs = lambda x: F.round(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), 3)
    return d.withColumn("offset", secs(F.col("before") - F.col("start"))).withColumn("wait", secs(F.col("known") - F.col("before"))).drop("known", "start", "before")


def pattern_groups(df: DataFrame, by: Sequence[str], pattern: str, order: Sequence[Column], alone: Column | None = None) -> DataFrame:
    """Group numbers that change with the pattern; a null pattern belongs to the group before it; rows ``alone`` are groups of their own."""
    w = W.partitionBy(*by).orderBy(*order)
    full = w.rowsBetween(W.unboundedPreceding, 0)
    alone = F.lit(False) if alone is None else F.coalesce(alone, F.lit(False))
    d = df.withColumn("held", F.last(pattern, ignorenulls=True).over(full)).withColumn("single", alone)
    change = ~F.col("held").eqNullSafe(F.lag("held").over(w)) | F.col("single") | F.coalesce(F.lag("single").over(w), F.lit(False))
    return d.withColumn("change", (F.coalesce(change, F.lit(True)) & (F.row_number().over(w) > 1)).cast("int")).withColumn("grp", F.sum("change").over(full)).drop("change", "held", "single")


def frontier(df: DataFrame, by: Sequence[str], value: str, order: Sequence[Column]) -> DataFrame:
    """Rows that are strictly above all before them."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("best", F.max(value).over(w)).where(F.col("best").isNull() | (F.col(value) > F.col("best"))).drop("best")


def proportional_release(df: DataFrame, by: Sequence[str], order: Sequence[Column], ratio: Column, text: str) -> DataFrame:
    """The part of ``text`` that each step releases: to the ceiling of ratio times its length, never back."""
    w = W.partitionBy(*by).orderBy(*order)
    end = F.max(F.least(F.ceil(ratio * F.length(text)), F.length(text).cast("long"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    d = df.withColumn("released", end).withColumn("from", F.coalesce(F.lag("released").over(w), F.lit(0)))
    return d.withColumn("part", F.substr(F.col(text), (F.col("from") + 1).cast("int"), (F.col("released") - F.col("from")).cast("int")))


def envelope(df: DataFrame, by: Sequence[str], pos: Column, value: str, points: int) -> DataFrame:
    """Minimum and maximum of each whole window of a group; a window is a ``points``-th of the group's rows, one row at least, so only a rest shorter than a window is left out."""
    d = df.withColumn("pos", pos)
    n = d.groupBy(*by).agg(F.count("*").alias("n")).withColumn("width", F.greatest(F.lit(1).cast("long"), F.expr(f"n div {int(points)}")))
    n = n.select(*[F.col(b).alias(f"of_{b}") for b in by], "n", "width")
    d = d.join(n, [F.col(b).eqNullSafe(F.col(f"of_{b}")) for b in by]).withColumn("bucket", F.expr("pos div width")).where(F.col("bucket") < F.expr("n div width"))
    return d.groupBy(*by, "bucket").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def nearest_shallower(df: DataFrame, by: Sequence[str], pos: str, depth: str, deepest: int) -> DataFrame:
    """The parent of each node in a pre-order list: the nearest one before it of smaller depth."""
    w = W.partitionBy(*by).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    above = [F.when(F.col(depth) == d, F.max(F.when(F.col(depth) < d, F.col(pos))).over(w)) for d in range(1, deepest + 1)]
    return df.withColumn("parent", F.coalesce(*above))


def running_total(df: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the running total of a whole ``value`` over all rows in ``order``, rows that tie in any order but each its own.

    Rows are dealt by ranges of the order and written once, so a row's range is
    fixed; the ranges' sums are summed up, and rows only within their range.
    """
    spark = df.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = cut(df.withColumn("_value", value.cast("long")).repartitionByRange(ranges, *order)).withColumn("_range", F.spark_partition_id())
    sums = d.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    # One row a range.
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.sum("_value").over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return d.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + within).drop("_range", "_value", "_before")
