"""Joins beyond plain equality: as-of, range, containment, windows, existential and multiset matches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def on_keys(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.lit(True))


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, take: Sequence[str], strict: bool = True) -> DataFrame:
    """Each left row with the columns ``take`` of the latest right row of its keys before it (or at it).

    One shuffle by key: both sides are stacked in order and the last right row
    is carried forward, so no pair of rows is ever formed.
    """
    side = lambda df, n: df.select(*keys, F.col(at).alias("at"), F.lit(n).alias("side"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    l = side(left, 0 if strict else 1).select("*", F.lit(None).cast(_struct_type(right)).alias("match"))
    r = side(right, 1 if strict else 0)
    r = r.select(*keys, "at", "side", F.lit(None).cast(_struct_type(left)).alias("row"), F.col("row").alias("match"))
    w = W.partitionBy(*keys).orderBy("at", "side").rowsBetween(W.unboundedPreceding, -1)
    d = l.unionByName(r).withColumn("found", F.last("match", ignorenulls=True).over(w)).where("row is not null")
    return d.select("row.*", *[F.col(f"found.{c}").alias(f"prev_{c}") for c in take])


def _struct_type(df: DataFrame):
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias("s")).schema[0].dataType


def tiles(start: Column, end: Column, width: float) -> Column:
    """The numbers of the tiles of ``width`` that an interval touches."""
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width))


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], width: float, contained: bool = False) -> DataFrame:
    """Pairs of intervals (columns start, end) with equal keys that overlap, ends inclusive, or where a's lies inside b's.

    Both sides are cut into tiles of ``width``, so the join is by key and tile
    rather than by key alone; a pair counts in the tile where its common part
    begins, so none comes out twice.
    """
    ta = a.withColumn("tile", F.explode(tiles(F.col("start"), F.col("end"), width))).alias("a")
    tb = b.withColumn("tile", F.explode(tiles(F.col("start"), F.col("end"), width))).alias("b")
    meet = (F.col("a.start") <= F.col("b.end")) & (F.col("b.start") <= F.col("a.end"))
    if contained:
        meet = (F.col("a.start") >= F.col("b.start")) & (F.col("a.end") <= F.col("b.end"))
    once = F.col("a.tile") == F.floor(F.greatest(F.col("a.start"), F.col("b.start")) / width)
    eq = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], F.col("a.tile") == F.col("b.tile"))
    out = ta.join(tb, eq & meet & once)
    rest = lambda df, n: [F.col(f"{n}.{c}").alias(f"{n}_{c}") for c in df.columns if c not in keys]
    return out.select(*[F.col(f"a.{k}").alias(k) for k in keys], *rest(a, "a"), *rest(b, "b"))


def open_overlap(start: Column, end: Column, lo: Column, hi: Column) -> Column:
    """Half-open overlap with [lo, hi); an end that is null or zero is open."""
    return (start < hi) & (F.coalesce(F.nullif(end, F.lit(0)).cast("double"), F.lit(float("inf"))) > lo)


def response_windows(calls: DataFrame, answers: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Each call with ``answered``: whether an answer's interval meets the time from its start to the next call's start.

    Answers are carried to calls in order: an answer that starts in the window,
    or one that started before and still lasts, shows in one running maximum.
    """
    w = W.partitionBy(key).orderBy("at", "kind")
    c = calls.select(key, F.col(start).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("double").alias("until"), F.struct(*calls.columns).alias("row"))
    a = answers.select(key, F.col(start).alias("at"), F.lit(0).alias("kind"), F.col(end).cast("double").alias("until"), F.lit(None).cast(_struct_type(calls)).alias("row"))
    d = c.unionByName(a)
    d = d.select(
        "*",
        F.max("until").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("lasting"),
        F.min(F.when(F.col("kind") == 1, F.col("at"))).over(w.rowsBetween(1, W.unboundedFollowing)).alias("next_call"),
        F.min(F.when(F.col("kind") == 0, F.col("at"))).over(w.rowsBetween(1, W.unboundedFollowing)).alias("next_answer"),
    ).where("kind = 1")
    during = F.coalesce(F.col("lasting") >= F.col("at").cast("double"), F.lit(False))
    after = F.coalesce(F.col("next_answer") < F.col("next_call"), F.col("next_answer").isNotNull() & F.col("next_call").isNull(), F.lit(False))
    return d.select("row.*", (during | after).alias("answered"))


def exists_match(gold: DataFrame, calls: DataFrame, key: str, condition: str) -> DataFrame:
    """Gold rows with ``matched``: some call of the same key meets the SQL ``condition`` (over aliases a and b). A call may serve several.

    A subquery in the select list is one existence join: no pairs, no second pass.
    """
    sql = f"select a.*, exists(select 1 from {{calls}} b where a.`{key}` = b.`{key}` and ({condition})) as matched from {{gold}} a"
    return gold.sparkSession.sql(sql, gold=gold, calls=calls)


def args_match(gold: Column, call: Column, compare: Column) -> Column:
    """Equality of two argument maps on the keys of ``compare``; null compares the keys of the call alone."""
    keys = F.coalesce(compare, F.map_keys(call))
    part = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, _: F.array_contains(keys, k))))
    return part(gold) == part(call)


def missing_and_extra(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that lacks them."""
    x = a.select(key).distinct().join(b, key, "left_anti").select(key, F.lit("missing").alias("side"))
    return x.unionByName(b.select(key).distinct().join(a, key, "left_anti").select(key, F.lit("extra").alias("side")))


def paired(spec: DataFrame, base: DataFrame, candidate: DataFrame, key: str, value: str) -> DataFrame:
    """The spec's keys with both values; a missing side counts 0.0."""
    b = base.select(key, F.col(value).alias("baseline"))
    c = candidate.select(key, F.col(value).alias("candidate"))
    d = spec.join(b, key, "left").join(c, key, "left")
    return d.withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("baseline", "candidate")})


def one_stop(legs: DataFrame, start: str, via_from: str, via_to: str, leave: str, arrive: str, keep: str) -> DataFrame:
    """Two legs where the second starts where and not before the first ends."""
    a, b = legs.alias("a"), legs.alias("b")
    return a.join(b, (F.col(f"a.{via_to}") == F.col(f"b.{via_from}")) & (F.col(f"b.{leave}") >= F.col(f"a.{arrive}"))).select(
        F.col(f"a.{start}").alias(start), F.col(f"a.{keep}").alias("first"), F.col(f"b.{keep}").alias("second")
    )


def compose(sets: Sequence[DataFrame], name: str, valid: Column | None = None) -> DataFrame:
    """All choices of at most one option from each set, as sorted arrays; the sets are small by nature."""
    out = None
    for k, s in enumerate(sets):
        nothing = s.sparkSession.range(1, numPartitions=1).select(F.lit(None).cast(s.schema[name].dataType).alias(f"o{k}"))
        options = s.select(F.col(name).alias(f"o{k}")).unionByName(nothing).coalesce(1)
        out = options if out is None else out.crossJoin(options)
    combo = F.array_sort(F.array_compact(F.array(*[F.col(f"o{k}") for k in range(len(sets))])))
    out = out.select(combo.alias("combo"))
    return out if valid is None else out.where(valid)


def multiset_contained(need: DataFrame, have: DataFrame, key: str, item: str) -> DataFrame:
    """Per key whether every needed item is there at least as many times."""
    n = need.groupBy(key, item).agg(F.count("*").alias("need"))
    h = have.groupBy(key, item).agg(F.count("*").alias("have"))
    return n.join(h, [key, item], "left").groupBy(key).agg(F.bool_and(F.col("need") <= F.coalesce("have", F.lit(0))).alias("contained"))


def assign_first(items: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Each item to the first segment that overlaps it or ended before it began; the rest to the last segment.

    Items have ``item, start, end``, segments ``segment, start, end``, none ending
    before it starts. So a segment fits just if it starts no later than the item
    ends, and the first one is a running minimum: one shuffle, no pairs. Items
    without a key get no segment.
    """
    s = segments.select(key, F.col("start").alias("_at"), F.lit(0).alias("_kind"), "segment", F.lit(None).cast(items.schema["item"].dataType).alias("item"))
    i = items.select(key, F.col("end").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(segments.schema["segment"].dataType).alias("segment"), "item")
    whole = W.partitionBy(key)
    before = whole.orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = s.unionByName(i).select(key, "item", "_kind", F.min("segment").over(before).alias("_first"), F.max("segment").over(whole).alias("_last")).where("_kind = 1")
    return d.select(key, "item", F.when(F.col(key).isNotNull(), F.coalesce("_first", "_last")).alias("segment"))
