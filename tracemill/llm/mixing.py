"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight, so
that better documents tend to come first. A source's budget first buys whole
passes over it (complete epochs); what is left buys documents in key order
until the prefix sum of sizes reaches it, the last one if more than half of it
still fits. Nothing is truncated: a document is taken whole or not at all.

Prefix sums are two-level: keys fall into buckets of a 256th of an octave or
less, so that a source of any size spreads over (source, bucket) groups of some
20,000 rows at most; bucket sums are summed per source, rows only within their
bucket. Buckets follow the order of keys, so their width changes no result.

A null source is a source of its own, after all others; a null text has size
0; equal rows draw equal keys and are interchangeable; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.llm.common import WORD, cut, packed, row_hash, shape, unpacked

#: Fewest key buckets an octave; the fullest of 256 holds about 0.1% of its source. More rows get more buckets.
PER_OCTAVE = 256
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def letter_share(text: Column) -> Column:
    """A plain quality weight from 0.1 to 1: the share of letters and white space in the text."""
    rest = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    share = F.lit(1.0) - rest / F.length(text)
    return F.when(F.length(text) > 0, F.greatest(F.lit(0.1), share)).otherwise(F.lit(0.1))


def uniform(*parts: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on the parts and the seed only."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float, budget: int | None = None) -> DataFrame:
    """``skey, source, source_size`` rows with ``target``: the budget shared by weight, none above cap times its size.

    What the capped sources leave is shared again by weight. In order of
    cap / weight the capped sources come first, so one pass of prefix sums
    finds the level. One row a source: this table does not grow with the rows.
    """
    everything = W.partitionBy()
    by_name = W.orderBy(F.col("source").isNull(), "source")
    nth = ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    t = sizes.select(
        "*",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth).alias("w"),
        (F.col("source_size") * float(cap)).alias("most"),
        (F.lit(float(budget)) if budget is not None else F.sum("source_size").over(everything).cast("double")).alias("all"),
    )
    order = W.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    t = t.select(
        "*",
        F.row_number().over(order).alias("pos"),
        (F.sum("most").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("most")).alias("spent"),
        F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing)).alias("w_left"),
    )
    t = t.withColumn("level", (F.col("all") - F.col("spent")) / F.col("w_left"))
    free = F.when(F.col("most") / F.col("w") > F.col("level"), F.struct("pos", "level"))
    t = t.withColumn("first", F.min(free).over(everything))
    target = F.when(F.col("first").isNull() | (F.col("pos") < F.col("first.pos")), F.col("most")).otherwise(F.col("first.level") * F.col("w"))
    return t.select("skey", "source", "source_size", target.alias("target"))


def _mixed(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size: Column | None = None,
    quality: Column | None = None,
    weights: Sequence[float] = (1, 2, 3),
    cap: int = 3,
    budget: int | None = None,
    seed: int = 11,
) -> DataFrame:
    shape(df, id_col, source_col, *([text_col] if size is None or quality is None else []))
    size = word_count(F.col(text_col)) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    quality = letter_share(F.col(text_col)) if quality is None else F.greatest(F.coalesce(quality, F.lit(1.0)), F.lit(1e-6))
    d = packed(df, source=F.col(source_col), id=F.col(id_col), size=size, q=quality, tie=row_hash(df))
    d = d.withColumn("skey", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    d = d.withColumn("key", -F.log(uniform(F.col("id"), F.col("size"), seed=seed)) / F.col("q"))
    octave = max(PER_OCTAVE, df.count() * PER_OCTAVE // (1000 * BUCKET_ROWS))
    d = d.withColumn("bucket", F.floor(F.log2("key") * octave).cast("long"))
    # Two plans need the sums; written once, they don't measure the texts twice.
    sums = cut(d.groupBy("skey", "bucket").agg(F.sum("size").alias("bsize"), F.first("source").alias("source")))
    sizes = sums.groupBy("skey").agg(F.sum("bsize").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(sizes, weights, cap, budget).drop("source")
    buckets = W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    offsets = sums.select("skey", "bucket", (F.sum("bsize").over(buckets) - F.col("bsize")).alias("offset")).join(targets, "skey")
    d = d.join(offsets, ["skey", "bucket"])
    rows = W.partitionBy("skey", "bucket").orderBy("key", "tie").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("before", F.col("offset") + F.sum("size").over(rows) - F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    d = d.withColumn("epochs", epochs)
    left = F.when(F.col("epochs") < cap, F.col("target") - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0.0))
    extra = (F.col("size") > 0) & (2 * F.col("before") + F.col("size") <= 2 * left)
    return d.withColumn("repeats", F.col("epochs") + extra.cast("long"))


def mix_sources(df: DataFrame, **how) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``repeats`` (times the document is taken) and ``taken`` (repeats x size).

    ``how``: id_col, source_col, text_col; ``size`` (default: words) and
    ``quality`` (default: share of letters) as columns; ``weights`` in order of
    source names, over and over; ``cap``, the most passes over a source;
    ``budget`` (default: all sizes); ``seed``. Columns of the new names are
    replaced.
    """
    d = _mixed(df, **how)
    new = {c: F.col(c) for c in ("size", "source_size", "target", "repeats")}
    return unpacked(d, df.columns, **new, taken=F.col("repeats") * F.col("size"))


def mixed_rows(df: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``df`` as many times as it is taken, with the columns of ``df`` alone."""
    d = _mixed(df, **how).where(F.col("repeats") > 0)
    d = d.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("copy"))
    return unpacked(d, df.columns)
