"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Every row gets a global number below N; a keyed Feistel network permutes the
numbers 0..N-1, and shard and slot follow from the permuted number alone:
``shard = p mod shards``, ``slot = p div shards``. So the shuffle can be
repeated, shard sizes differ by one at most, and slots have no gaps.

Nulls hash like any other value, repeated rows get numbers of their own (which
of two equal rows gets which does not matter), an empty table gives an empty
result. Columns called ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.llm.common import packed, row_hash, shape, unpacked

#: Rows that a hash bucket has on average; row numbers are counted bucket by bucket.
BUCKET_ROWS = 2_000
#: Fewest and most buckets: the offsets of the most are a table of 24 MB.
FEWEST, MOST = 64, 1 << 20
#: Rounds of the network; four give a pseudo-random permutation, two are to spare.
ROUNDS = 6
#: Walks out of the domain are rarer than 1 in sqrt(N) a step, and there are fewer than sqrt(N) numbers outside it.
WALKS = 40


def _digest(*parts: Column) -> Column:
    """48 bits of the MD5 of the parts, written one after the other with bars between them; any SQL engine gives the same."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def _network(x: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass over Z_a x Z_b: the halves take turns to be shifted by a hash of the other."""
    left, right = F.call_function("div", x, b), x % b
    for k in range(ROUNDS):
        if k % 2 == 0:
            left = (left + _digest(F.lit(seed), F.lit(k), right) % a) % a
        else:
            right = (right + _digest(F.lit(seed), F.lit(k), left) % b) % b
    return left * b + right


def number_rows(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Columns ``row`` (the given row), ``number`` (0..N-1, the same in every run) and ``total`` (N).

    Rows are dealt to buckets by a hash of the whole row, so that no value of a
    column can fill one (only copies of a whole row meet in one, which the sort
    spills); the bucket's offset is the count of rows in those before it. The
    number of buckets follows from the count of rows. ``keys`` (default: all
    columns) are the columns that the numbers depend on, by a 48-bit digest of
    their texts where they are given and a 64-bit hash of the row where not.
    """
    shape(df, *(keys or []))
    buckets = max(FEWEST, min(MOST, df.count() // BUCKET_ROWS))
    h = _digest(*[F.col(f"`{k}`") for k in keys]) if keys else row_hash(df)
    d = packed(df, h=h).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    counts = packed(df, h=h).select(F.pmod("h", F.lit(buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = counts.select(
        "bucket",
        (F.sum("n").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("offset"),
        F.sum("n").over(W.partitionBy()).alias("total"),
    )
    # At most MOST rows of three numbers: a proven bound.
    d = d.join(F.broadcast(offsets), "bucket")
    order = W.partitionBy("bucket").orderBy("h", *([F.col(f"row.`{k}`") for k in keys] if keys else []))
    return d.select("row", (F.col("offset") + F.row_number().over(order) - 1).alias("number"), "total")


def permute(number: Column, total: Column, seed: int = 7) -> Column:
    """The place of ``number`` in a keyed permutation of 0..total-1."""
    a = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    b = F.call_function("div", total + a - 1, a)
    first = _network(number, a, b, seed)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        first,
        lambda x, _: F.when(x < total, x).otherwise(_network(x, a, b, seed)),
    )
    return F.when(first < total, first).otherwise(
        F.when(walk < total, walk).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))
    )


def shard_rows(df: DataFrame, shards: int, seed: int = 7, keys: list[str] | None = None) -> DataFrame:
    """``df`` with ``shard`` (int) and ``slot`` (long); shards differ by one row at most."""
    if shards < 1:
        raise ValueError("shards must be positive")
    d = number_rows(df, keys).select("row", permute(F.col("number"), F.col("total"), seed).alias("p"))
    return unpacked(d, df.columns, shard=(F.col("p") % shards).cast("int"), slot=F.call_function("div", F.col("p"), F.lit(shards)))


def write_shards(df: DataFrame, path: str, shards: int, seed: int = 7) -> None:
    """Write one folder a shard, each file in slot order."""
    out = shard_rows(df, shards, seed)
    out.repartitionByRange(shards, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
