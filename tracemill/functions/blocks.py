"""Long recordings in blocks: cut, filtered and laid over each other without a whole track in one task.

A block is a row (key, block, pcm) of 16-bit little-endian samples. A filter needs
the samples before a block, so each block gets the tail of the one before by a join
on (key, block - 1); what comes out is the convolution of the whole track, to the
sample. Tracks are laid over each other by a clock: pieces meet in cells of it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def samples(pcm: Column) -> Column:
    """16-bit little-endian samples as an array of numbers; an odd byte at the end is left out."""
    both = F.regexp_extract_all(F.hex(pcm), F.lit("[0-9A-F]{4}"), F.lit(0))
    whole = F.transform(both, lambda h: F.conv(F.concat(F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("int"))
    return F.transform(whole, lambda x: F.when(x > 32767, x - 65536).otherwise(x))


def cut_blocks(df: DataFrame, key: str, pcm: str, samples: int) -> DataFrame:
    """``key, block, pcm``: tracks in blocks of ``samples``, the last one shorter; an odd byte at the end is left out."""
    size = 2 * samples
    whole = F.octet_length(pcm) - F.octet_length(pcm) % 2
    d = df.where(F.octet_length(pcm) > 1).select(key, F.col(pcm).alias("_pcm"), whole.alias("_whole"))
    d = d.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("_whole") - 1) / size).cast("int"))))
    at = F.col("block") * size
    return d.select(key, "block", F.substr("_pcm", at + 1, F.least(F.lit(size), F.col("_whole") - at)).alias("pcm"))


def join_blocks(df: DataFrame, key: str) -> DataFrame:
    """``key, pcm``: tracks out of their blocks; for tracks that fit a row."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("block", F.hex("pcm").alias("h")))), lambda x: x["h"])
    return df.groupBy(key).agg(F.unhex(F.array_join(parts, "")).alias("pcm"))


def filter_blocks(df: DataFrame, key: str, taps: Sequence[float]) -> DataFrame:
    """``key, block, pcm`` after a filter: sample n is the sum of tap k times sample n - k, rounded and clipped; silence before the track. Blocks but the last have at least taps - 1 samples."""
    h, lead = np.asarray(taps, float), 2 * (len(taps) - 1)
    size = F.octet_length("pcm")
    tail = F.substr("pcm", F.greatest(size - lead, F.lit(0)) + 1, F.lit(lead))
    before = df.select(key, (F.col("block") + 1).alias("block"), tail.alias("lead"))

    @F.arrow_udf("binary")
    def run(own: pa.Array, ahead: pa.Array) -> pa.Array:
        out = []
        for x, b in zip(own.to_pylist(), ahead.to_pylist()):
            s = np.frombuffer((b or b"").rjust(lead, b"\0") + x, "<i2").astype(float)
            out.append(np.clip(np.rint(np.convolve(s, h, mode="valid")), -32768, 32767).astype("<i2").tobytes())
        return pa.array(out, pa.binary())

    return df.join(before, [key, "block"], "left").select(key, "block", run("pcm", "lead").alias("pcm"))


def overlay(df: DataFrame, mix: str, at: Column, pcm: str, cell: int) -> DataFrame:
    """``mix, cell, pcm``: the sum of all pieces of a mix, which begin at sample ``at`` of its clock, in cells of ``cell`` samples, clipped once at the end."""
    kind = dict(df.dtypes)[mix]
    n = F.floor(F.octet_length("_pcm") / 2)
    d = df.select(mix, at.cast("long").alias("_at"), F.col(pcm).alias("_pcm")).where(F.octet_length("_pcm") > 1)
    d = d.withColumn("cell", F.explode(F.sequence(F.floor(F.col("_at") / cell), F.floor((F.col("_at") + n - 1) / cell))))
    first = F.greatest(F.col("cell") * cell, F.col("_at"))
    last = F.least((F.col("cell") + 1) * cell, F.col("_at") + n)
    piece = F.substr("_pcm", (2 * (first - F.col("_at")) + 1).cast("int"), (2 * (last - first)).cast("int"))
    d = d.select(mix, "cell", (first - F.col("cell") * cell).cast("int").alias("offset"), piece.alias("piece"))

    def lay(t: pa.Table) -> pa.Table:
        total = np.zeros(cell, np.int64)
        for offset, x in zip(t["offset"].to_pylist(), t["piece"].to_pylist()):
            s = np.frombuffer(x, "<i2")
            total[offset : offset + len(s)] += s
        out = np.clip(total, -32768, 32767).astype("<i2").tobytes()
        return pa.table({mix: t[mix].slice(0, 1), "cell": t["cell"].slice(0, 1), "pcm": pa.array([out], pa.binary())})

    return d.groupBy(mix, "cell").applyInArrow(lay, f"{mix} {kind}, cell long, pcm binary")


def band_taps(rate: int, low: float | None = None, high: float | None = None, taps: int = 101) -> list[float]:
    """A windowed-sinc filter that keeps a band of frequencies."""
    k = np.arange(taps) - (taps - 1) / 2
    ideal = lambda f: 2 * f / rate * np.sinc(2 * f / rate * k)
    h = (ideal(high) if high is not None else np.where(k == 0, 1.0, 0.0)) - (ideal(low) if low is not None else 0.0)
    return (h * np.hamming(taps)).tolist()
