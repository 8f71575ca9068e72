"""Feeds of reports: run tables with clusters, cluster tables, viewer rows, schedules of effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs_with_clusters(features: DataFrame, assigned: DataFrame, run: str = "run_id") -> DataFrame:
    """Runs with their cluster: ``pass`` for passing ones, empty for failures without one."""
    d = features.join(assigned.select(run, "cluster_id"), run, "left")
    return d.withColumn("cluster_id", F.when(F.col("failure_type") == "pass", "pass").otherwise(F.coalesce("cluster_id", F.lit(""))))


def cluster_table(clusters: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Clusters with their label, or their own name without one."""
    d = clusters.join(labels.select(key, F.col("label")), key, "left")
    return d.withColumn("label", F.coalesce("label", "name"))


def viewer_rows(messages: DataFrame, features: DataFrame, run: str = "run_id") -> DataFrame:
    """Trace nodes of runs that have features: messages at depth 0, calls at 1, results at 2, in order."""
    m = messages.join(features.select(run, "failure_type"), run)
    body = m.where("role <> 'tool'").select(run, "failure_type", "pos", F.lit(0).alias("k"), F.lit(0).alias("depth"), F.col("role").alias("kind"), F.col("content").alias("text"))
    calls = m.where(F.size("calls") > 0).select(run, "failure_type", "pos", F.posexplode("calls").alias("k", "c")).select(run, "failure_type", "pos", (F.col("k") + 1).alias("k"), F.lit(1).alias("depth"), F.lit("call").alias("kind"), F.col("c.name").alias("text"))
    got = m.where("role = 'tool'").select(run, "failure_type", "pos", F.lit(0).alias("k"), F.lit(2).alias("depth"), F.lit("result").alias("kind"), F.col("content").alias("text"))
    d = body.unionByName(calls).unionByName(got)
    return d.withColumn("node", F.row_number().over(W.partitionBy(run).orderBy("pos", "k", "depth")) - 1)


def outlier_report(calls: DataFrame, limit: float = 20.0) -> DataFrame:
    """Silences above the limit: missed speech, no user, or other."""
    kind = F.when(F.col("silence") <= limit, None).when(F.col("user_audio") & ~F.col("detected"), "VAD-MISS").when(~F.col("user_audio"), "NO-USER").otherwise("OTHER")
    return calls.withColumn("flag", kind)


def label_track(segments: DataFrame, tick_seconds: float) -> DataFrame:
    """Segments as rows of a label file: start and end in seconds, and the label."""
    return segments.select("conv_id", F.format_string("%.6f", F.col("start") * F.lit(tick_seconds)).alias("start_s"), F.format_string("%.6f", (F.col("end") + 1) * F.lit(tick_seconds)).alias("end_s"), F.col("text").alias("label"))


def tick_audio(ticks: DataFrame, bytes_per_tick: int) -> DataFrame:
    """Per tick: the share of the tick that its audio fills, and whether audio is short, whole or too long."""
    share = F.col("bytes") / bytes_per_tick
    state = F.when(F.col("bytes") == 0, "silent").when(share < 1, "short").when(share == 1, "whole").otherwise("long")
    return ticks.withColumn("fill", F.round(share, 4)).withColumn("state", state)


def schedule_effects(chunks: DataFrame, burst_rate: float, speech_rate: float, draw: Column, draw2: Column, lost: Column) -> DataFrame:
    """Effects that a chunk triggers: Poisson bursts while none is active, Poisson speech in silence, losses of the two-state model.

    Chunks: seconds, is_silence, burst_active. Rates are events a second.
    """
    burst = ~F.col("burst_active") & (draw < 1 - F.exp(-F.lit(burst_rate) * F.col("seconds")))
    speech = F.col("is_silence") & (draw2 < 1 - F.exp(-F.lit(speech_rate) * F.col("seconds")))
    return chunks.withColumn("effects", F.array_compact(F.array(F.when(burst, "burst_noise"), F.when(speech, "out_of_turn_speech"), F.when(lost, "frame_drop"))))
