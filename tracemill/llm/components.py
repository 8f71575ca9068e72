"""Connected components of an edge table by alternating large-star and small-star steps.

Works on edges only; nothing is gathered on the driver but a count and a
checksum a round. The edges of a hub are spread over several tasks. Each round is cut by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import beside, cut

#: Rounds grow with the logarithm of the longest chain; this many would do for any graph that fits a cluster.
MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of ``edges`` but the roots: root is the smallest node of its component.

    Loops, repeated and null edges are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u <> v").distinct()
    e = cut(e)
    state = _state(e)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        # Large star: larger neighbours move to the smallest one.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = beside(both, "u", F.col("v"), m=(F.min, F.col("v"))).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Small star: smaller neighbours and the node itself move to the smallest one.
        near = beside(big, "u", F.col("v"), m=(F.min, F.col("v")))
        small = near.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.distinct())
        before, state = state, _state(e)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
