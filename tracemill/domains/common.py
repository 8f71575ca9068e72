"""Helpers of the domain operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rules(*checks: tuple[Column, str]) -> Column:
    """The name of the first condition that holds, else ``ok``; a null condition holds."""
    out = None
    for broken, name in checks:
        broken = F.coalesce(broken, F.lit(True))
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return out.otherwise("ok") if out is not None else F.lit("ok")


def apply_changes(base: DataFrame, changes: DataFrame, key: Sequence[str] | str, cond: Column | None = None) -> DataFrame:
    """``base`` with columns named ``new_...`` of ``changes`` in place of its own, in rows whose change is ``ok``."""
    keys = [key] if isinstance(key, str) else list(key)
    new = [c for c in changes.columns if c.startswith("new_")]
    ok = changes.where((F.col("rule") == "ok") if cond is None else cond).select(*keys, *new, F.lit(True).alias("hit_"))
    d = base.join(ok, keys, "left")
    return d.select(*[F.when(F.col("hit_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if f"new_{c}" in new else F.col(c) for c in base.columns])


def move_balances(methods: DataFrame, moves: DataFrame, keys: Sequence[str], kind: str = "gift_card") -> DataFrame:
    """Balances of gift cards with the sums of ``amount`` taken off, to cents."""
    m = moves.groupBy(*keys).agg(F.sum("amount").alias("moved_"))
    d = methods.join(m, list(keys), "left")
    gift = (F.col("source") == kind) & F.col("moved_").isNotNull()
    return d.select(*[F.when(gift, F.round(F.col("balance") - F.col("moved_"), 2)).otherwise(F.col("balance")).alias("balance") if c == "balance" else F.col(c) for c in methods.columns])
