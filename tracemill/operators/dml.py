"""Insert, update, delete and ledgers as new DataFrames from old ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def insert_absent(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` and the rows of ``new`` whose key it lacks; of rows that repeat a key in ``new`` one is taken."""
    return base.unionByName(new.dropDuplicates(list(keys)).join(base.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def upsert(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``new`` in place of those with the same key."""
    return base.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def update_by_key(base: DataFrame, key: str, value, fields: Mapping[str, object]) -> DataFrame:
    """Set fields of the row with the key; fields that are new become columns, null elsewhere."""
    hit = F.col(key).eqNullSafe(F.lit(value))
    old = lambda c: F.col(c) if c in base.columns else F.lit(None)
    return base.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(old(c)) for c, v in fields.items()})


def update_from(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-null values of ``changes`` (one row a key) replace those of ``base``."""
    named = changes.select(*keys, *[F.col(c).alias(f"new_{c}") for c in changes.columns if c not in keys])
    d = base.join(named, list(keys), "left")
    return d.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in changes.columns and c not in keys else F.col(c) for c in base.columns])


def delete_where(base: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, what was deleted); a null condition deletes nothing."""
    cond = F.coalesce(cond, F.lit(False))
    return base.where(~cond), base.where(cond)


def append_ledger(ledger: DataFrame, entries: DataFrame, order: str) -> DataFrame:
    return ledger.unionByName(entries, allowMissingColumns=True).orderBy(order)


def latest(ledger: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last entry of each key."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return ledger.withColumn("r", r).where("r = 1").drop("r")


def merge_maps(old: Column, new: Column) -> Column:
    """Keys of both, the new value where both have one."""
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a))
