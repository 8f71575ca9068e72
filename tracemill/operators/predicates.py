"""Constraint queries: ``{"field__op": value}`` dictionaries compiled to one Column.

A constraint is split on its last double underscore. An unknown operator reads
as equality on what stands before it. A missing field reads as null. The
comparisons follow a language in which null equals null only: see ``compare``.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "startswith", "endswith", "in", "nin")
_NUMBERS = (T.NumericType, T.BooleanType)


def split_constraint(key: str) -> tuple[str, str]:
    if "__" not in key:
        return key, "eq"
    name, op = key.rsplit("__", 1)
    return name, op if op in OPERATORS else "eq"


def _comparable(kind: T.DataType, value: Any) -> bool:
    """Whether a literal can equal or be ordered against a column of this type; no implicit casts between texts and numbers."""
    if isinstance(value, (bool, int, float)):
        return isinstance(kind, _NUMBERS)
    if isinstance(value, str):
        return isinstance(kind, T.StringType)
    return not isinstance(kind, (*_NUMBERS, T.StringType))


def _equals(c: Column, kind: T.DataType, value: Any) -> Column:
    if value is None:
        return c.isNull()
    if not _comparable(kind, value):
        return F.lit(False)
    if isinstance(value, bool) and not isinstance(kind, T.BooleanType):
        value = int(value)
    if isinstance(kind, T.BooleanType) and not isinstance(value, bool):
        c = c.cast("double")
    return c.eqNullSafe(F.lit(value))


def _text(c: Column, kind: T.DataType) -> Column:
    return F.initcap(c.cast("string")) if isinstance(kind, T.BooleanType) else c.cast("string")


def compare(c: Column, kind: T.DataType, op: str, value: Any) -> Column:
    """One comparison as a Boolean that is never null.

    Orderings are false for null and across types; ``ne`` and ``nin`` are true
    there; prefixes and suffixes compare the written forms; ``contains`` looks
    into texts, arrays and map keys and is false for anything else.
    """
    if op == "eq":
        return _equals(c, kind, value)
    if op == "ne":
        return ~_equals(c, kind, value)
    if op in ("gt", "gte", "lt", "lte"):
        if value is None or not _comparable(kind, value):
            return F.lit(False)
        if isinstance(kind, T.BooleanType):
            c = c.cast("int")
        v = F.lit(int(value) if isinstance(value, bool) else value)
        return F.coalesce({"gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op], F.lit(False))
    if op == "contains":
        if isinstance(kind, T.StringType) and isinstance(value, str):
            return F.coalesce(F.contains(c, F.lit(value)), F.lit(False))
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.exists(c, lambda x: _equals(x, kind.elementType, value)), F.lit(False))
        if isinstance(kind, T.MapType):
            return F.coalesce(F.exists(F.map_keys(c), lambda x: _equals(x, kind.keyType, value)), F.lit(False))
        return F.lit(False)
    if op in ("startswith", "endswith"):
        f = F.startswith if op == "startswith" else F.endswith
        return F.coalesce(f(_text(c, kind), F.lit(str(value))), F.lit(False))
    if op in ("in", "nin"):
        if isinstance(value, str):  # membership in a text is a substring test
            hit = F.coalesce(F.contains(F.lit(value), c), F.lit(False)) if isinstance(kind, T.StringType) else F.lit(False)
            return hit if op == "in" else ~hit if isinstance(kind, T.StringType) else F.lit(False)
        hit = reduce(lambda a, b: a | b, [_equals(c, kind, v) for v in value], F.lit(False))
        return hit if op == "in" else ~hit
    raise ValueError(op)


def compile_constraints(schema: T.StructType, constraints: Mapping[str, Any]) -> Column:
    """All constraints joined by AND, as one predicate that reaches the scan."""
    kinds = {f.name: f.dataType for f in schema.fields}
    out = F.lit(True)
    for key, value in constraints.items():
        name, op = split_constraint(key)
        c, kind = (F.col(f"`{name}`"), kinds[name]) if name in kinds else (F.lit(None).cast("string"), T.NullType())
        if name not in kinds and op in ("eq", "ne"):
            term = F.lit((value is None) == (op == "eq"))
        elif name not in kinds and op in ("in", "nin"):
            term = F.lit((not isinstance(value, str) and None in value) == (op == "in"))
        elif name not in kinds:
            term = F.lit(False)
        else:
            term = compare(c, kind, op, value)
        out = out & term
    return out


class Catalog:
    """Named tables and constraint queries over them."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = dict(tables)

    def names(self) -> list[str]:
        return sorted(self.tables)

    def fetch(self, name: str) -> DataFrame | None:
        return self.tables.get(name)

    def query(self, name: str, constraints: Mapping[str, Any], *, order: Sequence[str] = (), limit: int | None = None) -> DataFrame | None:
        """Matching rows; an unknown table gives None. A limit takes the first rows by ``order``."""
        df = self.tables.get(name)
        if df is None:
            return None
        df = df.where(compile_constraints(df.schema, constraints))
        if limit is not None:
            df = (df.orderBy(*order) if order else df).limit(limit)
        return df

    def query_json(self, name: str, text: str, **how) -> DataFrame | None:
        """The same from a JSON object; an empty text means no constraint."""
        parsed = json.loads(text) if text.strip() else {}
        if not isinstance(parsed, dict):
            raise ValueError("constraints must be a JSON object")
        return self.query(name, parsed, **how)


def point_lookup(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def routed_lookup(tables: Mapping[str, tuple[DataFrame, str]], record_id: str) -> DataFrame:
    """Pick the table by the id's first letter; an unknown letter raises."""
    found = tables.get(record_id[:1])
    if found is None:
        raise ValueError(f"unknown id format: {record_id}")
    return point_lookup(found[0], found[1], record_id)


def first_match(df: DataFrame, order: str, **fields: str) -> DataFrame:
    """The first row by ``order`` whose fields equal the given texts, whatever their case."""
    cond = reduce(lambda a, b: a & b, [F.lower(F.col(k)) == F.lower(F.lit(v)) for k, v in fields.items()])
    return df.where(cond).orderBy(order).limit(1)


def all_matches(df: DataFrame, **fields: str) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, [F.lower(F.col(k)) == F.lower(F.lit(v)) for k, v in fields.items()]))


def optional_filter(df: DataFrame, **fields: Any) -> DataFrame:
    """Equality on the fields that are given; ``name__gte`` and the other operators work too; None means no predicate."""
    return df.where(compile_constraints(df.schema, {k: v for k, v in fields.items() if v is not None}))


def nested_items(df: DataFrame, map_col: str, *keep: str) -> DataFrame:
    """Rows of the values of a map column, with columns of the parent."""
    return df.select(*keep, F.explode(F.col(map_col)).alias("item_id", "item"))


def allowed(c: Column, patterns: Sequence[str], denied: Sequence[str] = ()) -> Column:
    """Whether a path matches a glob of the first list and none of the second."""
    hit = lambda ps: reduce(lambda a, b: a | b, [c.rlike("(?s)^" + fnmatch.translate(p).replace("(?s:", "(?:").replace("\\Z", "$").replace("\\z", "$")) for p in ps], F.lit(False))
    return hit(patterns) & ~hit(denied)


def select_tasks(tasks: DataFrame, *, split: DataFrame | None = None, ids: Sequence[str] | None = None, first: int | None = None, key: str = "task_id", order: str = "pos") -> DataFrame:
    """Tasks of a split, with given ids, the first N by order."""
    if split is not None:
        tasks = tasks.join(split.select(key).distinct(), key, "left_semi")
    if ids is not None:
        tasks = tasks.where(F.col(key).isin(list(ids)))
    return tasks.orderBy(order).limit(first) if first is not None else tasks
