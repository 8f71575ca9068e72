"""Canonical JSON: keys sorted, ``", "`` and ``": "`` between, everything beyond ASCII escaped, what JSON lacks as text.

The text equals that of Python's encoder with sorted keys and ``str`` for other
objects, to the byte, so hashes made elsewhere can be compared. Shortest texts
of floats have no counterpart among the built-in functions, so values travel in
Arrow batches.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _keyed(kind: pa.DataType) -> bool:
    """Whether a type holds maps, which Arrow gives as lists of pairs."""
    return pa.types.is_map(kind) or any(_keyed(kind.field(k).type) for k in range(kind.num_fields))


def _plain(v, kind: pa.DataType):
    if v is None or not _keyed(kind):
        return v
    if pa.types.is_map(kind):
        return {k: _plain(x, kind.item_type) for k, x in v}
    if pa.types.is_struct(kind):
        return {kind.field(k).name: _plain(v[kind.field(k).name], kind.field(k).type) for k in range(kind.num_fields)}
    return [_plain(x, kind.value_type) for x in v]


def encode(v) -> str:
    return json.dumps(v, sort_keys=True, default=str)


@F.arrow_udf(T.StringType())
def canonical_json(c: pa.Array) -> pa.Array:
    """A nested value as canonical JSON; null stays null."""
    return pa.array([None if v is None else encode(_plain(v, c.type)) for v in c.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def canonical_text(c: pa.Array) -> pa.Array:
    """A JSON text as canonical JSON; null stays null, what is no JSON raises."""
    return pa.array([None if v is None else encode(json.loads(v)) for v in c.to_pylist()], pa.string())


def canonical_hash(c: Column) -> Column:
    """SHA-256 of the canonical JSON of a nested value."""
    return F.sha2(canonical_json(c), 256)
