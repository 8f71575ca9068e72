"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tracemill

# Functions of this package travel to the executors by value, so that the
# package need not be installed there.
cloudpickle.register_pickle_by_value(tracemill)

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows a batch handed to Python. Texts may be long, so batches stay short.
BATCH_ROWS = 256


def shared_dir(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder: the cluster's own, or a local one where none is set."""
    if spark.sparkContext.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
        spark.sparkContext.setCheckpointDir(told or tempfile.mkdtemp(prefix="tracemill-ck-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def hashable(df: DataFrame) -> list[Column]:
    """The columns of ``df`` in forms that xxhash64 accepts: maps as sorted entries, variants (and what holds them deeper) as JSON."""

    def plain(t: T.DataType) -> bool:
        if isinstance(t, T.ArrayType):
            return plain(t.elementType)
        if isinstance(t, T.StructType):
            return all(plain(f.dataType) for f in t.fields)
        return not isinstance(t, (T.MapType, T.VariantType))

    def form(f: T.StructField) -> Column:
        c, t = F.col(f"`{f.name}`"), f.dataType
        if plain(t):
            return c
        if isinstance(t, T.MapType) and plain(t.keyType) and plain(t.valueType):
            return F.array_sort(F.map_entries(c))
        return F.to_json(F.struct(c))

    return [form(f) for f in df.schema.fields]


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of a whole row; rows that differ in it are told apart, equal rows are interchangeable."""
    return F.xxhash64(*hashable(df)) if df.columns else F.lit(0).cast("long")


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """``df`` as one struct column ``row`` and working columns beside it, which so can't clash with its names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def unpacked(df: DataFrame, columns: list[str], **more: Column) -> DataFrame:
    """The columns of ``row`` again, and ``more``; a name in ``more`` wins over a column of that name."""
    taken = {k.lower() for k in more}
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken], *[c.alias(k) for k, c in more.items()])


def map_batches(df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """``mapInArrow`` in short batches; ``start`` runs once a task and gives the function for a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_ROWS):
                out = step(batch.slice(k, BATCH_ROWS))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def add_columns(
    df: DataFrame,
    keep: dict[str, Column],
    work: list[Column],
    new: list[T.StructField],
    start: Callable[[], Callable[..., list[pa.Array]]],
) -> DataFrame:
    """Columns ``keep``, then ``new``, made in Python from ``work`` alone.

    ``start`` runs once a task; its function takes the arrays of ``work`` and
    gives those of ``new``. Working columns have no names that could clash; a kept
    column with the name of a new one is left out.
    """
    taken = {f.name.lower() for f in new}
    keep = {k: c for k, c in keep.items() if k.lower() not in taken}
    d = df.select(*[c.alias(f"keep{n}") for n, c in enumerate(keep.values())], *[c.alias(f"work{n}") for n, c in enumerate(work)])
    fields = [T.StructField(k, f.dataType, f.nullable) for k, f in zip(keep, d.schema.fields)]
    names = [*keep, *[f.name for f in new]]
    kept = len(keep)

    def begin() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        step = start()
        return lambda batch: pa.RecordBatch.from_arrays([*batch.columns[:kept], *step(*batch.columns[kept:])], names=names)

    return map_batches(d, T.StructType([*fields, *new]), begin)


#: Tasks that the rows of one group are spread over at most.
SALTS = 32


def beside(df: DataFrame, key: str, by: Column, **aggregates: tuple[Callable[[Column], Column], Column]) -> DataFrame:
    """``df`` with aggregates of each ``key``'s rows beside every row, a key of any size spread over up to ``SALTS`` tasks.

    ``by`` deals the rows of a key out; an aggregate is a function that may be applied to its own results (min, max, sum), and a column.
    Sums of a salt come first, then those of a key, which go back to the salts that have rows of it.
    """
    d = df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    part = d.groupBy(key, "_salt").agg(*[f(c).alias(k) for k, (f, c) in aggregates.items()])
    whole = part.groupBy(key).agg(*[f(F.col(k)).alias(k) for k, (f, _) in aggregates.items()], F.collect_set("_salt").alias("_salts"))
    back = whole.select(key, *aggregates, F.explode("_salts").alias("_salt"))
    return d.join(back, [key, "_salt"]).drop("_salt")


def shape(df: DataFrame, *columns: str) -> None:
    """Raise a plain error for a missing column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
