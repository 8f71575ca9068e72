"""One Spark session with the settings that the operators are written for."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, app: str = "tracemill", **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder; without one, a local session gets a folder of its own and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if not told and not sc.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="tracemill-ck-"))
    return sc.getCheckpointDir()


_PARENTS: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; a gateway that is gone already leaves it."""
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception as e:
        warnings.warn(f"left behind: {path} ({e})", stacklevel=2)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder. Those of a session have one parent, which goes when the driver's process ends."""
    parent = f"{shared_folder(spark)}/scratch"
    if parent not in _PARENTS:
        _PARENTS.add(parent)
        atexit.register(remove, spark, parent)
    return f"{parent}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go as soon as its query ends, and not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
