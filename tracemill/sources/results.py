"""Run results: two layouts, integrity, run tables, checkpoints, resuming, trimming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.dml import insert_absent, upsert
from tracemill.operators.joins import missing_and_extra
from tracemill.operators.metrics import INFRA
from tracemill.sources import run_files

KEY = ("trial", "task_id", "seed")


def detect_format(spark: SparkSession, path: str) -> str:
    """``json`` for one file, ``dir`` for a folder of one file a run."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return "dir" if fs.getFileStatus(p).isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "simulations")) else "json"


def load_runs(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Runs of either layout, with the given schema; the folder layout is checked against its index."""
    if detect_format(spark, path) == "json":
        outer = T.StructType([T.StructField("simulations", T.ArrayType(schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)))])
        return spark.read.schema(outer).option("multiLine", True).json(path).select(F.inline("simulations"))
    packed = run_files.packed(path)
    if packed:
        index, held = _indexed(spark, path), _held(spark, path)
        again = [d.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("repeated").alias("side")) for d in (index, held)]
        bad = [tuple(r) for r in missing_and_extra(index, held, "id").unionByName(again[0]).unionByName(again[1]).limit(10).collect()]
    else:
        bad = run_files.integrity(path)
    if bad:
        raise ValueError("index and files differ: " + ", ".join(f"{i} ({what})" for i, what in bad[:10]))
    if packed:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/simulations")
    run_files.register(spark)
    return spark.read.format("run_files").schema(schema).load(path)


def _indexed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string").json(f"{path}/index")


def _held(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the runs in files: names of files with one run each, and what packs hold."""
    folder = f"{path}/simulations"
    one = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select(F.url_decode(F.regexp_extract("path", r"([^/]+)\.json$", 1)).alias("id"))
    return one.unionByName(spark.read.schema("id string").option("pathGlobFilter", f"*{run_files.PACK}").json(folder))


def integrity_report(spark: SparkSession, path: str) -> DataFrame:
    """``id, side`` of each difference between the index and the files of the folder layout: missing files, extra files."""
    return missing_and_extra(_indexed(spark, path), _held(spark, path), "id")


def check_integrity(index: DataFrame, stems: DataFrame, key: str = "id") -> None:
    """Raise if the index names a run without a file or a file has no index entry."""
    bad = missing_and_extra(index, stems, key).orderBy("side", key).limit(10).collect()
    if bad:
        raise ValueError("index and files differ: " + ", ".join(f"{r[key]} ({r.side})" for r in bad))


def load_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Everything but the runs: the read schema leaves them out."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def run_table(runs: DataFrame, tasks: DataFrame, strict: bool = True, key: str = "task_id") -> DataFrame:
    """Runs with their task's counts of actions; a strict table raises where a task is missing."""
    count = lambda who: F.size(F.filter("actions", lambda a: a["requestor"] == who))
    t = tasks.select(key, F.lit(True).alias("known"), count("assistant").alias("task_num_agent_actions"), count("user").alias("task_num_user_actions"), F.size("actions").alias("task_num_actions"))
    d = runs.join(t, key, "left")
    if strict:
        d = d.withColumn(key, F.when(F.col("known"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("no task "), F.col(key).cast("string"))).cast(dict(runs.dtypes)[key])))
    return d.drop("known")


def save_runs(runs: DataFrame, path: str, overwrite: bool = False, runs_a_file: int = 1) -> None:
    """One file a run and a narrow index, as :func:`load_runs` reads them; ids that repeat are refused.

    A file takes a block of the disk and a name in the driver, which millions of
    runs do not bear: with ``runs_a_file`` above 1, packs hold up to so many runs,
    a line each, and the index is made of the packs as they were written.
    """
    spark = runs.sparkSession
    again = runs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(10).collect()
    if again:
        raise ValueError("ids repeat: " + ", ".join(str(r.id) for r in again))
    if runs_a_file == 1:
        run_files.register(spark)
        runs.write.format("run_files").mode("overwrite" if overwrite else "append").option("path", path).save()
        return
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not overwrite and place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise FileExistsError(f"PATH_ALREADY_EXISTS: {path}")
    i = F.col("id").cast("string")
    wrong = F.coalesce(F.length(i) == 0, F.lit(True)) | F.contains(i, F.lit("/"))
    named = F.when(wrong, F.raise_error(F.concat(F.lit("not an id that a file can have: "), F.coalesce(i, F.lit("null"))))).otherwise(F.col("id"))
    write = lambda d, folder: d.write.mode("overwrite").option("maxRecordsPerFile", runs_a_file).option("compression", "gzip").json(f"{path}/{folder}")
    write(runs.withColumn("id", named), "simulations")
    entry = T.StructType([f for f in runs.schema.fields if f.name in run_files.INDEX])
    write(spark.read.schema(entry).json(f"{path}/simulations"), "index")


def append_checkpoint(done: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return insert_absent(done, new, key)


def replace_checkpoint(done: DataFrame, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return upsert(done, new, key)


def resume(runs: DataFrame, old_tasks: DataFrame, new_tasks: DataFrame, trials: int, key: str = "task_id") -> dict[str, DataFrame]:
    """What a resumed batch keeps and has to do.

    ``kept``: runs without infrastructure errors; ``conflicts``: tasks that were
    removed or whose content hash changed; ``todo``: (task, trial) without a run.
    """
    kept = runs.where(~F.col("termination_reason").eqNullSafe(INFRA))
    o, n = old_tasks.select(key, F.col("hash").alias("old")), new_tasks.select(key, F.col("hash").alias("new"))
    d = o.join(n, key, "left")
    conflicts = d.where(F.col("new").isNull() | (F.col("new") != F.col("old"))).select(key, F.when(F.col("new").isNull(), "removed").otherwise("modified").alias("conflict"))
    todo = trial_grid(new_tasks, trials, key).join(kept.select(key, "trial"), [key, "trial"], "left_anti")
    return {"kept": kept, "conflicts": conflicts, "todo": todo}


def trial_grid(tasks: DataFrame, trials: int, key: str = "task_id") -> DataFrame:
    """Each task once a trial."""
    return tasks.select(key, F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))


def trim_messages(messages: DataFrame, by: str, order: str, content: str, budget: int, short: int = 200, drop: Sequence[str] = ()) -> DataFrame:
    """Cut the longest messages of each run to ``short`` characters until the run fits its budget.

    Messages are ranked by length; the first ranks are cut as far as the excess
    over the budget reaches, by a running sum of what cutting saves.
    """
    d = messages.drop(*drop).withColumn("size", F.octet_length(content))
    total = F.sum("size").over(W.partitionBy(by))
    saves = F.greatest(F.col("size") - short, F.lit(0))
    before = F.sum("saves").over(W.partitionBy(by).orderBy(F.desc("size"), order).rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("excess", total - budget).withColumn("saves", saves).withColumn("saved", F.coalesce(before, F.lit(0)))
    cut: Column = (F.col("excess") > F.col("saved")) & (F.col("saves") > 0)
    return d.withColumn("trimmed", cut).withColumn(content, F.when(cut, F.substring(content, 1, short)).otherwise(F.col(content))).drop("size", "excess", "saves", "saved")


def write_artifact(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def grid_parameters(df: DataFrame, path: Column) -> DataFrame:
    """Domain, model and mode out of a file name ``domain_model_mode.json``."""
    part = lambda k: F.regexp_extract(path, r"([^/_]+)_([^/]+)_([^/_]+)\.json$", k)
    return df.select("*", part(1).alias("domain"), part(2).alias("model"), part(3).alias("mode"))
