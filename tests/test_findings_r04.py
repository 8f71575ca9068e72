"""Findings of round 4, each by a case that failed before."""

import glob
import os
import random
import time

import duckdb
from pyspark.sql import functions as F

from tracemill.domains import airline
from tracemill.plans import registry, report_queries, text_queries  # noqa: F401


def test_means_add_up_as_in_sql(spark, tmp_path):
    """Sums in the order of keys and halves of the last digit, both to the last bit."""
    rng, rows = random.Random(3), []
    for model in range(300):
        # Halves of the seventh digit: an odd number of cents over 32 values.
        rows += [(3 * len(rows) + 1 + k % 2, model, "F", rng.randrange(1, 10**9) / 100) for k in range(32)]
    for model in range(300, 700):
        # The same values in other orders.
        values = [0.1, 0.2, 0.3, 0.7, 1.1]
        rng.shuffle(values)
        rows += [(3 * (len(rows) + k) + 1, model, "O", v) for k, v in enumerate(values)]
    rows.sort()
    path = f"{tmp_path}/orders.parquet"
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute("set threads=1")
    con.execute(f"create view orders as select * from '{path}/*.parquet'")
    want = con.execute(registry.ORACLES["frame_by_domain"]).fetchall()
    d = registry.QUERIES["frame_by_domain"](spark, str(tmp_path))
    got = d.select("domain", "model", "pass_1", "place").collect()
    assert len(got) == 700 and sorted(map(tuple, got)) == sorted(want)


def test_tfidf_keeps_no_shuffles(spark, data):
    """Texts and terms that were dealt out leave the disk before pairs are made."""
    place = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f: os.path.getsize(f) for d in place.localDirsString() for f in glob.glob(f"{d}/*/shuffle_*.data")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, told = files(), spark.conf.get(key)
    d = text_queries.tfidf_cosine(registry.Tables(spark, data))
    assert spark.conf.get(key) == told
    size, end = os.path.getsize(f"{data}/documents.parquet"), time.time() + 30
    while (left := sum(n for f, n in files().items() if f not in before)) > size / 4 and time.time() < end:
        time.sleep(0.5)
    assert left <= size / 4
    assert d.count() and not glob.glob(f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/scratch/tfidf-*-counts")


def test_stops_copy_no_legs(spark, monkeypatch):
    """No row is copied for slices of a stop; packs of a few legs, keys repeated, texts that are missing."""
    for name, size in (("FIRSTS", 3), ("SECONDS", 5)):
        monkeypatch.setattr(airline, name, size)
    day = lambda s: {"status": s, "seats": {"e": 1}, "prices": {"e": 1.0}}
    rows = [(f"f{k % 90}", "A" if k % 2 else f"S{k % 4}", f"S{k % 3}" if k % 2 else "C", f"{k % 24:02d}:00:00" if k % 11 else None, f"{(k + 3) % 24:02d}:00:00" + "+1" * (k % 5 == 0) if k % 13 else None, {"2024-05-09": day("available" if k % 7 else "landed"), "2024-05-10": day("available")}) for k in range(200)]
    schema = "flight_number string, origin string, destination string, departure string, arrival string, dates map<string, struct<status: string, seats: map<string, int>, prices: map<string, double>>>"
    d = airline.one_stop_flights(spark.createDataFrame(rows, schema), "A", "C", "2024-05-09")
    want = []
    for a in rows:
        for b in rows:
            if a[1] == "A" and a[5]["2024-05-09"]["status"] == "available" and b[2] == "C" and a[2] == b[1] and a[4] and b[3] and b[3] >= a[4]:
                date = "2024-05-10" if "+1" in a[4] else "2024-05-09"
                want += [(a[0], b[0], a[2], date)] * (b[5][date]["status"] == "available")
    assert sorted(map(tuple, d.collect())) == sorted(want) and len(want) > 500
    # What is dealt out: each first leg once, each second leg at most once for a day.
    made = d.select(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in made or "BroadcastNestedLoopJoin" in made
    assert "sequence" not in made and "SortMergeJoin" not in made
