"""Findings of round 3, each by a case that failed before."""

import gzip
import json
import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill import session
from tracemill.domains import airline
from tracemill.functions.values import money_text
from tracemill.operators import tfidf
from tracemill.plans import registry, report_queries, source_queries, text_queries
from tracemill.sources import files, results, run_files


def test_money_rounds_the_double(spark):
    values = [-0.0, 1.005, 0.125, -0.125, 1e23, None, -3.5, float("nan"), float("inf"), -0.001]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(money_text(F.col("v")).alias("t")).collect()]
    assert got[:7] == ["$0.00", "$1.00", "$0.12", "$-0.12", "$99999999999999991611392.00", None, "$-3.50"]
    con = duckdb.connect()
    assert got == [con.execute("select case when v < 0 then '$-' else '$' end || printf('%.2f', abs(v)) from (select ?::double as v)", [v]).fetchone()[0] for v in values]


def test_equal_means_tie(spark, tmp_path):
    prices = [0.1, 0.2, 0.3, 1e9, 7.7]
    rows = [(3 * k + 1, 2 if k < 5 else 1, "F", p) for k, p in enumerate(prices + prices[::-1])] + [(31, 5, "F", 1e12), (34, 3, None, 5.0), (37, None, "F", 1e12), (40, 4, "F", float("nan"))]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.domain, r.model): r.place for r in report_queries.frame_by_domain(registry.Tables(spark, str(tmp_path))).collect()}
    assert got == {("F", 4): 1, ("F", 5): 2, ("F", None): 3, ("F", 1): 4, ("F", 2): 5, (None, 3): 6}


def test_runs_in_packs(spark, tmp_path):
    rows = [(f"r {k} é", "t", k, [(f"a \nb {k}",), (None,)], {"k": float("nan")}) for k in range(2500)]
    d = spark.createDataFrame(rows, "id string, task_id string, trial int, messages array<struct<text: string>>, m map<string, double>").repartition(3)
    p = str(tmp_path / "runs")
    packs = lambda: sorted(n for n in os.listdir(f"{p}/simulations") if n.endswith(".json.gz"))
    results.save_runs(d, p, runs_a_file=100)
    assert 25 <= len(packs()) <= 28
    assert sorted(map(str, results.load_runs(spark, p, d.schema).collect())) == sorted(map(str, d.collect()))
    assert not results.integrity_report(spark, p).count()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        results.save_runs(d, p, runs_a_file=100)
    run_files.register(spark)
    with pytest.raises(Exception, match="load_runs"):
        spark.read.format("run_files").schema(d.schema).load(p).count()
    # A line of a pack goes, another comes.
    name = f"{p}/simulations/{packs()[0]}"
    with gzip.open(name, "rt", newline="\n") as f:
        lines = f.read().split("\n")
    os.remove(f"{p}/simulations/.{packs()[0]}.crc")
    with gzip.open(name, "wt", newline="\n") as f:
        f.write("\n".join(['{"id": "new"}', *lines[1:]]))
    assert {tuple(r) for r in results.integrity_report(spark, p).collect()} == {(json.loads(lines[0])["id"], "missing"), ("new", "extra")}
    with pytest.raises(ValueError, match="index and files differ"):
        results.load_runs(spark, p, d.schema)
    results.save_runs(d.limit(3), p, overwrite=True, runs_a_file=2)
    assert results.load_runs(spark, p, d.schema).count() == 3
    spark.read.json(f"{p}/index").write.mode("append").json(f"{p}/index")
    with pytest.raises(ValueError, match="repeated"):
        results.load_runs(spark, p, d.schema)
    results.save_runs(d.where("false"), f"{p}0", runs_a_file=2)
    assert results.load_runs(spark, f"{p}0", d.schema).count() == 0
    with pytest.raises(Exception, match="not an id"):
        results.save_runs(spark.createDataFrame([("a/b", "t")], "id string, task_id string"), f"{p}1", runs_a_file=2)


@pytest.mark.parametrize("name", ["results_sink", "results_integrity", "results_nested"])
def test_results_take_few_files(spark, data, name, monkeypatch):
    """As many files as runs would not fit a disk."""
    seen = []
    monkeypatch.setattr(source_queries, "scratch", lambda s, n: seen.append(session.scratch(s, n)) or seen[-1])
    assert registry.QUERIES[name](spark, data).count()
    assert len([n for n in os.listdir(f"{seen[0].removeprefix('file:')}/simulations") if n.startswith("part")]) <= 8


def test_documents_share_files(spark, tmp_path):
    texts = ["a\n---\nb", "\n---\n", "---", files.BETWEEN[".toml"], "x\n# --- next document ---\n", "é\r\n", "", "...", "\n"]
    d = spark.createDataFrame([(k, t, (t, None)) for k, t in enumerate(texts * 20)] + [(None, None, None)] * 3, "k int, name string, o struct<a: string, b: double>").repartition(2)
    for s in ("yaml", "toml"):
        p = f"{tmp_path}/x.{s}"
        files.dump_file(d, p)
        assert len([n for n in os.listdir(p) if n.startswith("part")]) == 2
        back = files.load_file(spark, p).select(F.from_json("json", d.schema).alias("r")).select("r.*")
        assert sorted(map(str, back.collect())) == sorted(map(str, d.collect())), s
    (tmp_path / "many.yaml").write_text("---\na: 1\n---\na: 2\n")
    assert sorted(r.json for r in files.load_file(spark, f"{tmp_path}/many.yaml").collect()) == ['{"a": 1}', '{"a": 2}']


def test_stops_are_dealt_out(spark):
    """Many pairs under one stop are made by several tasks."""
    day = lambda s: {"status": s, "seats": {"e": 1}, "prices": {"e": 1.0}}
    rows = [(f"f{k}", "A" if k % 2 else "S", "S" if k % 2 else "C", "08:00:00", "07:00:00+1" if k % 3 == 0 else "07:00:00", {"2024-05-09": day("available"), "2024-05-10": day("landed" if k % 4 else "available")}) for k in range(200)]
    flights = spark.createDataFrame(rows, "flight_number string, origin string, destination string, departure string, arrival string, dates map<string, struct<status: string, seats: map<string, int>, prices: map<string, double>>>")
    d = airline.one_stop_flights(flights, "A", "C", "2024-05-09")
    got = sorted((r.first, r.second, r.stop, r.second_date) for r in d.collect())
    want = [(a[0], b[0], "S", "2024-05-10" if "+1" in a[4] else "2024-05-09") for a in rows for b in rows if a[1] == "A" and b[2] == "C" and b[3] >= a[4] and ("+1" not in a[4] or b[5]["2024-05-10"]["status"] == "available")]
    assert got == sorted(want) and len(got) > 5000
    assert d.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_tfidf_moves_no_weights(spark, data):
    def written():
        top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)

    before = written()
    got = text_queries.tfidf_cosine(registry.Tables(spark, data))
    assert written() - before < os.path.getsize(f"{data}/documents.parquet")
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def test_tfidf_in_many_cells(spark, monkeypatch):
    """Blocks of few words and groups of few terms; ids, texts and words that are missing."""
    for name, size in (("BLOCK_WORDS", 60), ("QUERY_TERMS", 40), ("PAIRS", 7), ("PRODUCTS", 5), ("MOST_DENSE", 3)):
        monkeypatch.setattr(tfidf, name, size)
    rng = np.random.default_rng(5)
    texts = {f"d{k}": " ".join(f"W{x}é" for x in rng.zipf(1.5, rng.integers(1, 30)) if x < 40) for k in range(60)}
    texts |= {"d60": None, "d61": "", "d62": " \n\t ", "d63": "alone", "d64": texts["d0"], "d65": "\x0b w1é\r\n w2é\u00a0 \f"}
    rows = [*texts.items(), (None, "W1é W2é"), (None, None)]
    count = lambda x: (ts := re.findall(r"[^ \t\n\x0b\f\r]+", (x or "").lower())) and Counter(ts + [f"{a} {b}" for a, b in zip(ts, ts[1:])])
    df = Counter(t for _, x in rows for t in count(x))
    w = {k: {t: c * (np.log((len(rows) + 1) / (df[t] + 1)) + 1) for t, c in count(x).items()} for k, x in texts.items() if count(x)}
    w = {k: {t: c / np.sqrt(sum(y * y for y in x.values())) for t, c in x.items()} for k, x in w.items()}
    want = {(a, b): sum(w[a][t] * w[b][t] for t in w[a].keys() & w[b].keys()) for a in w if a < "d3" or a == "d65" for b in w if a != b and w[a].keys() & w[b].keys()}
    docs = spark.createDataFrame(rows, "id string, text string")
    asked = (F.col("id") < "d3") | (F.col("id") == "d65")
    got = tfidf.cosines(docs, "id", "text", asked, 9).collect()
    assert len(got) == len(want) > 500 and {(r["query"], r.doc) for r in got} == want.keys()
    assert max(abs(r.score - want[r["query"], r.doc]) for r in got) < 2e-9
    assert not tfidf.cosines(docs, "id", "text", F.lit(False)).count()
    assert not tfidf.cosines(docs.limit(0), "id", "text", F.lit(True)).count()
    assert not tfidf.cosines(docs.where("id in ('d60', 'd61', 'd62')"), "id", "text", F.lit(True)).count()
