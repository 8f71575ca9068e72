"""Canonical JSON, gold scripts, recordings in blocks, replays that fail, results as a data source."""

import datetime
import decimal
import hashlib
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions import blocks, canonical, gold
from tracemill.operators import statediff
from tracemill.sources import files, results, run_files

RUN = "id string, task_id string, trial int, reward double, trace struct<messages:array<struct<text:string>>>"


def test_canonical_hash_equals_python(spark):
    rng = random.Random(2)
    words = ["", "é", "\U0001f600", '"', "\\", "\n\t\x00\x7f", "plain", "ﬀ", " "]
    number = lambda: rng.choice([None, 0.0, -0.0, 1e-7, 0.1, 1e16, 1.5e300, 123456789.125, rng.random(), rng.uniform(-1e9, 1e9), float("inf")])
    rows = []
    for k in range(1000):
        rows.append((k, (rng.choice(words), number(), rng.choice([None, True, False]), [(rng.choice(words), number()) for _ in range(rng.randint(0, 3))], {rng.choice(words): number() for _ in range(rng.randint(0, 4))}, datetime.date(2024, 1, 1 + k % 28), decimal.Decimal(k) / 4, datetime.datetime(2024, 5, 1, 3, 4, 5, k % 3 * 1000))))
    kind = "z: string, a: double, m: boolean, l: array<struct<y: string, x: double>>, t: map<string, double>, day: date, money: decimal(12,2), at: timestamp_ntz"
    d = spark.createDataFrame(rows, f"k int, s struct<{kind}>").repartition(3)
    got = {r.k: (r.j, r.h) for r in d.select("k", canonical.canonical_json("s").alias("j"), canonical.canonical_hash(F.col("s")).alias("h")).collect()}
    for k, s in rows:
        state = {"z": s[0], "a": s[1], "m": s[2], "l": [{"y": y, "x": x} for y, x in s[3]], "t": s[4], "day": s[5], "money": s[6].quantize(decimal.Decimal("0.01")), "at": s[7]}
        want = json.dumps(state, sort_keys=True, default=str)
        assert got[k] == (want, hashlib.sha256(want.encode()).hexdigest())
    t = spark.createDataFrame([('{"b": 1, "a": [1.50, "é"]}',), (None,)], "t string").select(canonical.canonical_text("t").alias("c")).collect()
    assert [r.c for r in t] == ['{"a": [1.5, "\\u00e9"], "b": 1}', None]


def message(uuid, active, *texts):
    return f'<message uuid="{uuid}" active="{active}">' + "".join(f"<chunk id={k}>{t}</chunk>" for k, t in enumerate(texts)) + "</message>"


def test_gold_scripts(spark):
    rows = [("a", 0, message("x", "0", "Hel", "lo", " you")), ("a", 1, message("x", "2,0", "Hel", "lo", " you") + message("y", "10,9", *"abcdefghijk")), ("a", 2, None), ("a", 3, "no tags"), ("a", 4, message("y", "", "other")), ("b", 0, message("z", "1", "one", "\ntwo"))]
    d = spark.createDataFrame(rows, "run string, pos int, script string")
    got = {r.run: r for r in gold.merge(d, ["run"], "pos", "script").collect()}
    assert got["a"].script == message("x", "0,2", "Hel", "lo", " you") + message("y", "9,10", *"abcdefghijk") and got["a"].received == 4 and got["a"].chunks == 14
    assert got["b"].script == message("z", "1", "one", "\ntwo")
    r = spark.createDataFrame([(got["a"].script,), ("plain <b>",), (None,)], "s string").select(gold.plain_text(F.col("s")).alias("p"), gold.received_text(F.col("s")).alias("r")).collect()
    assert [tuple(x) for x in r] == [("Hello youabcdefghijk", "Hel youjk"), ("plain <b>", ""), (None, "")]


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_blocks_are_one_convolution(spark, size):
    rng = np.random.default_rng(size)
    tracks = {k: rng.integers(-32768, 32768, n).astype("<i2") for k, n in enumerate((1, 2, 63, 64, 65, 1000, 2001))}
    taps = rng.normal(size=8) / 3
    d = spark.createDataFrame([(k, bytearray(t.tobytes() + b"x" * (k % 2))) for k, t in tracks.items()] + [(99, bytearray(b"")), (98, None)], "k int, pcm binary")
    out = {r.k: np.frombuffer(r.pcm, "<i2") for r in blocks.join_blocks(blocks.filter_blocks(blocks.cut_blocks(d, "k", "pcm", size), "k", taps), "k").collect()}
    assert set(out) == set(tracks)
    for k, t in tracks.items():
        whole = np.clip(np.rint(np.convolve(t.astype(float), taps)[: len(t)]), -32768, 32767)
        assert (out[k] == whole).all()


def test_overlay_is_a_sum_by_the_clock(spark):
    rng = np.random.default_rng(4)
    rows = [(k % 2, int(rng.integers(-50, 400)), rng.integers(-30000, 30000, int(rng.integers(1, 300))).astype("<i2")) for k in range(20)]
    d = spark.createDataFrame([(m, a, bytearray(x.tobytes())) for m, a, x in rows], "mix int, at int, pcm binary")
    want = {0: {}, 1: {}}
    for m, a, x in rows:
        for i, v in enumerate(x.tolist()):
            want[m][a + i] = want[m].get(a + i, 0) + v
    for r in blocks.overlay(d, "mix", F.col("at"), "pcm", 64).collect():
        for i, v in enumerate(np.frombuffer(r.pcm, "<i2").tolist()):
            assert v == max(-32768, min(32767, want[r.mix].get(64 * r.cell + i, 0)))
            want[r.mix].pop(64 * r.cell + i, None)
    assert want == {0: {}, 1: {}}


def test_a_replay_that_fails_stays_alone(spark):
    def reducer(state, name, args):
        if args.get("n", 0) < 0:
            raise KeyError("below")
        state["n"] = state.get("n", 0) + args["n"]
        return state["n"]

    calls = [(1, 0, "add", '{"n": 2}', "2"), (1, 1, "add", '{"n": 3}', "5"), (2, 0, "add", '{"n": 1}', None), (2, 1, "add", '{"n": -1}', None), (3, 0, "add", '{"n": 1}', "9"), (4, 0, "look", "{", None), (5, 0, "add", "{", None)]
    c = spark.createDataFrame(calls, "k int, pos long, name string, arguments string, response string")
    i = spark.createDataFrame([(k, '{"n": 0}') for k in range(1, 7)], "k int, state string")
    got = {r.k: r for r in statediff.replay(c, i, "k", reducer, ["add"], isolate=True).collect()}
    assert (got[1].state, got[1].applied, got[1].reason) == ('{"n": 5}', 2, None)
    assert got[2].state is None and got[2].applied == 1 and got[2].reason == "KeyError: 'below'"
    assert got[3].reason == "ValueError: replayed response of add differs" and got[4].state == '{"n": 0}' == got[6].state and "JSONDecodeError" in got[5].reason
    gold_ = spark.createDataFrame([(1, 0, "add", '{"n": 2}', None), (3, 0, "add", '{"n": 1}', None)], c.schema)
    d = {r.k: (r.db_signature, r.reason and r.reason.split(":")[0]) for r in statediff.replay_and_diff(i, gold_, c, "k", reducer, ["add"], ["n"]).collect()}
    assert d == {1: ("wrong:n", None), 2: (None, "predicted"), 3: (None, "predicted"), 4: ("no_db_diff", None), 5: (None, "predicted"), 6: ("no_db_diff", None)}


def test_runs_written_are_runs_read(spark, tmp_path):
    p = str(tmp_path / "runs")
    rows = [(f"r {k}/é".replace("/", "-"), "t", k, None if k % 3 else 0.5, ([(f"é {k}",), (None,)],)) for k in range(50)]
    d = spark.createDataFrame(rows, RUN).repartition(4)
    results.save_runs(d, p)
    assert len(os.listdir(f"{p}/simulations")) == 50 and not [n for n in os.listdir(p) if n.startswith("_")]
    back = results.load_runs(spark, p, d.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, d.collect()))
    assert {r.id for r in spark.read.schema("id string").json(f"{p}/index").collect()} == {r[0] for r in rows}
    assert not results.integrity_report(spark, p).count() and not run_files.integrity(p)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        results.save_runs(d, p)
    os.remove(f"{p}/simulations/r 7-é.json") if os.path.exists(f"{p}/simulations/r 7-é.json") else os.remove(f"{p}/simulations/r 7-%C3%A9.json")
    with open(f"{p}/simulations/new.json", "w") as f:
        f.write('{"id": "new"}')
    assert {tuple(r) for r in results.integrity_report(spark, p).collect()} == {("r 7-é", "missing"), ("new", "extra")} == set(run_files.integrity(p))
    for read in (lambda: results.load_runs(spark, p, d.schema).count(), lambda: spark.read.format("run_files").schema(d.schema).load(p).count()):
        with pytest.raises(Exception, match="index and files differ"):
            read()
    results.save_runs(d.limit(3), p, overwrite=True)
    assert results.load_runs(spark, p, d.schema).count() == 3
    results.save_runs(d.where("false"), str(tmp_path / "none"))
    assert results.load_runs(spark, str(tmp_path / "none"), d.schema).count() == 0


def test_ids_that_can_not_be_files(spark, tmp_path):
    for bad in (None, "", "a/b"):
        with pytest.raises(Exception, match="not an id"):
            results.save_runs(spark.createDataFrame([(bad, "t")], "id string, task_id string"), str(tmp_path / f"x{bad and len(bad)}"))
    with pytest.raises(ValueError, match="repeat"):
        results.save_runs(spark.createDataFrame([("a", "t"), ("a", "u")], "id string, task_id string"), str(tmp_path / "y"))


def test_yaml_and_toml_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, "é: x", [1, 2], ("y", None)), (2, "null", [], ("'", 2.5))], "k int, name string, ns array<int>, o struct<a b: string, c: double>".replace("a b", "`a b`"))
    for s in ("yaml", "toml"):
        files.dump_file(d, f"{tmp_path}/x.{s}")
        back = files.load_file(spark, f"{tmp_path}/x.{s}").select(F.from_json("json", d.schema).alias("r")).select("r.*")
        assert sorted(map(str, back.collect())) == sorted(map(str, d.collect())), s
