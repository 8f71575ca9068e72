"""Ticks and streams: golden orders, batch against stream."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tracemill.streaming import streams as S
from tracemill.streaming import ticks as K

TICKS = "conv_id int, tick_id int, ts string, self_text string, other_text string, self_calls array<struct<id:string,name:string>>, other_results array<struct<id:string,content:string>>"


def grid(own, other, n=8, calls=None, got=None):
    calls, got = calls or {}, got or {}
    return [(1, t, f"{t:03d}", f"s{t} " if t in own else None, f"o{t} " if t in other else None, [(i, "f") for i in calls[t]] if t in calls else None, [(i, "r") for i in got[t]] if t in got else None) for t in range(n)]


def span(a, b):
    return set(range(a, b + 1))


def words(side, a, b):
    return (side, "".join(f"{side[0]}{t} " for t in range(a, b + 1)))


S_, O_ = "self", "other"
CASES = [
    (span(3, 4), span(0, 1), [words(O_, 0, 1), words(S_, 3, 4)]),
    (span(0, 1), span(3, 4), [words(S_, 0, 1), words(O_, 3, 4)]),
    (span(2, 4), span(0, 2), [words(O_, 0, 2), words(S_, 2, 4)]),
    (span(0, 2), span(2, 4), [words(S_, 0, 2), words(O_, 2, 4)]),
    (span(0, 2), span(0, 2), [words(O_, 0, 2), words(S_, 0, 2)]),
    (span(2, 3), span(0, 6), [words(O_, 0, 3), words(S_, 2, 3), words(O_, 4, 6)]),
    (span(0, 5), span(2, 3), [words(S_, 0, 3), words(O_, 2, 3), words(S_, 4, 5)]),
    (span(1, 1) | span(4, 4), span(0, 6), [words(O_, 0, 1), words(S_, 1, 1), words(O_, 2, 4), words(S_, 4, 4), words(O_, 5, 6)]),
    (set(), set(), []),
    ({0}, {0}, [words(O_, 0, 0), words(S_, 0, 0)]),
    ({1}, set(), [words(S_, 1, 1)]),
    (set(), {1}, [words(O_, 1, 1)]),
]


@pytest.mark.parametrize("own,other,want", CASES)
def test_splice(spark, own, other, want):
    d = spark.createDataFrame(grid(own, other), TICKS)
    assert [(r.side, r.text) for r in K.linearise_containment(d).orderBy("place").collect()] == want


def test_integration_gap(spark):
    d = spark.createDataFrame(grid({0, 2}, set()), TICKS)
    assert K.linearise_containment(d, 1).count() == 2
    assert K.linearise_containment(d, 2).count() == 1


def test_tools_and_silence(spark):
    d = spark.createDataFrame(grid({0}, {5}, calls={1: ["a", "b"]}, got={2: ["b"], 3: ["x"]}), TICKS)
    got = [(r.side, r.text.strip()) for r in K.linearise_containment(d, 1, 2, 0.5).orderBy("place").collect()]
    assert got == [("self", "s0"), ("system", "[Both parties silent for 2.0 seconds]"), ("tool", "call a,call b;result x;result b"), ("other", "o5"), ("system", "[Both parties silent for 1.0 seconds]")]


def test_overlap_regions(spark):
    d = spark.createDataFrame(grid({1, 2, 3}, {0, 2, 3, 6}), TICKS)
    assert [r.text.strip() for r in K.linearise_overlap(d).orderBy("place").collect()] == ["o0", "s1", "o2", "o3", "s2", "s3", "o6"]


def test_expand_environment(spark):
    d = spark.createDataFrame(grid({0}, {0, 1}, 2, got={0: ["r"]}), TICKS)
    got = [(r.tick_id, r.self_text, r.other_text, r.other_results is not None) for r in K.expand_environment(d).orderBy("tick_id").collect()]
    assert got == [(0, "s0 ", None, True), (1, None, "o0 ", False), (2, None, "o1 ", False)]


def test_interval_log(spark):
    log = [("r", "x", "u", "close", 0, 0), ("r", "x", "u", "open", 1, 1), ("r", "x", "u", "open", 2, 2), ("r", "x", "u", "close", 3, 3), ("r", "x", "u", "close", 5, 4), ("r", "x", "u", "open", 7, 5)]
    d = spark.createDataFrame(log, "run_id string, effect string, who string, event string, at int, seq int")
    assert sorted((r.start, r.end) for r in K.close_intervals(d, F.lit(9)).collect()) == [(1, 5), (2, 3), (7, 9)]


def test_transcripts_and_order(spark):
    e = spark.createDataFrame([("a", "start", 1, None), ("a", "completed", 4, "hi"), ("b", "completed", 1, "no"), ("b", "start", 2, None)], "item_id string, event string, at int, text string")
    assert [tuple(r) for r in K.transcripts(e).collect()] == [("a", 1, 4, "hi")]
    t = spark.createDataFrame([(1, 0, ["x"], ["y", "z"]), (1, 1, None, ["w"])], "conv_id int, tick_id int, agent_calls array<string>, user_calls array<string>")
    assert [r.call for r in K.replay_order(t).orderBy("pos").collect()] == ["y", "z", "x", "w"]
    o = spark.range(1).select(K.overlap_initiator(F.lit(3), F.lit(1)).alias("a"), K.overlap_initiator(F.lit(1), F.lit(3)).alias("b"), K.overlap_initiator(F.lit(2), F.lit(2)).alias("c"), K.overlap_initiator(F.lit(0), F.lit(2)).alias("d"))
    assert tuple(o.first()) == ("other", "self", "other", None)


def test_policy_rules():
    p, s = S.Policy(wait_other=2, wait_self=2, yield_interrupted=2, yield_interrupting=4), S.Policy.start()
    acts = [p.step(s, *x) for x in [(False, True, False), (False, True, False), (False, False, False), (False, False, False), (True, False, False), (True, True, False), (True, True, False), (False, False, True)]]
    assert acts == ["wait", "wait", "wait", "generate_message", "keep_talking", "keep_talking", "stop_talking", "generate_message"]


def acts(p, *ticks):
    s = S.Policy.start()
    return [p.step(s, *t[:3], **(t[3] if len(t) > 3 else {})) for t in ticks]


def test_policy_signals():
    own, both, heard, quiet = (True, False, False), (True, True, False), (False, True, False), (False, False, False)
    p = S.Policy(yield_interrupted=2, yield_interrupting=4, wait_other=1, wait_self=1)
    # An acknowledgement is not broken off, speech with a tool's result holds its ground longer.
    assert acts(p, own, both, (*both, {"back": True}), both) == ["keep_talking", "keep_talking", "keep_talking", "stop_talking"]
    assert acts(p, own, *[(*both, {"holds": True})] * 4) == ["keep_talking"] * 4 + ["stop_talking"]
    # Without a limit for being interrupted nothing ends speech.
    assert "stop_talking" not in acts(S.Policy(yield_interrupted=None, yield_interrupting=1), heard, *[both] * 9)
    # Verdicts count at every third tick; breaking in comes before acknowledging, a tool before both.
    q = S.Policy(check_every=3, wait_other=1, wait_self=1)
    assert acts(q, *[(*heard, {"interrupts": True})] * 3) == ["wait", "wait", "generate_message"]
    assert acts(q, heard, heard, (*heard, {"interrupts": True, "acknowledges": True}), heard, heard, (*heard, {"acknowledges": True})) == ["wait", "wait", "generate_message", "wait", "wait", "backchannel"]
    assert acts(q, heard, heard, (False, True, True, {"interrupts": True})) == ["wait", "wait", "generate_message"]
    # Chance decides between the least and the most ticks.
    r = S.Policy(backchannel_min=2, backchannel_max=5, rate=2.0, tick_seconds=0.5)
    assert acts(r, *[(*heard, {"draw": 0.99})] * 6) == ["wait"] * 4 + ["backchannel", "wait"]
    assert acts(r, *[(*heard, {"draw": 0.5})] * 4) == ["wait", "backchannel", "wait", "backchannel"]
    # Thresholds that vary, and overlap that is not answered.
    v = S.Policy(wait_other=1, wait_self=1, variance=4)
    assert acts(v, heard, *[(*quiet, {"draw": 0.4})] * 3) == ["wait", "wait", "wait", "generate_message"]
    assert acts(v, heard, *[(*quiet, {"draw": 0.9})] * 5) == ["wait"] * 5 + ["generate_message"]
    for discard, last in ((False, "generate_message"), (True, "wait")):
        assert acts(S.Policy(wait_other=1, wait_self=1, discard_overlap=discard), own, both, own, quiet)[-1] == last


def test_policy_stream_equals_batch(spark, tmp_path):
    rows = [(c, t, (c * t) % 3 == 0, (t // 2 + c) % 2 == 0, t % 11 == 10, t % 7 == 3, (c * 37 + t * 11) % 100 / 100) for c in range(6) for t in range(30)]
    schema = "conv_id int, tick_id int, own boolean, other boolean, tool boolean, interrupts boolean, draw double"
    src = tmp_path / "in"
    src.mkdir()
    for n in range(3):
        part = [r for r in rows if r[1] // 10 == n]
        (src / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("conv_id", "tick_id", "own", "other", "tool", "interrupts", "draw"), r))) for r in part))
        os.utime(src / f"{n}.json", (1_700_000_000 + 60 * n,) * 2)  # files are taken in order of time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(src))
    p = S.Policy(wait_self=2, backchannel_min=2, backchannel_max=6, rate=3.0, tick_seconds=0.2, variance=2, check_every=2, discard_overlap=True)
    S.run_available(S.decision_stream(stream, p), None, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, S.decisions(spark.createDataFrame(rows, schema), p).collect()))
    assert got == want


def test_commit_log(spark, tmp_path):
    from tracemill.streaming.commitlog import COMPACT, CommitLog

    log = CommitLog(spark, str(tmp_path / "t"), ["k", "j"])
    rows = lambda a, b: spark.range(a, b).select(F.col("id").alias("k"), F.lit(1).alias("j"), F.lit("x").alias("v"))
    log.write(rows(0, 10), "w", 0)
    # A batch that is repeated after its commit, and one whose writer was lost between data and commit.
    assert log.write(rows(0, 10), "w", 0) is None
    rows(10, 20).write.parquet(f"{log.path}/data/000000000001-lost")
    assert log.read(rows(0, 1).schema).count() == 10
    log.write(rows(10, 20), "w", 1)
    assert sorted(r.k for r in log.read(rows(0, 1).schema).collect()) == list(range(20))
    # Another stream with the same rows adds nothing; its batch ids are its own.
    log.write(rows(5, 25), "other", 0)
    assert sorted(r.k for r in log.read(rows(0, 1).schema).collect()) == list(range(25))
    # Keys that grow are held against no older folder, however many there are; the log is read from few files.
    for n in range(2, COMPACT + 5):
        log.write(rows(100 * n, 100 * n + 2), "w", n)
    entries = log.entries()
    assert len(entries) == COMPACT + 6 and all(e["compared"] == 0 for e in entries[3:]) and entries[2]["compared"] == 2
    assert log.read(rows(0, 1).schema).count() == 25 + 2 * (COMPACT + 3)
    assert log.write(rows(0, 0), "w", 999) is None and len(log.entries()) == COMPACT + 7
    nulls = spark.createDataFrame([(None, 1, "a"), (None, 1, "b")], "k long, j int, v string")
    log.write(nulls, "w", 1000)
    log.write(nulls, "w", 1001)
    assert log.read(nulls.schema).where("k is null").count() == 1
