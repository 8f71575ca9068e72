"""Queries that do the whole job: every stated row, whole texts, against brute force."""

import html
import math
import os
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect
from pyspark.sql import functions as F

from tracemill.operators import ordered, retrieval
from tracemill.plans import evaluation_queries, ordered_queries, registry, text_queries  # noqa: F401


@pytest.fixture(scope="module")
def data(data, tmp_path_factory):
    """The small tables, with a benchmark of more than fifty items."""
    folder = tmp_path_factory.mktemp("tables")
    for f in os.listdir(data):
        os.symlink(f"/root/testdata/sf0.1/{f}" if f == "benchmark.parquet" else f"{data}/{f}", folder / f)
    return str(folder)


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def words(text):
    return text.lower().split()


def fiftieth(con, sql):
    return [r for r in con.execute(sql).fetchall() if r[0] % 50 == 0]


def best(scores, k, last):
    """The k best of (doc, score), ties by the document, the last first if so asked."""
    ranked = sorted(((d, round(s, 6)) for d, s in scores), key=lambda x: (-x[1], -x[0] if last else x[0]))
    return [(d, s, r) for r, (d, s) in enumerate(ranked[:k], 1)]


@pytest.fixture(scope="module")
def bm25(con):
    docs = {d: Counter(words(x)) for d, x in con.execute("select doc_id, text from documents").fetchall()}
    df = Counter(t for c in docs.values() for t in c)
    raw = {t: np.log(len(docs) - n + 0.5) - np.log(n + 0.5) for t, n in df.items()}
    mean, long = np.mean(list(raw.values())), {d: c.total() for d, c in docs.items()}
    idf, usual = {t: mean * 0.25 if r < 0 else r for t, r in raw.items()}, np.mean(list(long.values()))
    score = lambda ts, d, c: sum(idf[t] * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * long[d] / usual)) for t in ts if t in c)
    return {q: best([(d, score(words(x), d, c)) for d, c in docs.items()], 10, False) for q, x in fiftieth(con, "select item_id, text from benchmark")}


@pytest.fixture(scope="module")
def nearest(con):
    rows = con.execute("select vec_id, embedding from embeddings").fetchall()
    v = np.array([r[1] for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return {q: best([(d, float(s)) for (d, _), s in zip(rows, v @ v[k])], 10, True) for k, (q, _) in enumerate(rows) if q % 50 == 0}


def same(df, want, tolerance=2e-6):
    got = {}
    for r in df.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["doc"], r["score"], r["rank"]))
    assert set(got) == set(want)
    for q in want:
        assert [x[::2] for x in got[q]] == [x[::2] for x in want[q]], q
        assert np.allclose([x[1] for x in got[q]], [x[1] for x in want[q]], atol=tolerance, rtol=0)


def test_every_fiftieth_item_is_searched(spark, data, bm25):
    assert len(bm25) == 4
    same(registry.QUERIES["bm25_topk"](spark, data), bm25)


def test_every_fiftieth_vector_is_searched(spark, data, nearest, monkeypatch):
    assert len(nearest) > 3
    same(registry.QUERIES["cosine_topk"](spark, data), nearest)
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    same(registry.QUERIES["cosine_topk"](spark, data), nearest)


def test_fusion_and_reranking_cover_every_fiftieth(spark, data, bm25, nearest):
    fused, ranked = {}, {}
    for q in {*bm25, *nearest}:
        top = {}
        for d, s, _ in bm25.get(q, []) + nearest.get(q, []):
            top[d] = max(s, top.get(d, s))
        fused[q] = best(top.items(), 12, False)
        scaled = [(d, min(10.0, max(0.0, s * 12 - 1))) for d, s, _ in nearest.get(q, [])]
        ranked[q] = best([x for x in scaled if x[1] >= 2], 5, False)
    same(registry.QUERIES["fusion_max"](spark, data), fused)
    same(registry.QUERIES["rerank_topk"](spark, data), {q: r for q, r in ranked.items() if r}, 3e-5)


def test_tfidf_over_documents(spark, data, con):
    docs = {}
    for d, x in con.execute("select doc_id, text from documents").fetchall():
        ts = words(x)
        docs[d] = Counter(ts + [f"{a} {b}" for a, b in zip(ts, ts[1:])])
    df = Counter(t for c in docs.values() for t in c)
    w = {d: {t: n * (np.log((len(docs) + 1) / (df[t] + 1)) + 1) for t, n in c.items()} for d, c in docs.items()}
    norm = {d: np.sqrt(sum(x * x for x in c.values())) for d, c in w.items()}
    want = {(a, b): sum(w[a][t] * w[b][t] for t in w[a].keys() & w[b].keys()) / norm[a] / norm[b] for a in w if a % 50 == 0 for b in w if a != b and w[a].keys() & w[b].keys()}
    got = {(r["query"], r["doc"]): r["score"] for r in registry.QUERIES["tfidf_cosine"](spark, data).collect()}
    assert got.keys() == want.keys() and len({a for a, _ in want}) > 3
    assert max(abs(got[k] - want[k]) for k in want) < 2e-6


def test_pipeline_searches_whole_items(spark, data, con, bm25):
    docs = con.execute("select doc_id, text from documents").fetchall()
    want = {}
    for q, x in fiftieth(con, "select item_id, text from benchmark"):
        found = re.compile(retrieval.valid_pattern(x))
        top = {d: s for d, s, _ in bm25[q][:5]}
        for d, n, _ in best([(d, float(n)) for d, y in docs if (n := len(found.findall(y)))], 5, False):
            top[d] = max(n, top.get(d, n))
        want[q] = best(top.items(), 6, False)
    same(registry.QUERIES["retrieval_pipeline"](spark, data), want)


def test_grep_matches_all_patterns_in_one_pass(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a A b"), (2, "(a"), (3, "none"), (4, "b b b")], "id int, text string")
    q = spark.createDataFrame([(k, p) for k, p in enumerate(["a", "b+", "(a", "zz"])], "query int, text string")
    want = [(0, 1, 2.0, 1), (0, 2, 1.0, 2), (1, 4, 3.0, 1), (1, 1, 1.0, 2), (2, 2, 1.0, 1)]
    for block in (4096, 2):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        got = retrieval.grep_top_k(docs, q, 2, "id", "text", "query", "text").orderBy("query", "rank")
        assert [(r["query"], r.doc, r.score, r["rank"]) for r in got.collect()] == want


def test_envelope_spans_each_users_events(spark, data, con):
    users = {}
    for u, x in con.execute("select user_id, value from events order by user_id, ts, event_id").fetchall():
        users.setdefault(u, []).append(x)
    want = set()
    for u, x in users.items():
        n = max(1, len(x) // 6)
        want |= {(u, k, min(x[k * n : k * n + n]), max(x[k * n : k * n + n])) for k in range(len(x) // n)}
    got = [(r.user_id, r.bucket, r.low, r.high) for r in registry.QUERIES["waveform_envelope"](spark, data).collect()]
    assert len(got) == len(want) and set(got) == want


def test_envelope_of_short_and_long_groups(spark):
    d = spark.createDataFrame([(g, k) for g, n in ((None, 3), ("b", 11), ("c", 1000)) for k in range(n)], "g string, pos long")
    got = {(r.g, r.bucket): (r.low, r.high) for r in ordered.envelope(d, ["g"], F.col("pos"), "pos", 6).collect()}
    want = {(None, k): (k, k) for k in range(3)} | {("b", k): (k, k) for k in range(11)} | {("c", k): (166 * k, 166 * k + 165) for k in range(6)}
    assert got == want


def test_release_gives_whole_transcripts(spark, data, con):
    turns = {}
    for c, n, x in con.execute("select conv_id, turn, text from conversations order by conv_id, turn").fetchall():
        turns.setdefault(c, []).append((n, x))
    want = set()
    for c, rows in turns.items():
        text, at = rows[0][1], 0
        for n, _ in rows:
            end = max(at, min(len(text), math.ceil(n * 7 % 10 / 9.0 * len(text))))
            want.add((c, n, end, text[at:end]))
            at = end
    assert max(r[2] for r in want) > 40
    got = [tuple(r) for r in registry.QUERIES["proportional_release"](spark, data).select("conv_id", "turn", "released", "part").collect()]
    assert len(got) == len(want) and set(got) == want


def test_whole_pages_are_escaped(spark, data, con):
    want = {(p, html.escape(x), len(x)) for p, x in con.execute("select page_id, html from pages").fetchall()}
    assert max(r[2] for r in want) > 200
    got = [tuple(r) for r in registry.QUERIES["html_escape"](spark, data).select("page_id", "escaped", "n").collect()]
    assert len(got) == len(want) and set(got) == want
