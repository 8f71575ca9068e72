"""Ranked search, whitening, quality rules and long label sequences against plain versions."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import decontaminate, pii, quality_rules, ranked_search, simhash, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- long label sequences ---------------------------------------------------------


def slow_decode(crf, features, sequence):
    score, out = crf.emit[features].sum(1), []
    for s in np.unique(sequence):
        rows = np.flatnonzero(sequence == s)
        best, back = score[rows[0]], []
        for r in rows[1:]:
            reach = best[:, None] + crf.move
            back.append(reach.argmax(0))
            best = reach.max(0) + score[r]
        label = [best.argmax()]
        for b in reversed(back):
            label.append(b[label[-1]])
        out += label[::-1]
    return out


def test_pieces_decode_like_whole_sequences(monkeypatch):
    crf, rng = pii.train(), np.random.default_rng(3)
    for most in (2, 3, 5, 8):
        monkeypatch.setattr(pii, "PIECE_WORDS", most)
        for _ in range(5):
            sequence = np.repeat(np.arange(10), rng.integers(1, 90, 10))
            features = np.stack([rng.integers(o, o + n, len(sequence)) for o, n in zip(pii.OFFSETS, pii.SIZES)], 1)
            assert crf.decode(features, sequence).tolist() == slow_decode(crf, features, sequence)


def test_a_megabyte_of_numbers_takes_seconds():
    crf = pii.train()
    for t in ("1 " * 350_000, "a1 " * 350_000, "+1 " * 350_000):
        began = time.process_time()
        pii.find([t], crf)
        assert time.process_time() - began < 3, t[:9]


# --- ranked search ----------------------------------------------------------------


def slow_ranks(docs, items, k=10):
    found = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    found = [(i, Counter(t), len(t)) for i, t in found if t]
    n, size, df = len(found), sum(x[2] for x in found), Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        hits = []
        for i, c, length in found:
            m = 25 + (75 * length * n) // size
            s = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
            if s > 0:
                hits.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(hits, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def test_ranks_are_exact(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    docs = [(k, " ".join(rng.choices(words, k=rng.randint(0, 80))).title()) for k in range(600)]
    docs += [(700 + k, docs[3][1]) for k in range(60)] + [docs[5], docs[5], (None, docs[3][1]), (1, None), (2, " .,! "), (3, "Été éTÉ w1 " * 30), (4, "w1 " * 50_000)]
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(30)] + [(90, docs[3][1]), (90, docs[3][1]), (91, None), (92, "..."), (93, "nothing-like this"), (None, "été w1 w1")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = slow_ranks(docs, items)
    got = lambda: Counter(tuple(r) for r in ranked_search.ranked(d, i).collect())
    assert got() == want
    monkeypatch.setattr(ranked_search, "BLOCK_CHARS", 300)  # several blocks of queries
    monkeypatch.setattr(ranked_search, "CELLS", 50)  # and of documents
    assert got() == want
    assert not ranked_search.ranked(d.where("false"), i).collect() and not ranked_search.ranked(d, i.where("false")).collect()


def test_bytes_bound_scores_and_prune():
    rng = np.random.default_rng(0)
    import pyarrow as pa

    rows, terms = 3000, 40
    chosen = [sorted(rng.choice(terms, 8, replace=False).tolist()) for _ in range(rows)]
    tf = [rng.integers(1, 30, 8).tolist() for _ in range(rows)]
    m = rng.integers(25, 400, rows)
    level = [(-(-ranked_search.impact(np.array(t), np.array(x)) // ranked_search.STEP)).astype(np.uint8).tobytes() for t, x in zip(tf, m)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array(m), pa.array(chosen, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32())), pa.array(level)], names=list("abcde"))
    block = ranked_search.Block(batch, terms)
    queries = ranked_search.Queries([{1: 1, 5: 2}, {7: 1, 8: 1, 9: 1}], rng.integers(1, 9000, terms).tolist())
    bounds = block.bounds(queries)
    for q, t in enumerate(queries.terms):
        exact = block.exact(np.arange(rows), t)
        assert (bounds[:, q] >= exact).all() and ((bounds[:, q] > 0) == (exact > 0)).all()
    best = [[], []]
    assert 20 <= ranked_search.search_block(block, queries, 10, best) < rows


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Abc d-e É9 " * 200
    whole = ranked_search.term_counts(text, lambda w: w)
    monkeypatch.setattr(ranked_search, "PIECE", 7)
    assert ranked_search.term_counts(text, lambda w: w) == whole == (800, Counter({b"abc": 200, b"d": 200, b"e": 200, "É9".encode(): 200}))


# --- whitening --------------------------------------------------------------------


def slow_whitening(vectors, k):
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in vectors}
    u = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(u), u.sum(0)
    e, v = np.linalg.eigh((u - s / n).T @ (u - s / n) / n)
    e, v = e[::-1], v[:, ::-1]
    return {i: (sum((n * a - int(b)) ** 2 for a, b in zip(r, s)), np.abs((np.array(r) - s / n) @ v[:, :k] / np.sqrt(e[:k]))) for i, r in x.items()}, e / e.sum(), n


def test_whitening_matches_eigh(spark, data):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((700, 24)).cumsum(1) / 9
    vectors = [(k, v.tolist()) for k, v in enumerate(base)] + [(1000 + k, base[3].tolist()) for k in range(300)]
    odd = [(2000, None), (2001, [None] * 24), (2002, [float("nan")] * 24), (2003, [float("inf")] + [0.0] * 23), (2004, []), (2005, [1.0, 2.0]), (2006, [3e38] * 24)]
    d = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("x", F.lit("x")).withColumn("n", F.lit(1)).repartition(3)
    want, share, n = slow_whitening(vectors, 4)
    got = whitening.whiten(d).collect()
    assert len(got) == 4 * len(vectors)
    for r in got:
        square, z = want[r.id]
        assert r.n == n and r.deviation == square and abs(abs(r.whitened) - z[r.component - 1]) < 1e-6
        assert abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-8
    signs = {}
    for r in got:  # one sign for all rows: equal vectors, equal values
        if r.id >= 1000:
            assert signs.setdefault(r.component, r.whitened) == r.whitened


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<double>"
    assert not whitening.whiten(spark.createDataFrame([], schema)).collect()
    assert not whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [3.0, 2.0])], schema)).collect()
    assert [(r.component, round(abs(r.whitened), 9), r.explained) for r in got] == [(1, 1.0, 1.0)] * 2
    huge = whitening.whiten(spark.createDataFrame([(1, [1e15, 2.0]), (2, [-1e15, 2.0]), (3, [0.0, 1.0])], schema), k=1).collect()
    assert [r.deviation for r in huge] == [None] * 3 or all(r.n == 3 for r in huge)


def test_flat_spectrum_is_certified():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((500, 500)))[0]
    e = np.linspace(1.0, 1.3, 500)
    a = (q * e) @ q.T
    passes = []
    value, vector, n = whitening.components(lambda b: passes.append(1) or a @ b, 500, 4)
    assert np.allclose(value, e[::-1][:4], atol=1e-10) and np.abs(a @ vector - vector * value).max() < 1e-9 and n == len(passes) < 400


# --- quality rules ----------------------------------------------------------------


def slow_rules(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked), failed


def test_rules_by_definition(spark, data):
    rng = random.Random(6)
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    texts += [None, "", " \n\t", "a", "x y z u v", "x y z u v " * 2, "a b " * 9, "one two\n" * 7, "𝔘 ñ #|< a\x0bb\x0cc", "no yes " * 20_000, " ".join(f"k{k % 3001}" for k in range(30_000))]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randint(4, 60))) for _ in range(300)]
    d = spark.createDataFrame([(k, t, "en", k, "row") for k, t in enumerate(texts)], "doc_id long, text string, lang string, kept long, row string").repartition(4)
    got = {r.doc_id: r for r in quality_rules.judge(d).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_rules(t), (t or "")[:60]
        assert not (r.base_failed and r.kept) and r.row == "row"


def test_distance_is_jensen_shannon(spark):
    d = spark.createDataFrame([([0.5, 0.5, 0.0], [0.0, 0.5, 0.5]), ([1.0, 0.0, 0.0], [0.0, 0.0, 1.0]), ([0.2, 0.3, 0.5], [0.2, 0.3, 0.5])], "p array<double>, q array<double>")
    got = [r[0] for r in d.select(quality_rules.distance(F.col("p"), F.col("q"))).collect()]
    assert got == pytest.approx([math.sqrt(0.5), 1.0, 0.0], abs=1e-9)


def test_verdicts(spark, data):
    """Clean labelled documents stay, capitals, tables and symbols go; short ones and ones without a language are not judged by distance."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    text = docs.where("lang = 'en' and length(text) > 800").orderBy("doc_id").first().text
    odd = [(-1, text.upper()), (-2, re.sub(r"\s+", " | ", text)), (-3, re.sub(r"(\w) ", r"\1## ", text)), (-4, "".join(random.Random(1).choices("0123456789 ", k=900)))]
    more = [(i, t, "en") for i, t in odd] + [(-5, text.upper(), None), (-6, text.upper(), "xx"), (-7, "Ten words in capitals are NOT JUDGED BY ANY DISTANCE", "en")]
    got = {r.doc_id: r for r in quality_rules.judge(docs.unionByName(spark.createDataFrame(more, docs.schema))).collect()}
    assert [got[k].kept for k in range(-7, 0)] == [True, True, True, False, False, False, False]
    assert got[-5].chars_distance is None and got[-7].chars_distance is None
    good = [r.doc_id for r in spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").collect()]
    judged = [got[k] for k in good if k in got and not got[k].base_failed]
    assert sum(r.kept for r in judged) >= 0.97 * len(judged) > 0
    kept = quality_rules.drop_failing(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for k, r in got.items() if k is not None and k >= 0)


def test_rules_of_nothing(spark):
    assert not quality_rules.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).collect()


# --- decontamination in bands, nodes of wide fingerprints ---------------------------------


def test_windows_together_are_like_one_by_one():
    rng = random.Random(8)
    for _ in range(60):
        m = rng.randint(12, 200)
        pattern = "".join(rng.choices("abcd é", k=m))
        k = m // 12
        text = "".join(rng.choices("abcd éx", k=150))
        spoiled = list(pattern)
        for _ in range(rng.randint(0, k + 1)):
            spoiled[rng.randrange(m)] = rng.choice("abcx")
        text += "".join(spoiled) + "".join(rng.choices("abcd éx", k=90))
        symbols = decontaminate.Symbols([pattern])
        length = m + 4 * k + 8
        starts = sorted(rng.sample(range(-k, len(text)), 30)) + [150 - k]
        one = [(d, max(0, s) + e) for s in starts for d, e in [decontaminate.myers(pattern, text[max(0, s) : max(0, s + length)], k) or (k + 1, 0)] if d <= k]
        assert decontaminate.myers_windows(symbols.bits(pattern), symbols.of(text), np.array(starts), length, m, k) == (min(one) if one else None)


def test_repetitive_texts_are_verified_in_time():
    rng = random.Random(1)
    common = "the of and to a in is that it for was on with as be by this are at from".split()
    items = [(k, " ".join(rng.choices(common, k=rng.randint(5, 9))), 1) for k in range(200)]
    text = " ".join(rng.choices(common, k=11_000))
    matcher = decontaminate.Matcher(items)
    began = time.process_time()
    found = {i: d for i, d, _ in matcher.find(text)}
    assert time.process_time() - began < 2
    whole = f" {decontaminate.normalise(text)} "
    for i, t, _ in items[:40]:
        hit = decontaminate.myers(t, whole, len(t) // 12) if len(t) >= 12 else None
        assert len(t) < 12 or found.get(i) == (hit[0] if hit else None)


def test_nodes_are_told_apart_by_all_their_bits(spark):
    d = spark.createDataFrame([(1, 5, 7, 7, 0), (2, 6, 7, 7, -1), (3, 8, 7, 7, 0)], "id long, fp long, index long, five long, check long")
    links = {(r.a, r.b) for r in simhash.fingerprint_links(d, simhash.WIDE_RADIUS, simhash.WIDE_SEGMENTS, simhash.CHECK_RADIUS).collect()}
    assert links == {(5, 8)}
    texts = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "")], "id long, t string")
    rows = {r.id: r for r in simhash.wide_fingerprints(texts, F.col("t"), id=F.col("id")).collect()}
    assert rows[1].fp == rows[2].fp != rows[3].fp and rows[3].five == 0
