"""Training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import html
import json
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from compare import check, connect
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import chat, components, decontaminate, embeddings, html_text, langid, mixing, pii, quality, queries, sharding, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 977}" for k in range(60_000))
#: Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use themselves.
ODD = [(1, "Abc def ghi jkl mno", "en", "a", 3), (1, "Abc def ghi jkl mno", "en", "a", 3), (2, None, None, None, None), (None, "x", "fr", None, 1), (3, "", "en", "b", 0), (4, LONG, "en", "a", None), (5, "Abc def ghi jkl mno", None, "b", 3), (6, "  \t\n", "de", "b", 2)]
CLASH = ("row", "bucket", "h", "size", "target", "repeats", "shard", "slot", "fp", "root", "tie", "key", "id", "score", "label", "kept", "number", "total", "k", "t")


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(ODD, DOCS)
    return d.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASH)])


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def rows(df):
    return df.collect()


# --- the registered queries ------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, data, name):
    check(queries.QUERIES[name](spark, data), queries.ORACLES[name], connect(data))


# --- 1 mixing ---------------------------------------------------------------------


def test_targets_by_rounds(spark):
    rng = random.Random(0)
    for _ in range(4):
        sizes = [(f"s{k:02d}", rng.choice([0, 10, 100, 1000, 5000])) for k in range(7)]
        d = spark.createDataFrame([(f"={s}", s, n) for s, n in sizes], "skey string, source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(d, (1, 2, 3), 3).collect()}
        weight = {s: k % 3 + 1 for k, (s, _) in enumerate(sizes)}
        total, capped = sum(n for _, n in sizes), {}
        while True:
            free = [(s, n) for s, n in sizes if s not in capped]
            left, w = total - sum(capped.values()), sum(weight[s] for s, _ in free)
            over = [(s, n) for s, n in free if left * weight[s] / w >= 3 * n]
            if not over:
                break
            capped.update({s: 3.0 * n for s, n in over})
        for s, n in sizes:
            want = capped[s] if s in capped else left * weight[s] / w
            assert math.isclose(got[s], want, rel_tol=1e-9, abs_tol=1e-9), (sizes, s)


def test_mix_by_hand(docs):
    got = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    again = {r.doc_id: r.repeats for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert {k: r.repeats for k, r in got.items()} == again
    by = {}
    for r in got.values():
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        size, target, taken = own[0].source_size, own[0].target, sum(r.taken for r in own)
        assert size == sum(r.size for r in own) and all(r.repeats <= 3 for r in own)
        assert abs(taken - target) <= max(r.size for r in own) / 2 + 1
        assert max(r.repeats for r in own) - min(r.repeats for r in own) <= 1
    assert mixing.mixed_rows(docs).count() == sum(r.repeats for r in got.values())


def test_mix_edges(odd, none):
    m = rows(mixing.mix_sources(odd))
    assert len(m) == len(ODD) and all(r.taken <= 3 * r.size for r in m)
    assert sum(r.size == 0 for r in m) == 3
    assert mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mix_sources(none).count() == 0 and mixing.mixed_rows(none).count() == 0


# --- 2 embeddings -------------------------------------------------------------------


def brute_links(vectors, threshold):
    ok = [k for k, v in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    link = {k: set() for k in range(len(vectors))}
    for i in ok:
        for j in ok:
            if i != j and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    link[i].add(j)
    comp = list(range(len(vectors)))
    for k in comp:
        seen, todo = {k}, [k]
        while todo:
            for x in link[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        comp[k] = min(seen)
    return [len(link[k]) for k in range(len(vectors))], comp


def test_embeddings_brute(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 32))
    v = [*base, *(base[:20] + rng.normal(size=(20, 32)) * 0.25), *(base[0] + rng.normal(size=(90, 32)) * 0.05), *[base[5]] * 12, *(3 * base[6:9])]
    v = [[float(np.float32(x)) for x in r] for r in v] + [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf"), *[1.0] * 31], [None, 1.0], [1.0, 2.0], [2.0, 4.0]]
    d = spark.createDataFrame([(k, x, 0) for k, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    n, comp = brute_links(v, 0.9)
    got = sorted(rows(embeddings.embedding_clusters(d)), key=lambda r: r.id)
    assert [r.n_links for r in got] == n
    assert [r.component_id for r in got] == comp
    assert [r.kept for r in got] == [k == c for k, c in enumerate(comp)]
    assert embeddings.embedding_clusters(d.where("false")).count() == 0
    ids = rows(embeddings.embedding_clusters(d.where("vec_id < 3").withColumn("vec_id", F.lit(None).cast("long"))))
    assert len(ids) == 3 and all(r.n_links == 0 and r.component_id is None for r in ids)


def test_crowded_filters_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(4)
    v = rng.normal(size=16) + rng.normal(size=(150, 16)) * 0.12
    d = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "vec_id long, embedding array<double>")
    n, comp = brute_links([list(r) for r in v], 0.9)
    got = sorted(rows(embeddings.embedding_clusters(d)), key=lambda r: r.id)
    assert [r.n_links for r in got] == n and [r.component_id for r in got] == comp


@pytest.mark.parametrize("dim,vectors,missed", [(64, 50_000, 0.002), (64, 500, 0.0), (16, 50_000, 0.005)])
def test_isolated_pairs_meet(dim, vectors, missed):
    """Random pairs at exactly the threshold share a filter of codes made for tables of that size."""
    rng = np.random.default_rng(1)
    n = 1500
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    z = rng.normal(size=(n, dim))
    z -= (z * v).sum(1, keepdims=True) * v
    w = 0.9 * v + math.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    codes = embeddings.Codes(max(16, math.isqrt(vectors * embeddings.PASSES // embeddings.PER_FILTER) + 1), 5)
    (a, fa), (b, fb) = codes.filters(v), codes.filters(w)
    assert (np.bincount(a, minlength=n) >= embeddings.PASSES * embeddings.CODES).all()
    met = len(set(zip(a.tolist(), fa.tolist())) & set(zip(b.tolist(), fb.tolist())))
    pairs = {x for x, _ in set(zip(a.tolist(), fa.tolist())) & set(zip(b.tolist(), fb.tolist()))}
    assert met > 0 and 1 - len(pairs) / n <= missed


# --- 3 html ----------------------------------------------------------------------------


def test_pages(spark, data):
    pages = rows(spark.read.parquet(f"{data}/pages.parquet"))
    for p in pages:
        body = re.search("<article>(.*?)</article>", p.html, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", body))
        assert html_text.main_text(p.html) == "\n\n".join(x for x in parts if x), p.page_id


def test_html_cases():
    f = html_text.main_blocks
    assert f(None) == [] and f("") == [] and f(" \n ") == [] and f("plain  text") == ["plain text"]
    assert f("<p>a<p>b") == ["a", "b"] and f("<p>x &amp; y&nbsp;z &#233;") == ["x & y z é"]
    page = """<body><header><h1>Site</h1></header><nav><a href=x>Menu</a></nav><div class="cookie-notice">We use cookies</div><div id=main><div class=post><h2>Title</h2>
    <p>Some <b>bold</b> text that goes on for a while, as texts do.<ul><li>one<li>two</ul><table><tr><td>a<td>b</table><p>Last<br>line</div><aside>side</aside></div>
    <section class="comments"><p>a reader's comment that is longer than the article itself, by far and by much and by more than that</section><form><p>name</form><!-- <p>no</p> --><script>var a = "</p><p>no";</script><footer>foot</footer>"""
    assert f(page) == ["Title", "Some bold text that goes on for a while, as texts do.", "one", "two", "a b", "Last line"]
    deep = "<div>" * 3000 + "<p>text</p>" + "</div>" * 3000
    assert f(deep) == ["text"]
    assert f("<p>" + "word " * 200_000)[0].count("word") == 200_000


# --- 4 simhash --------------------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs, odd):
    for r in rows(docs.limit(60)):
        assert simhash.fingerprint(r.text.encode()) == slow_fingerprint(r.text)
    assert simhash.fingerprint(None) == 0 and simhash.fingerprint("É A b".encode()) == slow_fingerprint("É A b")
    c = rows(simhash.simhash_clusters(odd))
    assert len(c) == len(ODD)
    by = {(r.id, r.fp): r.component_id for r in c}
    zero = [r for r in c if r.fp == 0]
    assert {r.id for r in zero} == {2, 3, 6} and {r.component_id for r in zero} == {2}
    assert {v for (i, _), v in by.items() if i in (1, 5)} == {1}


def test_links_brute(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base) | {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))) for b in base for _ in range(6)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(r.a, r.b) for r in rows(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long")))}
    out = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long")).count()
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    assert got == want and out == len(want) and len(want) > 100


def test_crowded_keys(spark, monkeypatch):
    """Blocks and forests keep the components of all links, for any radius that the segments answer."""
    rng = random.Random(13)
    for block, few, radius, segments in [(40, 4, 4, 2), (4096, 8, 8, 3), (40, 64, 5, 2)]:
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "FEW", few)
        base = [rng.getrandbits(64) for _ in range(12)]
        fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, radius + 3))) for b in base for _ in range(40)}
        signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
        parent = {x: x for x in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for n, a in enumerate(signed):
            for b in signed[:n]:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
        links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, segments)
        got = {r.node: r.root for r in rows(components.connected_components(links, "a", "b"))}
        assert got == {x: find(x) for x in signed if find(x) != x}


def jaccard(a, b, width=5):
    def of(t):
        w = t.lower().split()
        return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)}

    return len(of(a) & of(b)) / len(of(a) | of(b))


def test_similar_documents(spark, docs):
    """Recall and precision of the wide form against five-word shingles of edited copies."""
    rng = random.Random(14)
    texts = [r.text for r in rows(docs) if len((r.text or "").split()) > 60][:150]
    pairs, data = [], []
    for n, t in enumerate(texts):
        words = t.split()
        for at in rng.sample(range(len(words)), max(1, int(len(words) * rng.choice([0.002, 0.01, 0.018, 0.05, 0.1])))):
            words[at] = rng.choice(["other", "word", "novel", "thing"])
        pairs.append(jaccard(t, " ".join(words)))
        data += [(2 * n, t), (2 * n + 1, " ".join(words))]
    root = {r.id: r.root for r in rows(simhash.similar_clusters(spark.createDataFrame(data, "doc_id long, text string")))}
    met = [root[2 * n] == root[2 * n + 1] for n in range(len(texts))]
    like = [m for m, j in zip(met, pairs) if j >= 0.8]
    unlike = [m for m, j in zip(met, pairs) if j < 0.55]
    assert len(like) > 50 and sum(like) / len(like) >= 0.95
    assert len(unlike) > 20 and sum(unlike) / len(unlike) <= 0.1


def test_drop_near_duplicates(spark, odd, none):
    kept = rows(simhash.drop_near_duplicates(odd))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept) == [(False, 1), (False, 2), (False, 4), (True, None)]
    assert simhash.drop_near_duplicates(odd).columns == odd.columns
    assert simhash.drop_near_duplicates(none).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.root for r in rows(components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b"))}
    assert got == {x: find(x) for x in parent if find(x) != x}


# --- 5 personal data -----------------------------------------------------------------------


def slow_base(text):
    out = []
    for k, (name, pattern) in enumerate([("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": name != "ip" or all(x.lstrip("0").zfill(3) <= "255" and len(x.lstrip("0")) <= 3 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[name]
            if ok:
                out.append((m.start(), k, m.end(), name))
    return [(a, b, n) for a, _, b, n in sorted(out)]


def test_base_spans(docs):
    rng = random.Random(7)
    bits = ["a@b.c", "@", ".", "x..y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-1234", "+", "12345678901234567890", "1.2.3." + "9" * 5000, "00000.0007.1.255", "@a.b@c.d", " ", "é", "-", "9", "token = "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [r.text for r in rows(docs)]
    for t in texts:
        assert pii.base_spans(t) == slow_base(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_and_hostile_texts():
    crf = pii.train()
    hostile = ["1.2.3." + "9" * 5000, "9" * 1_000_000, "1." * 300_000, "+1" * 300_000, "a." * 300_000 + "@", "@a" * 300_000, 'token = "' + "a1" * 300_000, "1 " * 60_000, "a@b " * 30_000]
    for t in hostile:
        began = time.process_time()
        pii.find([t], crf)
        assert time.process_time() - began < 3, t[:20]


def test_crf_adds_spans(spark, docs):
    """Lines that are not in the labelled table."""
    crf = pii.train()
    fresh = [
        'her token: "[secret|0f1e2d3c4b5a69788796a5b4c3d2e1f00112233a]" , she said',
        "AUTH=[secret|Qw7Er2Ty9Ui4Op1As6Df3Gh8Jk5] then go",
        "we lost ([secret|aB3dE5fG7hI9jK1lM3nO5pQ7]) there",
        "ask [phone|(617) 555-0122] at noon",
        "the number [phone|702-555-0164] works",
        "write [email|bob7@mailhost] soon",
        "on 13.04.2019 some 120 of 4,500 came",
        "version 3.2.1 of 2022-12-01 has 14 parts",
        "it is 12:30, room 204, 50% off $20.99",
        "row 123e4567-e89b-12d3-a456-426614174000 is there",
    ]
    table = pii.labelled_table(fresh)
    for (text, want), (own, spans) in zip(table, pii.find([t for t, _ in table], crf)):
        assert own == [] and spans == want, (text, spans)
    for r in rows(docs):
        own, spans = pii.find([r.text], crf)[0]
        assert set(own) <= set(spans)
        planted = {(m.start(1), m.end(1), "secret") for m in re.finditer('token = "([0-9a-fA-F]{40})"', r.text, re.I)}
        assert set(spans) - set(own) == planted


def test_pii_query(spark, data, docs):
    """The registered query's digest columns against the slow search."""
    got = {r.doc_id: r for r in rows(queries.op5_pii(spark, data))}
    for d in rows(docs):
        want, r = slow_base(d.text or ""), got[d.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, _, x in want) for k in pii.KINDS)
        assert {f"{k}:{a}:{b}" for a, b, k in want} <= set(r.spans.split(",")) | {""}


def test_crf_decoding_is_exact():
    rng = np.random.default_rng(8)
    crf = pii.Crf(rng.normal(size=(pii.OFFSETS[-1], 3)), rng.normal(size=(3, 3)))
    f = rng.integers(0, pii.OFFSETS[-1], (12, 4))
    seq = np.array([0, 0, 0, 0, 1, 2, 2, 2, 2, 2, 3, 3])
    got = crf.decode(f, seq)
    import itertools

    for s in range(4):
        at = np.flatnonzero(seq == s)
        e = crf.emit[f[at]].sum(1)
        best = max(itertools.product(range(3), repeat=len(at)), key=lambda y: sum(e[k, y[k]] for k in range(len(at))) + sum(crf.move[y[k], y[k + 1]] for k in range(len(at) - 1)))
        assert tuple(got[at]) == best


def test_pii_edges(odd, none):
    r = rows(pii.personal_data(odd, F.col("text"), doc_id=F.col("doc_id")))
    assert len(r) == len(ODD) and all(x.spans == "" and x.base_sha256 == hashlib.sha256(b"").hexdigest() for x in r)
    assert pii.personal_data(none, F.col("text"), doc_id=F.col("doc_id")).count() == 0
    clash = pii.personal_data(odd, F.col("text"), text=F.col("text"), spans=F.lit(1), work0=F.col("id"))
    assert clash.columns[:2] == ["text", "work0"] and clash.count() == len(ODD)
    assert pii.redact("mail a@b.c now", [(5, 10, "email")]) == "mail <email> now" and pii.redact(None, []) is None


# --- 6 decontamination ------------------------------------------------------------------------


def edit_substring(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(9)
    for _ in range(200):
        p = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 60)))
        want = edit_substring(p, t)
        got = decontaminate.myers(p, t, len(p))
        assert (got[0] if got else len(p)) == want


def test_leaks_brute(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 6)))
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([1, 2, 4, 12, 20, 30, 30])] + [(7, None), (8, " . "), (9, "Ünïcode wörds, thät are some twenty four chars")]
    docs = []
    for n in range(80):
        body = [word() for _ in range(rng.randint(0, 60))]
        if n % 2:
            text = list(items[rng.choice([2, 3, 4, 5, 6, 9])][1])
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(["x", "", "yz"])
            body.insert(rng.randint(0, len(body)), "".join(text).upper() if n % 4 == 1 else "".join(text))
        docs.append((n, "  \n".join(body)))
    docs += [(None, items[5][1]), (99, None), (98, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in docs:
        t = decontaminate.normalise(t)
        for n, p in items:
            p = decontaminate.normalise(p)
            k = len(p) // decontaminate.CHARS_PER_EDIT
            if p and (f" {p} " in f" {t} " if not k else edit_substring(p, t) <= k):
                want.add((i, n))
    got = rows(decontaminate.leaks(d, b))
    assert {(r.id, r.item_id) for r in got} == want and len(got) == len(want)
    for r in got:
        t, p = decontaminate.normalise(dict(docs)[r.id]), decontaminate.normalise(dict(items)[r.item_id])
        assert r.distance == (edit_substring(p, t) if len(p) >= decontaminate.CHARS_PER_EDIT else 0)
    kept = {r.doc_id for r in rows(decontaminate.drop_leaking(d, b))}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}
    small = list(decontaminate.item_blocks(b, "item_id", "text", 60))
    assert len(small) > 3 and sorted(i for x in small for i, _, _ in x) == sorted(i for i, _ in items)


def test_leaks_by_item_type_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 30)
    d = spark.createDataFrame([(1, "so the quick brown fox did jump over it"), (2, "none of that")], "doc_id int, text string")
    items = spark.createDataFrame([("1", "the quick brown fox did jump"), ("2", "none of that"), ("2", "none of that"), (None, "brown fox did")], "item_id string, text string")
    for kind in ("int", "short", "long", "string", "decimal(5,0)"):
        got = rows(decontaminate.leaks(d, items.withColumn("item_id", F.col("item_id").cast(kind))))
        assert sorted((r.id, "" if r.item_id is None else str(r.item_id)) for r in got) == [(1, ""), (1, "1"), (2, "2"), (2, "2")]
    assert decontaminate.drop_leaking(d, items).count() == 0


def test_decontamination_edges(spark, odd, none):
    b = spark.createDataFrame([(1, "nothing of the kind is in there")], "item_id long, text string")
    assert decontaminate.drop_leaking(odd, b).count() == len(ODD) and decontaminate.drop_leaking(odd, b).columns == odd.columns
    assert decontaminate.drop_leaking(none, b).count() == 0 and decontaminate.leaks(odd, b.where("false")).count() == 0


# --- 7 chat -----------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(11)
    bits = ["</s>", "<|user|>\n", "[INST]", "\\", "\\l", "|>", "\n", "é", "<", "word ", "\\\\e"]
    turns = []
    for c in range(25):
        for k in range(rng.randint(1, 9)):
            role = "system" if k == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "to|ol<"])
            turns.append((c, k, role, None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))))
    turns += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (50, 0, None, "z"), (51, 0, "assistant", "q"), (51, 0, "assistant", "q")]
    d = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))
    stride, history = 40, 20
    w = rows(chat.chat_windows(d, stride=stride, history=history))
    by = {}
    for t in turns:
        by.setdefault(t[0], []).append((t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
    digest = {r.conv_id: r for r in rows(chat.chat_digest(chat.chat_windows(d, stride=stride, history=history)))}
    assert set(digest) == set(by)
    for c, ts in by.items():
        ts.sort()
        r = digest[c]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in ts).encode()).hexdigest() and r.n_turns == len(ts)
        loss = "".join(b for _, _, a, b in ts if a == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        own = sorted((x for x in w if x.conv_id == c), key=lambda x: x.window)
        assert r.formatted_chars == sum(len(x.formatted) for x in own)
        system = next((t for t in ts if t[2] == "system"), None)
        for x in own:
            size = [math.ceil(len(t[3]) / 4) + 4 for t in ts]
            assert x.n_turns > x.n_repeated
            if x.window > 1 and system and ts.index(system) == 0:
                assert x.formatted.startswith("<|system|>\n")
            mine = [p for p in x.formatted.split("</s>\n")[:-1]]
            assert len(mine) == x.n_turns and max(size) + stride + history + size[0] >= sum(math.ceil(len(p) / 8) for p in mine) / 4
    assert chat.chat_windows(d.where("false")).count() == 0


# --- 8 sharding ---------------------------------------------------------------------------------------


def test_permutation(spark):
    for n in (1, 2, 3, 6, 10, 97, 1000, 4096):
        got = [r.p for r in rows(spark.range(n).select(sharding.permute(F.col("id"), F.lit(n).cast("long")).alias("p")))]
        assert sorted(got) == list(range(n))
    assert got != list(range(n))


def test_shards(docs, odd, none):
    s = rows(sharding.shard_rows(docs, 40))
    by = {}
    for r in s:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = {r.doc_id: (r.shard, r.slot) for r in rows(sharding.shard_rows(docs.repartition(5), 40))}
    assert again == {r.doc_id: (r.shard, r.slot) for r in s}
    o = sharding.shard_rows(odd, 3)
    assert set(o.columns) == set(odd.columns) and sorted((r.shard, r.slot) for r in rows(o)) == sorted((k % 3, k // 3) for k in range(len(ODD)))
    assert sharding.shard_rows(none, 3).count() == 0


def test_write_shards(docs, tmp_path, spark):
    sharding.write_shards(docs, str(tmp_path / "out"), 5)
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


# --- 9 language, 10 quality -----------------------------------------------------------------------------


def test_language(spark, data, odd, none):
    out = {r.doc_id: r for r in rows(queries.op9_language(spark, "/root/testdata/sf0.01"))}
    docs = rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert all(out[d.doc_id].held_out == (d in held) for d in docs)
    assert sum(out[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out.values()) and sum(r.rejected for r in out.values()) < 0.01 * len(out)
    model = langid.learn(odd, F.col("doc_id"), F.col("text"), F.col("lang"))
    got = rows(langid.identify(odd, model, F.col("text"), doc_id=F.col("doc_id")))
    assert sorted(r.doc_id for r in got if r.lang_pred == "und") == [2, 3, 6] and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.drop_rejected(odd, model).columns == odd.columns and langid.identify(none, model, F.col("text"), doc_id=F.col("doc_id")).count() == 0
    blank = langid.learn(none, F.col("doc_id"), F.col("text"), F.col("lang"))
    assert {r.lang_pred for r in rows(langid.identify(odd, blank, F.col("text"), doc_id=F.col("doc_id")))} == {"und"}


def slow_language(model, text):
    """TF-IDF by a dictionary of trigrams and cosines one by one."""
    data = b" " + "".join(c if c.isalpha() or ord(c) >= 128 else " " for c in text.lower()).encode() + b" "
    tf = {}
    for k in range(len(data) - 2):
        a, b, c = data[k : k + 3]
        if b != 32:
            h = ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 20
            tf[h] = tf.get(h, 0) + 1
    v = {h: math.log1p(n) * float(model.idf[h]) for h, n in tf.items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    cos = [sum(x * float(c[h]) for h, x in v.items()) / norm for c in model.centroids]
    best = max(range(len(cos)), key=cos.__getitem__)
    return model.names[model.owner[best]], cos[best]


def test_language_by_definition(docs):
    model = langid.learn(docs, F.col("doc_id"), F.col("text"), F.col("lang"))
    assert len(model.owner) > len(model.names)
    for r in rows(langid.identify(docs, model, F.col("text"), text=F.col("text"), score=F.lit(1))):
        if r.lang_pred != "und":
            lang, cos = slow_language(model, r.text)
            assert lang == r.lang_pred and math.isclose(cos, r.score, abs_tol=1e-4)


def test_samples_are_bounded(spark):
    """Rows with one id or none are drawn one by one, rows that repeat once."""
    for n, key in ((3000, F.lit(None).cast("long")), (3000, F.lit(7).cast("long"))):
        d = spark.range(n).select(key.alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"), F.lit("en").alias("lang"))
        got = langid.labelled_sample(d, F.col("lang"), 600, F.col("doc_id"), F.col("text")).count()
        assert 480 < got < 720
        same = d.withColumn("text", F.lit("one text"))
        assert langid.labelled_sample(same, F.col("lang"), 600, F.col("doc_id"), F.col("text")).count() == 1


def slow_quality(net, text):
    """The network byte by byte: filters over embeddings, maxima, pooling, one probability."""
    data = text or b""
    step = quality.CHUNK - quality.OVERLAP
    n = max(1, -(-(len(data) - quality.OVERLAP) // step))
    tops = []
    for c in range(n):
        chunk = data[c * step : c * step + quality.CHUNK].ljust(quality.CHUNK, b" ")
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            best = np.maximum(best, sum(net.embed[chunk[at + k]] @ net.filters[k] for k in range(quality.WIDTH)))
        tops.append(np.maximum(best + net.bias, 0))
    z = np.concatenate([np.mean(tops, 0), np.max(tops, 0)]) @ net.weights + net.offset
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_quality_by_definition():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, int(rng.integers(1, 900)), np.uint8)) if k % 2 else bytes(rng.integers(33, 64, int(rng.integers(1, 900)), np.uint8)) for k in range(80)]
    net = quality.fit(texts, np.arange(80) % 2)
    some = [*texts[:12], None, b"", bytes(rng.integers(0, 256, 3000, np.uint8))]
    for t, got in zip(some, net.score(some)):
        assert math.isclose(got, slow_quality(net, t), abs_tol=1e-4)
    assert (net.score(texts) > 0.5).tolist() == [k % 2 == 1 for k in range(80)]
    long = [b"good words " * 200_000, b"#### 1234 " * 200_000] * 4
    assert quality.fit(long, np.array([1, 0] * 4)).constant is None


def test_trigram_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Le été und the niño 日本 " * 400
    want = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 97)
    assert (langid.counts(text) == want).all() and want.sum() > 5000


def test_quality(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    out = {r.doc_id: r for r in rows(queries.op10_quality(spark, folder))}
    labels = [r for r in rows(spark.read.parquet(f"{folder}/labels.parquet")) if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(out[r.doc_id].predicted == r.quality for r in labels) / len(labels) > 0.9
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out.values())
    net = quality.learn(odd, odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    got = rows(quality.score(odd, net, F.col("text"), doc_id=F.col("doc_id")))
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(none, net, F.col("text"), doc_id=F.col("doc_id")).count() == 0
    assert quality.learn(odd, odd.select("doc_id", F.lit(1).alias("quality"))).constant == 1.0
    assert quality.learn(none, none.select("doc_id", F.lit(1).alias("quality"))).constant == 0.5


def test_chunks_cover_everything():
    for n in (0, 1, 31, 32, 33, 255, 256, 257, 480, 481, 10_000):
        data = np.random.default_rng(n).integers(0, 256, n, np.uint8)
        c = quality.chunks(data.tobytes())
        step = quality.CHUNK - quality.OVERLAP
        whole = np.concatenate([c[0], *[x[quality.OVERLAP :] for x in c[1:]]])
        assert (whole[:n] == data).all() and (len(c) - 1) * step < max(n, 1)


# --- the pipeline --------------------------------------------------------------------------------------


#: Other languages, code and junk.
STRANGE = [
    "W czasie suszy szosa sucha, a w Szczebrzeszynie chrząszcz brzmi w trzcinie. Dzień dobry państwu, dziękuję bardzo za przyjście.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα.",
    "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "for (int i = 0; i < n; ++i) { if (a[i] > max) max = a[i]; } return max; // vec.push_back(x->ptr);" * 3,
    "qwfp zxcv jklm bnhy tgvc plok mijn uhbv ygcf txdr zesw qaxz plmk oijn bhuv gycx fdzs wqpk " * 6,
    "U2FsdGVkX19kZXZpbCBpbiB0aGUgZGV0YWlsc3F3ZXJ0eXVpb3Bhc2RmZ2hqa2x6eGN2Ym5t" * 9,
    "4711 0815 --- 12/99 @@@ 777",
]


def corpus_folder(d, data, tmp_path):
    """A folder with these documents and the other tables that the pipeline reads."""
    folder = f"{tmp_path}/tables"
    d.write.parquet(f"{folder}/documents.parquet")
    d.sparkSession.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline(spark, data, docs, tmp_path):
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mix", "shards"]
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    foreign = spark.createDataFrame([(10**6 + k, t, None, "src0", len(t)) for k, t in enumerate(STRANGE)], docs.schema).collect()
    d = docs.unionByName(spark.createDataFrame(foreign, docs.schema))
    folder = corpus_folder(d, data, tmp_path)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows(d)
        d = stage(spark, d, data).cache()
        after = rows(d)
        assert d.columns == docs.columns
        ids = {r.doc_id for r in after}
        assert len(after) != len(before), name
        if name == "language":
            # What was put in goes, what is clean stays.
            assert ids == {r.doc_id for r in before} - {r.doc_id for r in foreign}
        elif name == "near_duplicates":
            fps = [simhash.wide_fingerprint(r.text.encode()) for r in after]
            bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
            assert all(bits(a[1], b[1]) + bits(a[2], b[2]) > 0 for k, a in enumerate(fps) for b in fps[:k])
            texts = {r.doc_id: r.text for r in before}
            gone = [i for i in texts if i not in ids]
            assert gone and all(max(jaccard(texts[i], t) for j, t in texts.items() if j != i) > 0.4 for i in gone)
            assert all(jaccard(a.text, b.text) < 0.85 for k, a in enumerate(after) for b in after[:k] if bits(simhash.wide_fingerprint(a.text.encode())[1], simhash.wide_fingerprint(b.text.encode())[1]) < 24)
        elif name == "decontamination":
            m = decontaminate.Matcher([(r.item_id, r.text) for r in rows(items)])
            assert ids == {r.doc_id for r in before if not m.find(r.text)}
        else:
            assert {r.doc_id for r in after} <= {r.doc_id for r in before} and len(after) > len(ids) * 0.8
    out = rows(corpus_pipeline.run(spark, folder))
    assert sorted((r.shard, r.slot) for r in out) == sorted((k % 40, k // 40) for k in range(len(out)))
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in rows(d))


def test_pipeline_edges(spark, odd, none, data):
    for d in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, data)
            assert out.count() <= 3 * len(ODD)


def test_json_of_windows(spark, data):
    """Windows can be written as lines of JSON and read again."""
    w = chat.chat_windows(spark.read.parquet(f"{data}/conversations.parquet"))
    r = w.select(F.to_json(F.struct(*w.columns)).alias("j")).first()
    assert json.loads(r.j)["formatted"]
