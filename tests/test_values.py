"""Registered queries that SQL can't state, against slow versions; audio functions; density clusters."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions import signal
from tracemill.operators import clustering, ordered
from tracemill.plans import compare_queries, evaluation_queries, registry, stream_queries  # noqa: F401


def run(spark, data, name):
    return registry.QUERIES[name](spark, data).collect()


def vectors(spark, data):
    by = defaultdict(list)
    for r in spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect():
        by[r.label].append((r.vec_id, np.array(r.embedding, float)))
    return by


def slow_linkage(v, threshold):
    """Average linkage from its definition: the nearest two groups, by the mean of all their distances, until none is near."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    groups = [[k] for k in range(len(v))]
    while len(groups) > 1:
        best = min(((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i])), key=lambda x: x[0])
        if best[0] >= threshold:
            break
        groups[best[2]] += groups.pop(best[1])
    return {frozenset(g) for g in groups}


def test_agglomerative(spark, data):
    got = defaultdict(lambda: defaultdict(set))
    used = {}
    for r in run(spark, data, "agglomerative"):
        got[r.label][r.cluster].add(r.vec_id)
        used[r.label] = r.threshold
    for label, rows in vectors(spark, data).items():
        ids, v = [i for i, _ in rows], np.array([x for _, x in rows])
        for t in sorted(clustering.LADDER, reverse=True):
            want = slow_linkage(v, t)
            if max(map(len, want)) / len(v) <= clustering.LARGEST:
                break
        assert used[label] == t
        assert {frozenset(g) for g in got[label].values()} == {frozenset(ids[k] for k in g) for g in want}


def test_density_clusters(spark, data):
    rng = np.random.default_rng(1)
    axes = np.eye(12)[:3] * 5
    dense = np.concatenate([a + rng.normal(size=(20, 12)) * 0.1 for a in axes])
    noise = rng.normal(size=(6, 12)) * 3
    got = clustering.density_clusters(np.concatenate([dense, noise]), 5)
    for k in range(3):
        assert len(set(got[20 * k : 20 * k + 20])) == 1 and got[20 * k] >= 0
    # What falls out of a chosen cluster stays its own; what falls out above is noise.
    assert len(set(got[:60])) == 3 and (got[60:] == -1).sum() >= 3
    assert (clustering.density_clusters(dense[:3], 5) == -1).all()
    # Two clusters inside a looser one: the tighter two last over more density.
    pair = np.concatenate([axes[:1] + [[0, 0.6, *[0] * 10]] + rng.normal(size=(15, 12)) * 0.02, axes[:1] - [[0, 0.6, *[0] * 10]] + rng.normal(size=(15, 12)) * 0.02, axes[1:2] + rng.normal(size=(15, 12)) * 0.02])
    assert sorted(np.bincount(clustering.density_clusters(pair, 5))) == [15, 15, 15]
    rows = run(spark, data, "density_clusters")
    assert len(rows) == len({r.vec_id for r in rows}) == spark.read.parquet(f"{data}/embeddings.parquet").count()


def matrix_merges(v):
    """Average linkage from the matrix of distances, nearest pair by nearest pair."""
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    size, found = np.ones(len(v)), []
    for _ in range(len(v) - 1):
        i, j = sorted(divmod(int(d.argmin()), len(v)))
        found.append(d[i, j])
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        row[[i, j]] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        size[i] += size[j]
    return found


def matrix_tree(u, least):
    """Core distances and the lengths of the least spanning tree, from the matrix."""
    d = np.sqrt(np.clip(2 - 2 * u @ u.T, 0, 4))
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, least - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    inside, best, out = np.zeros(len(u), bool), np.full(len(u), np.inf), []
    at = 0
    for _ in range(len(u) - 1):
        inside[at] = True
        best = np.minimum(best, reach[at])
        at = int(np.where(inside, np.inf, best).argmin())
        out.append(best[at])
    return core, sorted(out)


def test_trees_without_matrices(monkeypatch):
    rng = np.random.default_rng(5)
    for n in (2, 3, 50, 700):
        v = rng.normal(size=(n, 9)) + rng.normal(size=(6, 9))[rng.integers(0, 6, n)] * 2
        merges = clustering.average_linkage(v)
        assert np.allclose([m[2] for m in merges], matrix_merges(v)) and len(merges) == n - 1
        assert sorted(x for a, b, _ in merges for x in (a, b)) == list(range(2 * n - 2))
        u = clustering.unit_rows(v)
        monkeypatch.setattr(clustering, "DISTANCES", 1000)
        core, lengths = matrix_tree(u, 2)
        assert np.allclose(clustering.core_distances(u, 2), core)
        assert np.allclose([e[0] for e in clustering.spanning_tree(u, core)], lengths)
    same = np.repeat(rng.normal(size=(3, 5)), 40, axis=0)
    assert sorted(np.bincount(clustering.cut_tree(120, clustering.average_linkage(same), 1e-6))) == [40, 40, 40]


def test_scopes_of_many_thousands():
    rng = np.random.default_rng(6)
    v = np.repeat(np.eye(16)[:12], 1000, axis=0) + rng.normal(size=(12_000, 16)) * 0.05
    labels, _ = clustering.ladder_cut(len(v), clustering.average_linkage(v))
    assert sorted(np.bincount(labels)) == [1000] * 12
    found = clustering.density_clusters(v[::3], 20)
    assert all(len({x for x in found[k * 1000 // 3 + 1 : (k + 1) * 1000 // 3] if x >= 0}) == 1 for k in range(12)) and len(set(found[found >= 0])) == 12


def test_one_tree_many_cuts(spark):
    d = spark.range(60).select("id", F.array(F.cos(F.col("id") * F.col("id")), F.sin(F.col("id") * F.col("id"))).alias("v"), (F.col("id") % 2).alias("s"))
    many = clustering.cluster_groups(d, "id", "v", "s", (0.01, 0.2, 0.6))
    for t in (0.01, 0.2, 0.6):
        one = clustering.cluster_groups(d, "id", "v", "s", t)
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.where(F.col("threshold") == t).collect()))


def test_silhouette_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows_ = [(k, int(rng.integers(0, 40)), rng.normal(size=5).tolist()) for k in range(300)] + [(999, 77, [1.0, 0.0, 0.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows_, "key long, c int, v array<double>")
    whole = {r.key: r.silhouette for r in clustering.silhouette(d, "key", "c", "v").collect()}
    monkeypatch.setattr(clustering, "MOST_CLUSTERS", 7)
    parts = {r.key: r.silhouette for r in clustering.silhouette(d, "key", "c", "v").collect()}
    assert whole[999] == 0 and all(abs(whole[k] - parts[k]) < 1e-12 for k in whole) and len(parts) == 301


def test_running_total(spark):
    rng = np.random.default_rng(3)
    v = [(int(x), k) for k, x in enumerate(rng.integers(0, 9, 500))]
    d = ordered.running_total(spark.createDataFrame(v, "x int, k int").repartition(5), [F.desc("x"), F.asc("k")], F.col("x"), "t")
    got = [(r.x, r.k, r.t) for r in d.orderBy(F.desc("x"), "k").collect()]
    want, t = [], 0
    for x, k in sorted(v, key=lambda r: (-r[0], r[1])):
        t += x
        want.append((x, k, t))
    assert got == want


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignments(spark, data):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    got = {r.item_id: r for r in run(spark, data, "word_diff")}
    assert set(got) == {k for k in items if k + 1 in items}
    for k, r in got.items():
        a, b = items[k].split(), items[k + 1].split()
        assert (r.equal, r.removed, r.added) == (n := lcs(a, b), len(a) - n, len(b) - n)
    by = defaultdict(list)
    for r in run(spark, data, "lcs_align"):
        by[r.conv_id].append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.pos)
        a, b = [r.a_step for r in rows if r.a_step is not None], [r.b_step for r in rows if r.b_step is not None]
        assert all(r.a_step == r.b_step for r in rows if r.op == "equal")
        assert sum(r.op == "equal" for r in rows) == lcs(a, b)


def test_projections(spark, data):
    rows = [x for v in vectors(spark, data).values() for x in v]
    ids, m = [i for i, _ in rows], np.array([v for _, v in rows])
    c = m - m.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    got = {r.vec_id: (r.x, r.y) for r in run(spark, data, "pca_2d")}
    for k in range(2):
        want, have = c @ vt[k], np.array([got[i][k] for i in ids])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-6
    _, _, vt = np.linalg.svd(m, full_matrices=False)
    want = m @ vt[:8].T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    have = {r.vec_id: r.coords for r in run(spark, data, "latent_space")}
    assert np.abs(np.abs(want) - np.abs(np.array([have[i] for i in ids]))).max() < 1e-6


def test_diverse_sample(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet").orderBy("event_id").collect()
    by = defaultdict(list)
    for e in events:
        by[e.event_type].append({"id": e.event_id, "task": e.user_id % 20, "chain": e.props, "flags": e.user_id})
    got = defaultdict(list)
    for r in sorted(run(spark, data, "diverse_sample"), key=lambda r: r.pick):
        got[r.event_type].append(r.event_id)
    for kind, rows in by.items():
        picked = []
        for what in ("task", "chain", "flags", None):
            for r in rows:
                if len(picked) < 12 and r not in picked and (what is None or r[what] not in {p[what] for p in picked}):
                    picked.append(r)
        assert got[kind] == [p["id"] for p in picked]


def slow_policy(ticks, wait_other=2, wait_self=2, yield_interrupted=2, yield_interrupting=5, every=10):
    """The decision at each tick from the whole past, without a running state."""
    out, last_answer, last_back = [], -1, -1
    for n, (own, other, tool) in enumerate(ticks):
        run = lambda k: next((d for d in range(n + 1) if not ticks[n - d][k]), n + 1)  # noqa: B023, E731
        quiet = lambda k: next((d for d in range(n + 1) if ticks[n - d][k]), n + 1)  # noqa: B023, E731
        heard = any(t[1] for t in ticks[last_answer + 1 : n + 1])
        if own:
            limit = yield_interrupting if run(0) < run(1) else yield_interrupted
            action = "stop_talking" if other and run(1) >= limit else "keep_talking"
        elif tool:
            action = "generate_message"
        elif other:
            action = "wait"
            if n - last_back >= every:
                action, last_back = "backchannel", n
        elif heard and quiet(1) >= wait_other and quiet(0) >= wait_self:
            action, last_answer = "generate_message", n
        else:
            action = "wait"
        out.append(action)
    return out


def test_stateful_policy(spark, data):
    by = defaultdict(list)
    for e in spark.read.parquet(f"{data}/events.parquet").orderBy("ts", "event_id").collect():
        by[e.user_id].append((e.event_type in ("view", "signup"), e.event_type in ("click", "signup"), e.event_type == "error"))
    got = defaultdict(dict)
    for r in run(spark, data, "stateful_policy"):
        got[r.conv_id][r.tick_id] = r.action
    assert set(got) == set(by)
    for user, ticks in by.items():
        assert [got[user][n] for n in range(len(ticks))] == slow_policy(ticks)


@pytest.mark.parametrize("name", ["linearise_containment", "linearise_overlap"])
def test_linear_orders_lose_nothing(spark, data, name):
    """Whatever a side says is in the order, as that side's."""
    said = defaultdict(list)
    for r in stream_queries.ticks(registry.Tables(spark, data)).orderBy("tick_id").collect():
        said[r.conv_id, "self"] += [r.self_text] if r.self_text else []
        said[r.conv_id, "other"] += [r.other_text] if r.other_text else []
    got = defaultdict(str)
    rows = registry.QUERIES[name](spark, data)
    place = "place" if "place" in rows.columns else "pos"
    for r in sorted(rows.collect(), key=lambda r: (r["conv_id"], r[place])):
        got[r["conv_id"], r["side"]] += (r["text"] or "") + " "
    for key, words in said.items():
        have = got[key].replace(" ", "")
        assert all(have.count(w) >= 1 for w in words), key


def track(x):
    return np.asarray(x).round().astype("<i2").tobytes()


def test_audio(spark):
    rate = 8000
    t = np.arange(rate) / rate
    loud = 8000 * np.sin(2 * math.pi * 1000 * t)
    d = spark.createDataFrame([(track(loud),), (track(np.zeros(100)),), (None,)], "pcm binary")
    one = lambda c: [None if r[0] is None else np.frombuffer(bytes(r[0]), "<i2").astype(float) for r in d.select(c).collect()]
    back = one(signal.from_alaw(signal.to_alaw("pcm")))
    assert np.abs(back[0] - loud).max() <= np.abs(loud).max() / 16 and np.abs(back[1]).max() <= 8 and back[2] is None
    codes = signal._alaw(np.array([0, -1, 32767, -32768], np.int16))
    assert codes.tolist() == [0xD5, 0x55, 0xAA, 0x2A]
    every = np.arange(256, dtype=np.uint8)
    assert (signal._alaw(signal._from_alaw(every)) == every).all()
    assert abs(np.abs(one(signal.normaliser(0.5)("pcm"))[0]).max() - 16384) < 2 and not one(signal.normaliser()("pcm"))[1].any()
    level = lambda x: float(np.sqrt((x[500:-500] ** 2).mean()))
    assert level(one(signal.band_filter(rate, 300, 3400)("pcm"))[0]) > 0.9 * level(loud)
    assert level(one(signal.band_filter(rate, None, 500)("pcm"))[0]) < 0.05 * level(loud)
    burst = one(signal.burst_noise(rate, [0.2], 0.1, 10.0, 1)("pcm"))[0] - loud.round()
    assert not burst[:1600].any() and not burst[2400:].any() and 600 < np.sqrt((burst[1600:2400] ** 2).mean()) < 1400
    assert [None if r[0] is None else r[0] for r in d.select(F.octet_length(signal.padded(F.col("pcm"), 480))).collect()] == [16320, 480, None]
