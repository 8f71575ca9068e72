"""Operators by value, on small inputs."""

import itertools
import json
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracemill.functions import signal, text, values
from tracemill.operators import clustering, compare, dml, guards, joins, metrics, ordered, predicates, retrieval, statediff, traces
from tracemill.sources import files, results


def one(df):
    return df.collect()[0]


# --- predicates -----------------------------------------------------------------


def matches(op, actual, expected):
    """The rule in plain words, for one value."""
    try:
        return {
            "eq": lambda: actual == expected,
            "ne": lambda: actual != expected,
            "gt": lambda: actual > expected,
            "gte": lambda: actual >= expected,
            "lt": lambda: actual < expected,
            "lte": lambda: actual <= expected,
            "contains": lambda: actual is not None and expected in actual,
            "startswith": lambda: actual is not None and str(actual).startswith(str(expected)),
            "endswith": lambda: actual is not None and str(actual).endswith(str(expected)),
            "in": lambda: actual in expected,
            "nin": lambda: actual not in expected,
        }[op]()
    except TypeError:
        return False


def test_predicate_matrix(spark):
    rows = [(1, "ab", 5, True, ["x"]), (2, None, None, None, None), (3, "b", 0, False, []), (4, "", -2, True, ["y", "x"])]
    df = spark.createDataFrame(rows, "id int, s string, n int, b boolean, a array<string>")
    cases = [(f, op, v) for f in ("s", "n", "b") for op in predicates.OPERATORS[:6] for v in (None, "ab", 5, 0, True)]
    cases += [("s", op, v) for op in ("contains", "startswith", "endswith") for v in ("b", "")] + [("a", "contains", "x"), ("n", "contains", "x"), ("n", "endswith", 2), ("b", "startswith", "T")]
    cases += [(f, op, v) for f in ("s", "n") for op in ("in", "nin") for v in (["ab", 5], [None], [])]
    cond = [predicates.compile_constraints(df.schema, {f"{f}__{op}": v}).alias(str(k)) for k, (f, op, v) in enumerate(cases)]
    got = df.select("s", "n", "b", "a", *cond).collect()
    for r in got:
        for k, (f, op, v) in enumerate(cases):
            assert r[str(k)] == matches(op, r[f], v), (f, op, v, r[f])


def test_constraint_split_and_catalog(spark):
    assert predicates.split_constraint("a__b__gt") == ("a__b", "gt")
    assert predicates.split_constraint("a__like") == ("a", "eq")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, `a__b` string")
    c = predicates.Catalog({"t": df})
    assert c.query("nothing", {}) is None
    assert [r.id for r in c.query_json("t", '{"a__b__eq": "y"}').collect()] == [2]
    assert c.query("t", {}, order=["id"], limit=1).count() == 1
    with pytest.raises(ValueError):
        c.query_json("t", "[1]")
    with pytest.raises(ValueError):
        predicates.routed_lookup({"L": (df, "id")}, "X1")


def test_nested_items(spark):
    df = spark.createDataFrame([("p", {"i": 1, "j": 2})], "pid string, m map<string,int>")
    assert sorted(map(tuple, predicates.nested_items(df, "m", "pid").collect())) == [("p", "i", 1), ("p", "j", 2)]


# --- metrics -----------------------------------------------------------------------


def test_pass_hat_k_equals_binomials(spark):
    rows = [(n, c) for n in range(1, 9) for c in range(n + 1)]
    df = spark.createDataFrame(rows, "n int, c int")
    for k in (1, 2, 3, 5):
        for r in df.select("n", "c", metrics.pass_hat_k(F.col("n"), F.col("c"), k).alias("p")).collect():
            assert r.p is None if r.n < k else math.isclose(r.p, math.comb(r.c, k) / math.comb(r.n, k), abs_tol=1e-12)


RUN = """run_id string, task_id string, reward double, termination_reason string, agent_cost double, auth_status string, had_unresponsive_period boolean,
reward_info struct<reward:double,reward_basis:array<string>,reward_breakdown:map<string,double>,db_check:struct<db_match:boolean>,action_checks:array<struct<tool_type:string,action_match:boolean>>,
env_assertions:array<struct<met:boolean>>,communicate_checks:array<struct<met:boolean>>,nl_assertions:array<struct<nl_assertion:string,met:boolean>>>"""


def run_rows():
    info = lambda reward, basis, breakdown, db=None, acts=None, nl=None: {"reward": reward, "reward_basis": basis, "reward_breakdown": breakdown, "db_check": None if db is None else {"db_match": db}, "action_checks": acts, "env_assertions": None, "communicate_checks": None, "nl_assertions": nl}
    act = [{"tool_type": "read", "action_match": True}, {"tool_type": "write", "action_match": False}]
    return [
        ("pass", "t1", 1.0, "user_stop", 0.5, "succeeded", False, info(1.0, ["DB"], {"DB": 1.0}, True, act)),
        ("db", "t1", 0.0, "agent_stop", 0.25, "failed", True, info(0.0, ["DB"], None, False, act)),
        ("nl", "t2", 0.0, "user_stop", None, "not_needed", None, info(0.0, ["NL_ASSERTION"], None, None, None, [{"nl_assertion": "Refund $5 to #W1", "met": False}])),
        ("mixed", "t2", 0.0, None, 1.0, None, None, info(0.0, ["DB", "NL_ASSERTION"], {"DB": 0.0, "NL_ASSERTION": 0.0})),
        ("steps", "t3", 0.0, "max_steps", 1.0, None, None, info(0.0, ["DB"], {"DB": 0.0})),
        ("none", "t3", None, "too_many_errors", 1.0, None, None, None),
        ("infra", "t3", 0.0, "infrastructure_error", 1.0, None, None, None),
    ]


def test_metric_bundle_and_failure_classes(spark):
    runs = spark.createDataFrame(run_rows(), RUN)
    b = one(metrics.metric_bundle(runs))
    assert (b.total_simulations, b.infra_error_count, b.total_tasks) == (6, 1, 3)
    assert (b.total_read_actions, b.correct_read_actions, b.total_write_actions, b.correct_write_actions) == (2, 2, 2, 0)
    assert (b.db_match_count, b.db_mismatch_count, b.db_not_checked) == (1, 1, 4)
    assert (b.auth_succeeded, b.auth_failed, b.auth_not_needed, b.auth_not_checked) == (1, 1, 1, 3)
    assert (b.termination_user_stop, b.termination_agent_stop, b.termination_max_steps, b.termination_error) == (2, 1, 1, 1)
    assert (b.sims_with_responsiveness_info, b.sims_with_unresponsive_period) == (2, 1)
    assert math.isclose(b.avg_agent_cost, (0.5 + 0.25 + 1 + 1 + 1) / 5)
    got = {r.run_id: r.f for r in runs.select("run_id", traces.failure_class(F.col("reward_info"), F.col("termination_reason")).alias("f")).collect()}
    assert got == {"pass": "pass", "db": "db_only", "nl": "nl_only", "mixed": "mixed", "steps": "termination", "none": "termination", "infra": "termination"}
    assert metrics.evaluated(runs).count() == 6
    assert metrics.action_rows(runs, "run_id").count() == 4
    assert [r.s for r in runs.where("run_id = 'nl'").select(traces.nl_signature(F.col("reward_info")).alias("s")).collect()] == ["refund to"]


def test_severity_histograms(spark):
    e = spark.createDataFrame([("agent", None, ["a", "b"]), ("agent", "critical", ["a"]), ("user", "minor", [])], "source string, severity string, error_tags array<string>")
    assert {tuple(r) for r in metrics.severity_histogram(e, "source").collect()} == {("agent", "unknown", 1), ("agent", "critical", 1), ("user", "minor", 1)}
    assert {tuple(r) for r in metrics.tag_histogram(e).collect()} == {("a", "unknown", 1), ("b", "unknown", 1), ("a", "critical", 1)}


def test_rewards(spark):
    d = spark.range(1).select(metrics.product_of(F.array(F.lit(0.5), F.lit(0.5))).alias("p"), metrics.product_of(F.array().cast("array<double>")).alias("e"), metrics.all_true(F.array(F.lit(True), F.lit(None).cast("boolean"))).alias("a"))
    assert tuple(one(d)) == (0.25, 1.0, 0.0)


# --- traces ---------------------------------------------------------------------------

MESSAGES = "run_id string, pos int, role string, content string, calls array<struct<id:string,name:string>>, tool_call_id string, error boolean"


def test_features(spark):
    m = [
        ("db", 0, "user", "hello", None, None, None),
        ("db", 1, "assistant", None, [("c1", "find_user"), ("c2", "find_user")], None, None),
        ("db", 2, "tool", "Error: user not found #9", None, "c1", True),
        ("db", 3, "user", "Yes, go ahead", None, None, None),
        ("db", 4, "assistant", None, [("c1", "cancel_order")], None, None),
        ("db", 5, "tool", "ok", None, "c1", False),
        ("db", 6, "assistant", '{"message": "Done with #W12 for $5"}', None, None, None),
    ]
    runs = spark.createDataFrame([r for r in run_rows() if r[0] in ("db", "pass")], RUN)
    diffs = spark.createDataFrame([("db", "wrong:orders.*.status", ["wrong"])], "run_id string, db_signature string, db_kinds array<string>")
    f = {r.run_id: r for r in traces.features(runs, spark.createDataFrame(m, MESSAGES), ["cancel_order"], ["find_user"], diffs).collect()}
    d = f["db"]
    assert d.tool_chain == ["find_user", "cancel_order"] and d.write_chain == ["cancel_order"]
    assert d.auth_before_mutate is True and d.confirm_before_write is True and d.single_tool_per_turn is False and d.num_env_errors == 1
    assert d.tool_errors == ["error user not found"] and d.last_message == "done with for"
    assert d.mechanism == "wrong_params" and d.signature == "db=wrong:orders.*.status"
    assert d.embedding_text == "failure_type=db_only | tools=find_user,cancel_order | flags=auth_ok,confirm_ok,multi_tool_turn,env_errors=1 | termination=agent_stop | db_diff=wrong:orders.*.status"
    assert f["pass"].mechanism == "pass" and f["pass"].embedding_text.startswith("failure_type=pass | tools=none | flags=none")
    seq = traces.tool_sequence(spark.createDataFrame(m, MESSAGES)).orderBy("seq").collect()
    assert [(r.name, r.turn, r.error) for r in seq] == [("find_user", 0, True), ("find_user", 0, False), ("cancel_order", 1, False)]


# --- state --------------------------------------------------------------------------------


@pytest.mark.parametrize("g,p,want", [("s1", "s0", "missed:orders.*.status"), ("s1", "s2", "wrong:orders.*.status"), ("s0", "s1", "extra:orders.*.status"), ("s1", "s1", "no_db_diff")])
def test_state_goldens(spark, g, p, want):
    state = lambda s: json.dumps({"orders": {"o1": {"status": s}}})
    df = spark.createDataFrame([(1, state("s0"), state(g), state(p))], "k int, i string, g string, p string")
    d = statediff.three_way(df, "k", "i", "g", "p")
    assert one(statediff.signatures(d, df, "k", ["orders", "status"])).db_signature == want


def brute_diff(path, i, g, p, out):
    no = object()
    if g is no or p is no:
        return
    if g == p and type(g) is type(p):
        return
    if isinstance(g, dict) and isinstance(p, dict):
        for k in set(g) | set(p):
            step(path + [k], i.get(k, ...) if isinstance(i, dict) else ..., g.get(k, ...), p.get(k, ...), out)
    elif isinstance(g, list) and isinstance(p, list):
        at = lambda x, n: x[n] if isinstance(x, list) and n < len(x) else ...
        for k in range(max(len(g), len(p))):
            step(path + [f"[{k}]"], at(i, k), at(g, k), at(p, k), out)
    else:
        out.add((tuple(path), kind(i, g, p)))


def kind(i, g, p):
    return "missed" if p == i and g != i else "extra" if p != i and g == i else "wrong"


def step(path, i, g, p, out):
    if g is ... or p is ...:
        if g is not p:
            out.add((tuple(path), kind(i, g, p)))
    else:
        brute_diff(path, i, g, p, out)


def test_state_diff_random(spark):
    rng = random.Random(4)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["a", "b", "c"])
        if rng.random() < 0.3:
            return [tree(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice("xyz"): tree(depth - 1) for _ in range(rng.randint(0, 3))}

    rows = [(k, *[tree(3) for _ in range(3)]) for k in range(40)]
    df = spark.createDataFrame([(k, *map(json.dumps, x)) for k, *x in rows], "k int, i string, g string, p string")
    got = {}
    for r in statediff.three_way(df, "k", "i", "g", "p").collect():
        got.setdefault(r.k, set()).add((tuple(r.path), r.kind))
    for k, i, g, p in rows:
        want = set()
        step([], i, g, p, want)
        assert got.get(k, set()) == want, (k, i, g, p)


def test_replay(spark):
    calls = spark.createDataFrame([(1, 1, "set", '{"v": 2}', "2"), (1, 2, "look", "{}", '"never"'), (1, 3, "set", '{"v": 3}', None)], "k int, pos int, name string, arguments string, response string")
    initial = spark.createDataFrame([(1, '{"v": 0}'), (2, '{"v": 9}')], "k int, state string")

    def reducer(state, name, args):
        state["v"] = args["v"]
        return args["v"]

    got = {r.k: (json.loads(r.state), r.applied) for r in statediff.replay(calls, initial, "k", reducer, ["set"]).collect()}
    assert got == {1: ({"v": 3}, 2), 2: ({"v": 9}, 0)}
    bad = calls.withColumn("response", F.lit("7"))
    with pytest.raises(PySparkException):
        statediff.replay(bad, initial, "k", reducer, ["set"]).collect()
    a = initial.withColumn("user", F.lit("u"))
    assert [r.db_match for r in statediff.end_states_equal(a, a.withColumn("user", F.when(F.col("k") == 1, "u").otherwise("w")), "k", ["state", "user"]).orderBy("k").collect()] == [True, False]


# --- clusters ------------------------------------------------------------------------------


def slow_linkage(vectors, threshold):
    u = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    d = 1 - u @ u.T
    groups = [[k] for k in range(len(vectors))]
    while len(groups) > 1:
        best = min(((np.mean([d[a, b] for a in x for b in y]), i, j) for (i, x), (j, y) in itertools.combinations(enumerate(groups), 2)))
        if best[0] >= threshold:
            break
        groups[best[1]] += groups.pop(best[2])
    label = np.zeros(len(vectors), int)
    for n, g in enumerate(sorted(groups, key=min)):
        label[g] = n
    return label


def test_average_linkage():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(c, 0.3, (8, 4)) for c in (np.array([1, 0, 0, 0]), np.array([0, 1, 0, 0]), np.array([0, 0, 1, 1]))])
    merges = clustering.average_linkage(v)
    for t in (0.2, 0.4, 0.7):
        assert (clustering.cut_tree(len(v), merges, t) == slow_linkage(v, t)).all()
    labels, t = clustering.ladder_cut(len(v), merges)
    assert np.bincount(labels).max() / len(v) <= clustering.LARGEST
    d = clustering.density_clusters(v, 4)
    assert len(set(d[d >= 0])) == 3


def test_lcs():
    rng = random.Random(1)
    for _ in range(50):
        a, b = [rng.choice("abc") for _ in range(rng.randint(0, 7))], [rng.choice("abc") for _ in range(rng.randint(0, 7))]
        ops = compare.lcs_pairs(a, b)
        assert [i for _, i, _ in ops if i is not None] == list(range(len(a))) and [j for _, _, j in ops if j is not None] == list(range(len(b)))
        common = max(len(s) for n in range(len(a) + 1) for s in itertools.combinations(a, n) if is_sub(s, b))
        assert sum(op == "equal" for op, _, _ in ops) == common


def is_sub(s, b):
    it = iter(b)
    return all(x in it for x in s)


# --- retrieval ----------------------------------------------------------------------------------


def test_retrieval_edges(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c c d"), (3, "a(")], "id int, text string")
    q = spark.createDataFrame([(1, "zzz"), (2, "  "), (3, "c")], "qid int, q string")
    d = retrieval.bm25_top_k(docs, q, 5, "id", "text", "qid", "q").collect()
    assert sorted((r.query, r.doc) for r in d if r.query == 1) == [(1, 1), (1, 2), (1, 3)]
    assert not [r for r in d if r.query == 2]
    assert [r.doc for r in d if r.query == 3 and r["rank"] == 1] == [2]
    assert [r.doc for r in retrieval.grep(docs, "id", "text", "A(").collect()] == [3]
    with pytest.raises(PySparkException):
        retrieval.bm25_index(docs.withColumn("text", F.lit(None).cast("string")), "id", "text")["terms"].collect()
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0])], "id int, v array<double>")
    top = retrieval.cosine_top_k(v, "id", "v", v.where("id = 1"), "id", "v", 3).orderBy("rank").collect()
    assert [(r.doc, r.score) for r in top] == [(3, 1.0), (1, 1.0), (2, 0.0)]


def test_cosine_cells_random(spark, monkeypatch):
    """Several cells against a plain loop: ties, copies, null, zero, short and unsound vectors, null ids."""
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    rng = random.Random(5)
    rows = [(k, [float(rng.randint(-2, 2)) for _ in range(3)]) for k in range(90)]
    rows += [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, 2.0]), (103, [float("nan"), 1.0, 0.0]), (104, [None, 1.0, 1.0]), (105, []), (None, [1.0, 1.0, 1.0])]
    rows += [(200 + k, [1.0, 1.0, 1.0]) for k in range(40)]

    def cos(a, b):
        if not a or not b or len(a) != len(b) or any(x is None or x != x for x in a + b) or not any(a) or not any(b):
            return 0.0
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))

    d = spark.createDataFrame(rows, "id long, v array<double>").withColumn("score", F.lit("clash"))
    q = d.where("id % 5 = 0")
    got = {}
    for r in retrieval.cosine_top_k(d, "id", "v", q, "id", "v", 6).collect():
        got.setdefault(r.query, []).append((r["rank"], round(r.score, 6) + 0.0, r.doc))
    for i, v in rows:
        if i is None or i % 5:
            continue
        want = sorted(((round(cos(v, u), 6) + 0.0, -1 if j is None else j) for j, u in rows), reverse=True)[:6]
        assert [(s, -1 if j is None else j) for _, s, j in sorted(got[i])] == want
    assert retrieval.cosine_top_k(d.limit(0), "id", "v", q, "id", "v", 6).count() == 0
    assert retrieval.cosine_top_k(d, "id", "v", q.limit(0), "id", "v", 6).count() == 0


def test_sparse_cosine_random(spark, monkeypatch):
    """Several cells against a plain loop; null ids have no pairs."""
    monkeypatch.setattr(clustering, "CELL", 50)
    rng = random.Random(6)
    docs = {k: {f"t{int(rng.random() ** 2 * 12)}": rng.random() + 0.1 for _ in range(rng.randint(1, 8))} for k in range(40)}
    w = spark.createDataFrame([(k, t, x) for k, d in docs.items() for t, x in d.items()] + [(None, "t0", 1.0)], "doc long, term string, weight double")
    got = {(r.query, r.doc): r.score for r in clustering.sparse_cosine(w, w.where("doc % 3 = 0")).collect()}
    want = {(a, b): sum(docs[a][t] * docs[b][t] for t in docs[a].keys() & docs[b].keys()) for a in docs if a % 3 == 0 for b in docs if a != b and docs[a].keys() & docs[b].keys()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert clustering.sparse_cosine(w.limit(0), w).count() == 0
    assert clustering.sparse_cosine(w, w.limit(0)).count() == 0


def test_cells_in_steps(monkeypatch):
    """A cell taken in many small steps gives what one step gives."""
    rng = np.random.default_rng(7)
    d = pa.table({"doc": pa.array(rng.permutation(60)), "v": pa.array(rng.integers(-1, 2, (60, 2)).astype(float).tolist())})
    q = pa.table({"query": pa.array(range(9)), "v": pa.array(rng.integers(-1, 2, (9, 2)).astype(float).tolist())})
    w = pa.table({"doc": pa.array(rng.integers(0, 20, 300)), "term": pa.array([f"t{x}" for x in rng.integers(0, 9, 300)]), "weight": rng.random(300)})
    asked = w.slice(0, 80).rename_columns(["query", "asked", "qw"])
    rows = lambda t: sorted(tuple(round(x, 9) for x in r.values()) for r in t.to_pylist())
    best, pairs = rows(retrieval._best_of_cell(d, q, 5, 6)), rows(clustering._cosines_of_cell(w, asked))
    for size in (1, 7, 33):
        monkeypatch.setattr(retrieval, "STRIDE", size)
        monkeypatch.setattr(clustering, "CELL", size)
        assert rows(retrieval._best_of_cell(d, q, 5, 6)) == best and len(best) == 45
        assert rows(clustering._cosines_of_cell(w, asked)) == pairs
    want = {}
    for x in w.to_pylist():
        for y in asked.to_pylist():
            if x["term"] == y["asked"] and x["doc"] != y["query"]:
                want[y["query"], x["doc"]] = want.get((y["query"], x["doc"]), 0) + x["weight"] * y["qw"]
    assert [(a, b) for a, b, _ in pairs] == sorted(want) and all(abs(want[a, b] - s) < 1e-8 for a, b, s in pairs)


# --- joins, tables, guards -------------------------------------------------------------------------


def test_overlap_join_random(spark):
    rng = random.Random(2)
    mk = lambda n: [(rng.randint(0, 2), k, s, s + rng.randint(0, 30)) for k in range(n) for s in [rng.randint(0, 100)]]
    a, b = mk(60), mk(60)
    sch = "k int, i int, start int, end int"
    x, y = spark.createDataFrame(a, sch), spark.createDataFrame(b, sch)
    got = sorted((r.k, r.a_i, r.b_i) for r in joins.overlap_join(x, y, ["k"], 7).collect())
    assert got == sorted((p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3])
    got = sorted((r.k, r.a_i, r.b_i) for r in joins.overlap_join(x, y, ["k"], 7, contained=True).collect())
    assert got == sorted((p[0], p[1], q[1]) for p in a for q in b if p[0] == q[0] and q[2] <= p[2] and p[3] <= q[3])


def test_merge_maps_and_update(spark):
    d = spark.range(1).select(dml.merge_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3), F.lit("c"), F.lit(4))).alias("m"))
    assert one(d).m == {"a": 1, "b": 3, "c": 4}
    base = spark.createDataFrame([(1, "x")], "id int, v string")
    assert dml.append_ledger(base, base.withColumn("id", F.lit(0)), "id").count() == 2


def test_booking_guard(spark):
    b = spark.createDataFrame(
        [(1, ["f1"], 2, True, 1, [("card", 310.0)]), (2, ["f1", "f2"], 1, False, 0, [("gift", 60.0), ("gift", 90.0)]), (3, ["f2"], 9, False, 0, []), (4, ["f1"], 1, False, 0, [("gift", 100.0)])],
        "booking_id int, flights array<string>, passengers int, insured boolean, paid_bags int, payments array<struct<method:string,amount:double>>",
    )
    seats = spark.createDataFrame([("f1", 5, 100.0), ("f2", 3, 50.0)], "flight string, available int, price double")
    bal = spark.createDataFrame([("gift", 95.0)], "method string, balance double")
    assert {r.booking_id: r.rule for r in guards.booking_guard(b, seats, bal).collect()} == {1: "ok", 2: "ok", 3: "no_seats", 4: "balance"}


def test_activation_and_closure(spark):
    req = spark.createDataFrame([(1, "1234", "123", "01/27", "new", "a1"), (2, "12", "123", "01/27", "new", "a1"), (3, "1234", "123", "13/27", "new", "a1"), (4, "1234", "123", "01/27", "lost", "a1"), (5, "1234", "123", "01/27", "new", "a2"), (6, "1234", "123", "01/27", "new", "zz")], "request_id int, last4 string, cvv string, expiry string, issue_reason string, account_id string")
    acc = spark.createDataFrame([("a1", "open"), ("a2", "closed")], "account_id string, status string")
    got = {r.request_id: r.rule for r in guards.activation_guard(req, acc, {"new": "activate_new", "lost": "activate_lost"}, "activate_new").collect()}
    assert got == {1: "ok", 2: "last4", 3: "expiry", 4: "wrong_tool", 5: "account_not_open", 6: "ok"}
    a = spark.createDataFrame([("a", "t", "12/20/2025", 25.0), ("b", "t", "01/01/2020", 0.0), ("c", "t", "n/a", 25.0)], "account_id string, account_type string, date_opened string, balance double")
    w = spark.createDataFrame([("t", 90, 25.0)], "account_type string, window_days int, early_fee double")
    assert {r.account_id: (r.fee, r.may_close) for r in guards.closure_fee(a, w, "2026-01-01").collect()} == {"a": (25.0, True), "b": (0.0, True), "c": (25.0, True)}


def test_network_search(spark):
    rows = [("active", False, False, True, "4g_5g_preferred", {"5G": "none", "4G": "good"}), ("active", False, False, True, "4g_5g_preferred", {"5G": "fair"}), ("active", False, False, True, "3g_only", {}), ("missing", False, False, True, "4g_only", {"4G": "good"}), ("active", True, False, True, "4g_only", {"4G": "good"}), ("active", False, True, True, "4g_only", {"4G": "good"})]
    d = spark.createDataFrame(rows, "sim string, airplane_mode boolean, apn_broken boolean, line_active boolean, preference string, signals map<string,string>")
    got = [tuple(r.s) for r in d.select(guards.network_search(F.struct("*")).alias("s")).collect()]
    assert got == [("connected", "4G", "good"), ("connected", "5G", "fair"), ("connected", "3G", "none")] + [("no_service", "none", "none")] * 3
    ok = dict(airplane_mode=False, signal="good", status="connected", is_abroad=True, roaming_enabled=True, roaming_allowed=True, data_enabled=True, usage_exceeded=False)
    for change, want in [({}, True), ({"roaming_allowed": False}, False), ({"usage_exceeded": True}, False), ({"signal": "none"}, False), ({"is_abroad": False, "roaming_enabled": False}, True)]:
        row = spark.createDataFrame([tuple({**ok, **change}.values())], "airplane_mode boolean, signal string, status string, is_abroad boolean, roaming_enabled boolean, roaming_allowed boolean, data_enabled boolean, usage_exceeded boolean")
        assert one(row.select(guards.mobile_data_works(F.struct("*")).alias("w"))).w is want


# --- functions ---------------------------------------------------------------------------------------


def test_text_functions(spark):
    d = spark.createDataFrame([("say ```json\n{\"a\": 1}\n``` now", "<s>one</s> x <s a='1'>two</s>", "Some File: v2?.txt")], "j string, x string, f string")
    r = one(d.select(text.json_in(F.col("j")).alias("j"), text.xml_texts(F.col("x"), "s").alias("x"), text.file_name(F.col("f")).alias("f"), text.insert_words(F.lit("a b c d e"), F.lit("um"), F.lit(1)).alias("i")))
    assert json.loads(r.j) == {"a": 1} and r.x == ["one", "two"] and r.f == "Some_File__v2_.txt" and sorted(r.i.split()) == sorted("a b c d e um".split())
    with pytest.raises(PySparkException):
        d.select(text.captured(F.col("f"), r"zz(\d)")).collect()
    assert values.calculator("(1 + 2) * 3 / 4") == 2.25
    with pytest.raises(ValueError):
        values.calculator("__import__('os')")


def test_mulaw_round_trip(spark):
    pcm = np.array([0, 100, -100, 5000, -5000, 32000, -32000], "<i2").tobytes()
    d = spark.createDataFrame([(bytearray(pcm),)], "b binary").select(signal.to_mulaw("b").alias("m")).select("m", signal.from_mulaw("m").alias("b"))
    r = one(d)
    back = np.frombuffer(bytes(r.b), "<i2").astype(int)
    assert len(r.m) == 7 and (np.abs(back - np.frombuffer(pcm, "<i2")) <= np.maximum(8, np.abs(np.frombuffer(pcm, "<i2").astype(int)) // 16)).all()
    lost = signal.loss_chain(200_000, 0.1, 200, 3)
    assert abs(np.mean(lost) - 0.1) < 0.01


# --- sources ------------------------------------------------------------------------------------------


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "title": "t", "content": "c"}]')
    (tmp_path / "b.txt").write_text("hello\nworld")
    (tmp_path / "c.toml").write_text('[x]\ny = 1\n')
    (tmp_path / "d.yaml").write_text("x: {y: 2}\n")
    assert files.load_file(spark, f"file://{tmp_path}/a.json").count() == 1
    assert one(files.load_file(spark, f"{tmp_path}/b.txt")).value == "hello\nworld"
    assert json.loads(one(files.load_file(spark, f"{tmp_path}/c.toml")).json) == {"x": {"y": 1}}
    assert json.loads(one(files.load_file(spark, f"{tmp_path}/d.yaml")).json) == {"x": {"y": 2}}
    with pytest.raises(ValueError):
        files.load_file(spark, "x.bin")
    assert [p.rsplit("/", 1)[1] for p in files.expand_paths(spark, [str(tmp_path), f"{tmp_path}/a*"], ".json")] == ["a.json"]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "x.wav").write_bytes(files.wav_bytes(b"\x01\x00\x02\x00", 1, 8000))
    w = one(files.read_wav(spark, f"{tmp_path}/w"))
    assert (w.channels, w.rate, w.bits, bytes(w.samples)) == (1, 8000, 16, b"\x01\x00\x02\x00")
    docs = files.read_documents(spark, f"{tmp_path}/a.json")
    files.export_documents(docs, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/index").count() == 1
    (tmp_path / "l.log").write_text("2026-01-01 10:00:00 start\nnothing\n2026-01-01 10:00:02 sent 320 bytes\nreward=0.5\n")
    log = files.scan_log(spark, f"{tmp_path}/l.log").orderBy("pos").collect()
    assert log[2].bytes == 320 and log[3].reward == 0.5 and log[0].next_audio == log[2].pos


def test_results(spark, tmp_path):
    (tmp_path / "simulations").mkdir()
    (tmp_path / "index").mkdir()
    for k in ("r1", "r2"):
        (tmp_path / "simulations" / f"{k}.json").write_text(json.dumps({"id": k, "task_id": "t", "reward": 1.0}))
        (tmp_path / "index" / f"{k}.json").write_text(json.dumps({"id": k}))
    schema = "id string, task_id string, reward double"
    assert results.detect_format(spark, str(tmp_path)) == "dir"
    assert results.load_runs(spark, str(tmp_path), schema).count() == 2
    (tmp_path / "index" / "r3.json").write_text('{"id": "r3"}')
    with pytest.raises(ValueError, match="r3"):
        results.load_runs(spark, str(tmp_path), schema)
    (tmp_path / "all.json").write_text(json.dumps({"simulations": [{"id": "a", "task_id": "t", "reward": 0.0}]}))
    assert results.load_runs(spark, f"{tmp_path}/all.json", schema).count() == 1


def test_resume_and_trim(spark):
    runs = spark.createDataFrame([("a", 0, 1, "user_stop"), ("a", 1, 1, "infrastructure_error"), ("b", 0, 1, None)], "task_id string, trial int, seed int, termination_reason string")
    old = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("gone", "h")], "task_id string, hash string")
    new = spark.createDataFrame([("a", "h1"), ("b", "other"), ("c", "h3")], "task_id string, hash string")
    r = results.resume(runs, old, new, 2)
    assert r["kept"].count() == 2
    assert {tuple(x) for x in r["conflicts"].collect()} == {("b", "modified"), ("gone", "removed")}
    assert {tuple(x) for x in r["todo"].collect()} == {("a", 1), ("b", 1), ("c", 0), ("c", 1)}
    assert results.append_checkpoint(runs, runs).count() == 3
    assert results.replace_checkpoint(runs, runs.where("task_id = 'a'").withColumn("termination_reason", F.lit("x"))).where("termination_reason = 'x'").count() == 2
    m = spark.createDataFrame([("r", 0, "x" * 500), ("r", 1, "y" * 300), ("r", 2, "z" * 50)], "run string, pos int, content string")
    t = {x.pos: len(x.content) for x in results.trim_messages(m, "run", "pos", "content", 600, short=100).collect()}
    assert t == {0: 100, 1: 300, 2: 50}
    tasks = spark.createDataFrame([("a", [("assistant",), ("user",)])], "task_id string, actions array<struct<requestor:string>>")
    assert results.run_table(runs, tasks, strict=False).count() == 3
    with pytest.raises(PySparkException):
        results.run_table(runs, tasks).collect()
