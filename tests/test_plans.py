"""Registries, the retrieval pipeline, evaluation rules and reports."""

import os
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracemill.operators import evaluate, projection, reports
from tracemill.plans import registries as G


def test_toolkit(spark):
    k = G.Toolkit()

    @k.tool("read", returns="int")
    def double_it(x: int) -> int:
        return 2 * x

    @k.tool("write", name="store")
    def _store(x):
        return x

    assert k.kinds() == {"double_it": "read", "store": "write"} and k.mutating() == ["store"] and k.use("double_it", x=4) == 8
    assert k.register_sql(spark) == ["double_it"] and spark.sql("select double_it(21) as x").first().x == 42
    with pytest.raises(ValueError):
        k.tool("read", name="store")(lambda: 0)
    with pytest.raises(KeyError):
        k.use("nothing")
    with pytest.raises(ValueError):
        k.tool("other")


@pytest.mark.parametrize("config", [{}, {"retriever": {"type": "bm25"}, "retrievers": [{"type": "grep"}]}, {"retrievers": []}, {"retriever": {}}, {"retriever": {"type": "bm25"}, "postprocessors": [{}]}, {"retriever": {"type": "bm25"}, "tool_name": 3}, {"retriever": {"type": "bm25"}, "parameters": {"a": 1}}])
def test_bad_configurations(config):
    with pytest.raises(ValueError):
        G.validate(config)


def test_pipeline(spark):
    docs = spark.createDataFrame([("d1", "Refunds", "refund policy for orders", [1.0, 0.0]), ("d2", "Cards", "card limits and fees", [0.0, 1.0]), ("d3", "Empty", "", [0.7, 0.7])], "id string, title string, content string, embedding array<double>")
    q = spark.createDataFrame([("q", "refund policy", [1.0, 0.1])], "query string, text string, embedding array<double>")
    p = G.RetrievalPipeline({"document_preprocessors": [{"type": "bm25_indexer"}, {"type": "embedding_indexer"}], "input_preprocessors": [{"type": "embedding_encoder"}], "retrievers": [{"type": "bm25"}, {"type": "cosine"}], "postprocessors": [{"type": "reranker", "params": {"min_score": 1.0, "top_k": 2}}]})
    p.index(docs)
    p.state["scores"] = spark.createDataFrame([("q", "d1", 12.0), ("q", "d2", 0.5), ("q", "d3", 9.0)], "query string, doc string, score double")
    assert [(r.doc, r.score) for r in p.retrieve(q).collect()] == [("d1", 10.0)]
    assert set(p.timing) == {"bm25_indexer", "embedding_indexer", "embedding_encoder", "bm25", "cosine", "reranker"}
    assert G.document_prompt("Use:\n{documents}", docs, ["d2", "d1"]).startswith("Use:\n## Cards\ncard limits")
    with pytest.raises(KeyError):
        G.document_prompt("{documents}", docs, ["zz"])


def test_evaluation_rejects_unknown_basis(spark):
    d = spark.createDataFrame([("r", "user_stop", ["DB", "STYLE"], True)], "run_id string, termination_reason string, reward_basis array<string>, db_match boolean")
    d = d.withColumns({c: F.lit(None).cast("array<boolean>") for c in ("env_met", "action_match", "communicate_met", "nl_met")})
    with pytest.raises(PySparkException):
        evaluate.evaluate(d, "all").collect()
    assert evaluate.evaluate(d, "env").first().reward == 1.0


def test_call_results_must_match(spark):
    m = spark.createDataFrame([("r", 0, "assistant", [("a", "f")], None, None), ("r", 1, "tool", None, "b", "x")], "run_id string, pos int, role string, calls array<struct<id:string,name:string>>, tool_call_id string, content string")
    with pytest.raises(PySparkException):
        evaluate.call_results(m).collect()


def test_projection_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 6)) @ rng.normal(size=(6, 6))
    d = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "k int, v array<double>")
    got = np.array([(r.x, r.y) for r in projection.pca2(d, "k", "v").orderBy("k").collect()])
    c = x - x.mean(0)
    want = c @ np.linalg.svd(c)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(want))
    lat = np.array([r.coords for r in projection.latent(d, "k", "v", 3).orderBy("k").collect()])
    assert np.allclose(np.linalg.norm(lat, axis=1), 1)


def test_viewer_rows(spark):
    m = spark.createDataFrame([("r", 0, "user", "hi", None), ("r", 1, "assistant", "on it", [("a", "find")]), ("r", 2, "tool", "done", None), ("x", 0, "user", "no features", None)], "run_id string, pos int, role string, content string, calls array<struct<id:string,name:string>>")
    f = spark.createDataFrame([("r", "pass")], "run_id string, failure_type string")
    assert [(r.node, r.depth, r.text) for r in reports.viewer_rows(m, f).orderBy("node").collect()] == [(0, 0, "hi"), (1, 0, "on it"), (2, 1, "find"), (3, 2, "done")]
    c = spark.createDataFrame([("c1", "name")], "id string, name string")
    assert reports.cluster_table(c, c.select("id", F.lit("L").alias("label"))).first().label == "L"
    s = spark.createDataFrame([(1, 2, 4, "hello")], "conv_id int, start int, end int, text string")
    assert tuple(reports.label_track(s, 0.2).first()) == (1, "0.400000", "1.000000", "hello")


def test_entry_needs_no_session():
    """The registry can be imported before there is a session, and without a library of the subpackage."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for block in ("", "sys.modules['ahocorasick'] = None; "):
        out = subprocess.run([sys.executable, "-W", "ignore", "-c", f"import sys; {block}import __spark_entry__ as e; print(len(e.queries()) > 200, set(e.oracle_sql()) <= set(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
        assert out.stdout.split() == ["True", "True"], out.stderr[-500:]
