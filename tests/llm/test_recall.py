"""Recall of op2 at low dimensions and projected sizes."""

import math

import numpy as np
import pytest

from tracemill.llm import embeddings


@pytest.mark.parametrize("dim,vectors", [(64, 3_000_000), (16, 1_000_000), (16, 3_000_000), (8, 50_000), (8, 3_000_000)])
def test_pairs_meet_at_any_size(dim, vectors):
    words = max(16, math.isqrt(vectors * embeddings.PASSES // embeddings.PER_FILTER) + 1)
    codes = embeddings.Codes(words, 5, {dim: embeddings.plan(dim, words, 5, 0.9)})
    v, w = embeddings.random_pairs(np.random.default_rng(9), 2000, dim, 0.9)
    (a, fa), (b, fb) = codes.filters(v), codes.filters(w)
    met = {x for x, _ in set(zip(a.tolist(), fa.tolist())) & set(zip(b.tolist(), fb.tolist()))}
    assert 1 - len(met) / 2000 <= 0.004


def test_low_dimension_equals_brute_force(spark):
    v = np.random.default_rng(2).normal(size=(6000, 8))
    d = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    got = np.array([r.n_links for r in embeddings.embedding_clusters(d).orderBy("id").collect()])
    assert (got <= want).all() and got.sum() >= 0.998 * want.sum()
