"""Embedding near-duplicates by spherical-cap filters with list decoding.

A filter is a direction on the sphere; a vector passes it if their inner
product reaches the vector's height. Directions form product codes: the space is
rotated at random and split into two halves, each half has ``words`` random unit
code words, and every pair of code words is a direction, so words x words filters
cost 2 x words inner products. List decoding finds all directions that a vector
exceeds from the few best code words of either half. The height is the vector's
own: ``PASSES`` directions of each of ``CODES`` or more independent codes exceed it. (One
height for all vectors leaves some without any filter: it missed 10 % of random
pairs at cosine 0.9 in 64 dimensions where own heights missed none of 4,000.)
Vectors that share a filter meet and are verified by cosine in double
precision. ``words`` grows with the number of vectors, so that a filter has about
``PER_FILTER`` vectors of a random set; each dimension then gets more codes, and
fewer words where ``MOST_CODES`` do not do, until random pairs at the threshold
miss each other in no more than ``MISSED`` of a trial.

Equal vectors are one class with a count. A filter with more than ``BLOCK``
classes is dealt out as pairs of blocks, so that no task holds more than two
blocks; a pair counts only in the smallest filter that both pass, so links are
counted once without listing them; blocks return counts and a spanning forest.
That forest goes to the component search. Clusters of n different vectors that
all link have n^2/2 links to verify, which an exact count of links needs.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing: no links, a component of their own. Vectors of different length
don't link. Rows that repeat an id with the same vector link with each other.
A null id takes part in links and gets a null component where it has no link.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import SALTS, cut, map_batches, shape
from tracemill.llm.components import connected_components

CODES = 8
MOST_CODES = 12
#: Share of the random pairs at the threshold that a plan may miss, and their number.
MISSED, PAIRS = 0.001, 4000
PASSES = 4
PER_FILTER = 16
BLOCK = 1024


class Code:
    """One product code for one dimension: rotation and code words of both halves."""

    def __init__(self, dim: int, words: int, seed: int, number: int):
        rng = np.random.default_rng([seed, dim, words, number])
        self.words = words
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.half = max(1, dim // 2)
        unit = lambda d: (lambda c: c / np.linalg.norm(c, axis=1, keepdims=True))(rng.standard_normal((words, d)))
        self.first = unit(self.half)
        self.second = unit(dim - self.half) if dim > 1 else np.zeros((words, 0))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every filter that a row exceeds; the best sums are made of the best words of either half."""
        v = unit @ self.rotation
        s, t = v[:, : self.half] @ self.first.T, v[:, self.half :] @ self.second.T
        i, j = np.argpartition(-s, PASSES - 1, axis=1)[:, :PASSES], np.argpartition(-t, PASSES - 1, axis=1)[:, :PASSES]
        sums = (np.take_along_axis(s, i, 1)[:, :, None] + np.take_along_axis(t, j, 1)[:, None, :]).reshape(len(unit), -1)
        height = np.partition(sums, -PASSES, axis=1)[:, -PASSES]
        row, at = np.nonzero(sums >= height[:, None])
        return row, i[row, at // PASSES].astype(np.int64) * self.words + j[row, at % PASSES]


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that no square over- or underflows."""
    v = vectors / np.abs(vectors).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Codes:
    """The codes of all dimensions that a task meets."""

    def __init__(self, words: int, seed: int, plans: dict[int, tuple[int, int]] | None = None):
        self.words, self.seed, self.plans, self.codes = words, seed, plans or {}, {}

    def filters(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter number); numbers differ between codes and dimensions."""
        dim = unit.shape[1]
        if dim not in self.codes:
            words, number = self.plans.get(dim, (self.words, CODES))
            self.codes[dim] = [Code(dim, words, self.seed, n) for n in range(number)]
        found = [c.decode(unit) for c in self.codes[dim]]
        which = [f + (dim * MOST_CODES + n) * self.words**2 for n, (_, f) in enumerate(found)]
        return np.concatenate([r for r, _ in found]), np.concatenate(which)


def random_pairs(rng: np.random.Generator, n: int, dim: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    v = unit_rows(rng.standard_normal((n, dim)))
    z = rng.standard_normal((n, dim))
    z = unit_rows(z - (z * v).sum(1, keepdims=True) * v)
    return v, cosine * v + math.sqrt(1 - cosine * cosine) * z


def plan(dim: int, words: int, seed: int, threshold: float) -> tuple[int, int]:
    """(code words, codes) of a dimension: as many codes, then as few words, as let random pairs at the threshold meet but for ``MISSED`` of them."""
    if dim < 2 or not 0 < threshold < 1:
        return words, CODES
    v, w = random_pairs(np.random.default_rng([seed, dim]), PAIRS, dim, threshold)
    while True:
        apart = np.arange(PAIRS)
        for n in range(MOST_CODES):
            if n >= CODES and len(apart) <= MISSED * PAIRS:
                return words, n
            if not len(apart):
                continue
            code = Code(dim, words, seed, n)
            (a, fa), (b, fb) = code.decode(v[apart]), code.decode(w[apart])
            met = np.unique(np.intersect1d(a * words**2 + fa, b * words**2 + fb) // words**2)
            apart = np.delete(apart, met)
        if words <= 16 or len(apart) <= MISSED * PAIRS:
            return words, MOST_CODES
        words = max(16, words * 3 // 4)


def _decode(words: int, seed: int, thin: bool, plans: dict[int, tuple[int, int]]):
    codes = Codes(words, seed, plans)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
        lengths = np.diff(np.asarray(vectors.offsets))
        out: list[pa.RecordBatch] = []
        for dim in np.unique(lengths):
            rows = np.flatnonzero(lengths == dim)
            m = np.asarray(vectors.take(pa.array(rows)).flatten(), dtype=np.float64).reshape(len(rows), dim)
            at, which = codes.filters(unit_rows(m))
            if thin:
                out.append(pa.RecordBatch.from_arrays([pa.array(which)], names=["filter"]))
                continue
            pick = pa.array(rows[at])
            out.append(pa.RecordBatch.from_arrays([pa.array(which), pa.array(cids[rows[at]]), batch.column(1).take(pick), vectors.take(pick)], names=["filter", "cid", "n", "vector"]))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if sum(x.num_rows for x in out) else None

    return step


def _links(ns: np.ndarray, unit: np.ndarray, codes: Codes, here: int, side: np.ndarray | None, threshold: float) -> tuple:
    """Links within one filter (or between two blocks of one) that no smaller common filter has.

    Only vectors that link at all are decoded again, to know their other filters.
    """
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    rows = np.flatnonzero(linked.any(1))
    if not len(rows):
        return rows, rows, rows
    linked = linked[np.ix_(rows, rows)]
    at, which = codes.filters(unit[rows])
    smaller = which < here
    if smaller.any():
        ids, column = np.unique(which[smaller], return_inverse=True)
        seen = np.zeros((len(rows), len(ids)), np.float32)
        seen[at[smaller], column] = 1
        linked &= seen @ seen.T < 0.5
    counts = linked @ ns[rows]
    label = np.arange(len(rows))
    while True:
        near = np.where(linked, label[None, :], len(rows)).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return rows, counts, rows[label]


def _verify(threshold: float, words: int, seed: int, plans: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(words, seed, plans)
        kept: list[pa.RecordBatch] = []
        key = None
        found: list[tuple] = []

        def close() -> None:
            t = pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept.clear()
            if not t or t[0].num_rows < 2:
                return
            b = t[0]
            m = unit_rows(np.asarray(b.column("vector").flatten(), dtype=np.float64).reshape(b.num_rows, -1))
            i, j, block, cids, ns = (b.column(c).to_numpy() for c in ("i", "j", "block", "cid", "n"))
            rows, counts, roots = _links(ns, m, codes, b.column("filter")[0].as_py(), None if i[0] == j[0] else block, threshold)
            if len(rows):
                some = counts > 0
                found.append((cids[rows[some]], counts[some], cids[roots[some]]))

        def emit() -> pa.RecordBatch:
            a, c, r = (np.concatenate(x) for x in zip(*found))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(r, pa.int64())], names=["cid", "links", "root"])

        for batch in batches:
            f, i, j = (batch.column(c).to_numpy() for c in ("filter", "i", "j"))
            cuts = np.flatnonzero((np.diff(f) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(f)]):
                now = (f[a], i[a], j[a])
                if kept and now != key:
                    close()
                key = now
                kept.append(batch.slice(a, b - a))
            if sum(len(x[0]) for x in found) > 5000:
                yield emit()
        if kept:
            close()
        if found:
            yield emit()

    return run


def vector_classes(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vector, cid, n, salts``: every different usable vector, the smallest id that has it (a hash where all are null), its rows and their salts."""
    usable = (
        F.col("vector").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(usable)
    part = d.groupBy("vector", _salt(F.col("id")).alias("salt")).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return part.groupBy("vector").agg(F.coalesce(F.min("id"), F.xxhash64(F.first("vector"))).alias("cid"), F.sum("n").alias("n"), F.collect_set("salt").alias("salts"))


def _salt(id_: Column) -> Column:
    """Deals the rows of one vector, or of none, out to tasks."""
    return F.pmod(F.xxhash64(id_), F.lit(SALTS)).cast("int")


def embedding_clusters(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, seed: int = 5) -> DataFrame:
    """One row a vector: ``id, n_links, component_id, kept``."""
    shape(df, id_col, vector_col)
    classes = cut(vector_classes(df, id_col, vector_col))
    count = classes.agg(F.count("*").alias("n"), F.collect_set(F.size("vector")).alias("dims")).first()
    words = max(16, math.isqrt(max(1, count.n) * PASSES // PER_FILTER) + 1)
    plans = {dim: plan(dim, words, seed, threshold) for dim in count.dims}
    vectors = classes.select("cid", "n", "vector")
    # Crowded filters first, from numbers alone, so that vectors are dealt out only once.
    crowd = map_batches(vectors, "filter long", lambda: _decode(words, seed, True, plans)).groupBy("filter").agg(F.count("*").alias("members"))
    crowd = cut(crowd.where(F.col("members") > BLOCK))
    kind = dict(df.dtypes)[vector_col]
    fat = map_batches(vectors, f"filter long, cid long, n long, vector {kind}", lambda: _decode(words, seed, False, plans))
    fat = fat.join(crowd, "filter", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("members") / BLOCK), F.lit(1)).cast("int"))
    fat = fat.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    spread = fat.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other", "members")
    parts = spread.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j")
    found = cut(parts.mapInArrow(_verify(threshold, words, seed, plans), "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(found, "cid", "root")
    table = classes.select("vector", "cid", "n", "salts").join(links, "cid", "left").join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left")
    table = table.select("vector", F.explode("salts").alias("salt"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).withColumn("salt", _salt(F.col("id")))
    rows = rows.join(table, ["vector", "salt"], "left")
    component = F.when((F.col("n_links") > 0) | F.col("id").isNotNull(), F.coalesce("root", "id"))
    return rows.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
