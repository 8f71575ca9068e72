"""Embedding whitening by matrix-free block subspace iteration.

The entries of a vector, times ``SCALE`` and rounded down, are integers x. The
fit list is every distinct x vector once; its covariance V (divisor n) is never
formed. A pass over the list computes V Q for a block Q of a few orthonormal
columns: rows are centred exactly (n x - S is an integer), each task adds
up X'(XQ), and the sums of tasks meet in groups before the driver adds them,
which holds dimension times block numbers and no row. Rayleigh-Ritz on the span
of the blocks so far gives the components; the QR of their residuals is the next
block. The passes end when the residuals V v - e v of all k components are
below ``TOLERANCE`` of the largest eigenvalue, or as small as rounding lets them.
Keeping the earlier blocks matters: embeddings have flat spectra, on which a
lone block gains a few hundredths a pass. The span is restarted with its best
vectors when it has ``MOST_COLUMNS``.

A null vector, one with a null or non-finite entry, and one whose integers don't
fit a long are dropped, and so are vectors whose length isn't the most frequent one (of
equals the longest): they have no coordinates in the fit. A component
needs a variance above rounding, so fewer than k may come back: none for fewer than
two distinct vectors, none for an empty table. Equal vectors get equal results,
null ids are kept. A deviation that doesn't fit a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import add_columns, cut, shape

SCALE = 256
BLOCK = 16
MOST_COLUMNS = 128
TOLERANCE = 1e-13
#: Residuals that stop falling are rounding if they are below this; above it the fit fails.
ROUNDING = 1e-9
MOST_PASSES = 2_000
LARGEST = 1 << 62


def integers(vector: Column) -> Column:
    """The vector as longs, or null where it has none."""
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    # Non-finite entries are out of bounds too; a null entry makes the answer null.
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < float(LARGEST), F.lit(False)) & ~F.isnan(c.cast("double")))
    return F.when(fits, whole)


def _matrix(a: pa.ListArray, d: int) -> np.ndarray:
    values = a.flatten().to_numpy()
    return values.reshape(-1, d)


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and exact sums of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * d, 0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            n += len(x)
            wide = len(x) and int(np.abs(x).max()) > LARGEST // max(1, len(x))
            part = x.astype(object).sum(axis=0) if wide else x.sum(axis=0)
            sums = [a + int(b) for a, b in zip(sums, part)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), pa.array([str(v) for v in (n, *sums)])], names=["k", "v"])

    parts = fit.mapInArrow(run, "k int, v string").groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    found = {r.k: int(r.v) for r in parts}
    return found.get(-1, 0), [found.get(k, 0) for k in range(d)]


class Centred:
    """Rows of integers less their mean: (n x - S) / n, from exact integers where these fit a long."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.most = (2**63 - 1 - max(map(abs, sums), default=0)) // max(n, 1)

    def whole(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as longs or as Python's integers."""
        if len(x) and int(np.abs(x).max()) > self.most:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.whole(x).astype(np.float64) / self.n


def _partial(fit: DataFrame, d: int, size: int, block) -> np.ndarray:
    """Sum over the fit list of what ``block`` makes of a batch of rows; sums of tasks meet in about the root of their number of groups."""
    groups = max(1, int(fit.rdd.getNumPartitions() ** 0.5))
    schema = "g int, v binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, any_rows = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                out += block(_matrix(batch.column(0), d)).ravel()
                any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups], pa.int32()), pa.array([out.tobytes()])], names=["g", "v"])

    def meet(t: pa.Table) -> pa.Table:
        out = np.zeros(size)
        for v in t["v"]:
            out += np.frombuffer(v.as_buffer())
        return pa.table({"g": pa.array([t["g"][0].as_py()], pa.int32()), "v": pa.array([out.tobytes()])})

    sums = fit.mapInArrow(add, schema).groupBy("g").applyInArrow(meet, schema)
    return sum((np.frombuffer(r.v) for r in sums.orderBy("g").collect()), np.zeros(size))


def apply_covariance(fit: DataFrame, centred: Centred, q: np.ndarray) -> np.ndarray:
    """V Q in one pass: every task holds Q and a sum of its shape."""
    d, p = q.shape
    n = centred.n

    def block(x: np.ndarray) -> np.ndarray:
        rows = centred.rows(x)
        return rows.T @ (rows @ q) / n

    return _partial(fit, d, d * p, block).reshape(d, p)


def total_variance(fit: DataFrame, centred: Centred) -> float:
    d, n = len(centred.sums), centred.n
    return float(_partial(fit, d, 1, lambda x: np.array([(centred.rows(x) ** 2).sum() / n]))[0])


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns of ``block``, also to ``against``; what rounding alone leaves is dropped."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > 1e-10]
    q = q - against @ (against.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def components(multiply, d: int, k: int, block: int = BLOCK, most: int = MOST_COLUMNS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, vectors, passes) of the k largest of a symmetric d x d operator that ``multiply`` applies to a block."""
    k, rng = min(k, d), np.random.default_rng(5)
    block = min(d, max(block, 2 * k))
    most = max(most, 3 * block)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    new = _orthonormal(rng.standard_normal((d, block)), basis)
    lowest, stuck = np.inf, 0
    for passes in range(1, MOST_PASSES + 1):
        basis, image = np.hstack([basis, new]), np.hstack([image, multiply(new)])
        small = basis.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        lead = min(block, basis.shape[1])
        vectors, images = basis @ turn[:, :lead], image @ turn[:, :lead]
        residual = images - vectors * value[:lead]
        size = np.linalg.norm(residual, axis=0)
        worst = size[:k].max() / max(value[0], np.finfo(float).tiny)
        stuck = 0 if worst < 0.9 * lowest else stuck + 1
        lowest = min(lowest, worst)
        whole = basis.shape[1] == d
        if worst <= tolerance or whole and worst <= ROUNDING or stuck >= 5 and worst <= ROUNDING:
            return value[:k], vectors[:, :k], passes
        if basis.shape[1] + block > most:
            keep = min(basis.shape[1], max(2 * k, block) + block)
            basis, turned = np.linalg.qr(basis @ turn[:, :keep])
            image = np.linalg.solve(turned.T, (image @ turn[:, :keep]).T).T
        new = _orthonormal(residual, basis)
        if not new.shape[1]:
            if worst <= ROUNDING:
                return value[:k], vectors[:, :k], passes
            new = _orthonormal(rng.standard_normal((d, block)), basis)
    raise RuntimeError(f"components not certified after {MOST_PASSES} passes: residual {lowest:.1e}")


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 4) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component."""
    shape(vectors, id_col, vector_col)
    x = vectors.select(F.col(f"`{id_col}`").alias("id"), integers(F.col(f"`{vector_col}`")).alias("x")).where("x is not null and size(x) > 0")
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0].d if lengths else 1
    x = x.where(F.size("x") == d)
    fit = cut(x.select("x").distinct())
    n, sums = column_sums(fit, d)
    centred = Centred(n, sums)
    trace = total_variance(fit, centred) if n > 1 else 0.0
    value, vector = np.zeros(0), np.zeros((d, 0))
    if trace > 0:
        value, vector, _ = components(lambda q: apply_covariance(fit, centred, q), d, k)
        real = value > trace * d * np.finfo(float).eps * 8
        value, vector = value[real], vector[:, real]
    turn = vector / np.sqrt(value)
    found = len(value)
    if found:
        gram = _partial(fit, d, found * found, lambda rows: (lambda z: z.T @ z / n)(centred.rows(rows) @ turn)).reshape(found, found)
        error = float(np.abs(gram - np.eye(found)).max())
    else:
        error = 0.0
    explained = (value / trace).tolist() if found else []

    def start():
        def step(a: pa.ListArray) -> list[pa.Array]:
            rows = _matrix(a, d)
            whole = centred.whole(rows)
            if whole.dtype == object or len(whole) and d * float(np.abs(whole).max()) ** 2 >= 2.0**62:
                square = [s if s < 2**63 else None for s in (int((r.astype(object) ** 2).sum()) for r in whole)]
            else:
                square = (whole * whole).sum(axis=1)
            z = np.einsum("ij,jk->ik", whole.astype(np.float64) / n, turn)  # row by row, so that equal rows give equal results
            offsets = pa.array(np.arange(len(rows) + 1) * found, pa.int32())
            return [pa.array(square, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(z.ravel(), pa.float64()))]

        return step

    out = add_columns(x, {"id": F.col("id")}, [F.col("x")], [T.StructField("deviation", T.LongType()), T.StructField("z", T.ArrayType(T.DoubleType()))], start)
    shares = F.array(*[F.lit(v) for v in explained]).cast("array<double>")
    out = out.select("id", "deviation", F.posexplode("z").alias("c", "whitened"))
    return out.select("id", (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("c")).alias("explained"), F.lit(error).alias("identity_error"))
