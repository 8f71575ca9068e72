"""Latent spaces: truncated SVD and two principal components, from Gram matrices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators.retrieval import dot, doubles

#: Dimensions whose Gram matrix the driver decomposes; it does not grow with the rows.
MOST_DIMENSIONS = 2048


def gram(df: DataFrame, vector: str, centre: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, scatter matrix, rows) of the vectors: sums over row blocks in Arrow batches, added up by a small aggregate."""
    width = df.select(F.max(F.size(vector))).first()[0] or 0
    if width > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")

    def run(batches):
        import pyarrow as pa

        n, s, g = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            m = np.asarray(b.column(0).flatten(), dtype=float).reshape(-1, width)
            n, s, g = n + len(m), s + m.sum(0), g + m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tobytes()]), pa.array([g.tobytes()])], names=["n", "s", "g"])

    n, s, g = 0, np.zeros(width), np.zeros((width, width))
    # One small matrix a partition, a few at a time.
    for r in df.where(F.col(vector).isNotNull()).select(doubles(F.col(vector)).alias("v")).mapInArrow(run, "n long, s binary, g binary").toLocalIterator():
        n, s, g = n + r.n, s + np.frombuffer(bytes(r.s)), g + np.frombuffer(bytes(r.g)).reshape(width, width)
    mean = s / max(n, 1)
    return (mean, g - n * np.outer(mean, mean), n) if centre else (np.zeros(width), g, n)


def components(scatter: np.ndarray, k: int) -> np.ndarray:
    """The k leading directions; each one's largest entry is positive, which settles its sign."""
    _, vectors = np.linalg.eigh(scatter)
    lead = vectors[:, ::-1][:, :k].T
    return lead * np.sign(lead[np.arange(len(lead)), np.abs(lead).argmax(1)])[:, None]


def project(df: DataFrame, key: str, vector: str, k: int, centre: bool) -> DataFrame:
    """``key, coords``: coordinates in the leading directions: PCA if centred, else truncated SVD."""
    mean, scatter, _ = gram(df, vector, centre)
    lead = components(scatter, k)
    v = F.zip_with(doubles(F.col(vector)), F.array(*[F.lit(float(x)) for x in mean]), lambda x, m: x - m)
    return df.where(F.col(vector).isNotNull()).select(key, F.array(*[dot(v, F.array(*[F.lit(float(x)) for x in row])) for row in lead]).alias("coords"))


def pca2(df: DataFrame, key: str, vector: str) -> DataFrame:
    d = project(df, key, vector, 2, True)
    return d.select(key, F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))


def latent(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """Truncated SVD at length one."""
    d = project(df, key, vector, k, False)
    n = F.sqrt(dot(F.col("coords"), F.col("coords")))
    return d.select(key, F.when(n > 0, F.transform("coords", lambda x: x / n)).otherwise(F.col("coords")).alias("coords"))


def centroid_similarity(df: DataFrame, cluster: str, vector: str) -> DataFrame:
    """``a, b, cosine`` of all pairs of cluster centroids: clusters, not rows."""
    from tracemill.operators.clustering import centroids
    from tracemill.operators.retrieval import cosine

    c = centroids(df, cluster, vector)
    a, b = c.select(F.col("cluster").alias("a"), F.col("centroid").alias("u")), c.select(F.col("cluster").alias("b"), F.col("centroid").alias("v"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", cosine(F.col("u"), F.col("v")).alias("cosine"))
