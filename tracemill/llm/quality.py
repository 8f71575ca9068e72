"""A byte-level convolutional quality classifier in numpy.

Bytes have learned embeddings; ``FILTERS`` learned filters of ``WIDTH`` bytes run
over chunks of ``CHUNK`` bytes that overlap by ``OVERLAP`` and cover the whole
document; each filter is max-pooled over a chunk, the chunks' maxima are pooled
by mean and by maximum over the document, and a logistic layer makes them one
probability that the label is 1. Filters over embeddings are applied as table
look-ups: one gather a byte of the filter.

Training: Adam on a bounded sample, ``PER_LABEL`` expected documents a label
chosen by a hash of the id, each whole: training and scoring read every byte of
a document. A sixth of the sample is held out of the steps; training ends when
its loss has not fallen for ``PATIENCE`` epochs, and the best epoch stays. Of an
id that repeats among the documents the text with the smallest hash is learned.

Null and empty texts score as a document of one blank chunk. Repeated rows keep
their rows; an empty table gives an empty result; without both labels the
score is the share of label 1 (0.5 if there are none). Very long texts are read in
pieces of ``STEP_CHUNKS`` chunks; working columns clash with no kept ones.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import add_columns
from tracemill.llm.langid import labelled_sample

CHUNK, OVERLAP, WIDTH, STRIDE = 256, 32, 8, 2
FILTERS, EMBED = 16, 6
PER_LABEL = 1000
EPOCHS = 14
PATIENCE = 3
STEP_CHUNKS = 2048
_SPOTS = (CHUNK - WIDTH) // STRIDE + 1


def chunks(text: bytes | None) -> np.ndarray:
    """(n, CHUNK) bytes: overlapping chunks over the whole text, the last one padded with spaces."""
    data = np.frombuffer(text or b"", np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    padded = np.full(n * step + OVERLAP, 32, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


@dataclass
class Net:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    constant: float | None = None
    tables: np.ndarray | None = field(default=None)

    def prepare(self) -> None:
        """Per filter byte a table of its contribution for each byte value."""
        self.tables = np.ascontiguousarray(np.einsum("be,kef->kbf", self.embed, self.filters).astype(np.float32))

    def spots(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunk maxima and the spot of each, a bounded number of chunks at a time."""
        parts = [self.pool(x[a : a + STEP_CHUNKS], where=True) for a in range(0, len(x), STEP_CHUNKS)]
        return np.concatenate([h for h, _ in parts]), np.concatenate([s.astype(np.uint8) for _, s in parts])

    def pool(self, x: np.ndarray, where: bool = False):
        """Chunk maxima (n, FILTERS) of the rectified filters, and the spot of each maximum if asked for."""
        out = np.zeros((len(x), _SPOTS, FILTERS), np.float32)
        for k in range(WIDTH):
            out += self.tables[k].take(x[:, k : k + STRIDE * _SPOTS : STRIDE][:, :_SPOTS], axis=0)
        top = out.max(1) + self.bias
        return (np.maximum(top, 0), out.argmax(1)) if where else np.maximum(top, 0)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        mean, most, size = np.zeros((len(texts), FILTERS)), np.zeros((len(texts), FILTERS)), np.zeros(len(texts))
        owner, parts, held = [], [], 0

        def run() -> None:
            nonlocal held
            h = self.pool(np.concatenate(parts))
            own = np.concatenate(owner)
            np.add.at(mean, own, h)
            np.maximum.at(most, own, h)
            owner.clear()
            parts.clear()
            held = 0

        for k, text in enumerate(texts):
            c = chunks(text)
            size[k] = len(c)
            for a in range(0, len(c), STEP_CHUNKS):
                part = c[a : a + STEP_CHUNKS]
                parts.append(part)
                owner.append(np.full(len(part), k))
                held += len(part)
                if held >= STEP_CHUNKS:
                    run()
        if held:
            run()
        z = np.concatenate([mean / size[:, None], most], 1) @ self.weights + self.offset
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 9) -> Net:
    """Train on whole documents."""
    rng = np.random.default_rng(seed)
    net = Net(
        rng.standard_normal((256, EMBED)).astype(np.float32) * 0.5,
        rng.standard_normal((WIDTH, EMBED, FILTERS)).astype(np.float32) * 0.4,
        np.zeros(FILTERS, np.float32),
        (rng.standard_normal(2 * FILTERS) * 0.1),
        0.0,
    )
    labels = np.asarray(labels, float)
    if len(labels) == 0 or labels.min() == labels.max():
        net.constant = float(labels.mean()) if len(labels) else 0.5
        return net
    # The sample is drawn by label; weights give each label its half, and the offset returns to the real share below.
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    params = {"embed": net.embed, "filters": net.filters, "bias": net.bias, "weights": net.weights, "offset": np.zeros(1)}
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    t = 0
    held = np.arange(len(texts)) % 6 == 5
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held[:] = False
    test = [texts[k] for k in np.flatnonzero(held)]
    best, least, since = None, math.inf, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(np.flatnonzero(~held))
        for a in range(0, len(order), 32):
            pick = order[a : a + 32]
            net.prepare()
            docs = [chunks(texts[k]) for k in pick]
            x = np.concatenate(docs)
            size = np.array([len(d) for d in docs])
            own = np.repeat(np.arange(len(pick)), size)
            h, spot = net.spots(x)
            start = np.concatenate([[0], np.cumsum(size)[:-1]])
            mean = np.add.reduceat(h, start, axis=0) / size[:, None]
            most = np.maximum.reduceat(h, start, axis=0)
            z = np.concatenate([mean, most], 1) @ net.weights + params["offset"][0]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            dz = (p - labels[pick]) * weight[pick] / len(pick)
            dv = dz[:, None] * net.weights[None, :]
            dh = (dv[:, :FILTERS] / size[:, None])[own] + dv[:, FILTERS:][own] * (h == most[own])
            dh = (dh * (h > 0)).astype(np.float32)
            tables = np.zeros((WIDTH, 256, FILTERS), np.float32)
            n, f = np.nonzero(dh)
            for k in range(WIDTH):
                byte = x[n, spot[n, f].astype(np.int64) * STRIDE + k].astype(np.int64)
                tables[k] = np.bincount(byte * FILTERS + f, weights=dh[n, f], minlength=256 * FILTERS).reshape(256, FILTERS)
            grads = {
                "embed": np.einsum("kbf,kef->be", tables, net.filters),
                "filters": np.einsum("kbf,be->kef", tables, net.embed),
                "bias": dh.sum(0),
                "weights": np.concatenate([mean, most], 1).T @ dz + 1e-4 * net.weights,
                "offset": np.array([dz.sum()]),
            }
            t += 1
            rate = 0.02 * (1 - epoch / EPOCHS) + 0.001
            for k, v in params.items():
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
                v -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)).astype(v.dtype)
        if test:
            net.prepare()
            net.offset = float(params["offset"][0])
            p, y = np.clip(net.score(test), 1e-6, 1 - 1e-6), labels[held]
            loss = -float((weight[held] * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean())
            if loss < least - 1e-4:
                best, least, since = {k: v.copy() for k, v in params.items()}, loss, 0
            elif (since := since + 1) == PATIENCE:
                break
    for k, v in (best or {}).items():
        params[k][...] = v
    net.offset = float(params["offset"][0])
    net.prepare()
    return net


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL) -> Net:
    """Fit to documents whose labels (0 or 1; of several the smallest) are in ``labels``; ids that are null have none.

    The sample is drawn from the small table of labels; what is left of it goes
    to the documents, so no text is shuffled.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"))
    chosen = labelled_sample(known, F.col("label"), per_label, F.col(id_col)).select(F.col("c0").alias("id"), "label")
    # At most what the sample's limit allows.
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")).join(F.broadcast(chosen), "id")
    once = d.groupBy("id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    got = sorted((bytes(r.text), r.label) for r in once.select("label", "text").collect())
    return fit([t for t, _ in got], np.array([y for _, y in got]))


def score(df: DataFrame, net: Net, text: Column, /, **keep: Column) -> DataFrame:
    """Columns ``keep`` and ``score``; a kept column of that name is left out."""

    def start():
        return lambda texts: [pa.array(net.score(texts.to_pylist()), pa.float64())]

    return add_columns(df, keep, [text.cast("string").cast("binary")], [T.StructField("score", T.DoubleType())], start)
