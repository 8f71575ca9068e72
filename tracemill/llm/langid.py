"""Language identification by the nearest of several centroids per language.

A text is lower-cased, everything but letters becomes a space, and hashed byte
trigrams are counted over the whole of it; logarithmic counts times inverse
document frequencies, at length one, make its vector. Spherical k-means gives
each language ``CENTROIDS`` centroids. A text takes the language of the centroid
with the highest cosine, which is its score. It is rejected if it has no letter,
or if its cosine falls far below (``REJECT`` times) what labelled texts of its
length usually reach.

The labelled rows are a bounded sample: ``PER_LANGUAGE`` expected rows a
language, chosen by a hash of id and text, so that rows with one id, or none,
are drawn each by itself; rows that repeat count once. Their sparse counts, not
their texts, go to the driver, and no more of them than twice the expected rows.

A null text, or one without letters, is ``und`` with score 0. Repeated rows keep
their rows; an empty table gives an empty result; a table without any label
makes every text ``und``. Working columns have no names that kept ones could
clash with. ``REJECT`` lies between what foreign, junk and program text reached
(at most 0.19 of the usual cosine) and what clean text did (0.46 at least, but
for lines of license text).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import add_columns, map_batches

BINS = 4096
CENTROIDS = 3
PER_LANGUAGE = 600
PIECE = 1 << 20
#: Share of the usual cosine below which a text is rejected, and length classes (octaves of distinct trigrams).
REJECT = 0.3
LENGTHS = 13

#: ASCII letters and all bytes of multi-byte characters stay; the rest becomes a space.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def counts(text: str | None) -> np.ndarray:
    """Hashed trigram counts of a whole text."""
    data = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8)
    out = np.zeros(BINS, np.int64)
    for k in range(0, max(1, len(data) - 2), PIECE):
        b = data[k : k + PIECE + 2].astype(np.uint32)
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        code = code[(b[1:-1] != 32)]
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BINS)
    return out


@dataclass
class Model:
    names: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    usual: np.ndarray

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        v = np.log1p(rows.astype(np.float32)) * self.idf
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n > 0, n, 1)

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number or -1, score, rejected)."""
        if not self.names:
            return np.full(len(rows), -1), np.zeros(len(rows)), np.ones(len(rows), bool)
        cos = self.vectors(rows) @ self.centroids.T
        best = cos.argmax(1)
        score = np.clip(cos[np.arange(len(rows)), best].astype(np.float64), 0, 1)
        return self.owner[best], score, score < REJECT * self.usual[length_class(rows)]


def length_class(rows: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(1, (rows > 0).sum(1))).astype(int), LENGTHS - 1)


def fit(rows: np.ndarray, labels: list[str], seed: int = 3) -> Model:
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels], int)
    df = (rows > 0).sum(0)
    model = Model(names, (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32), np.zeros((0, BINS), np.float32), np.zeros(0, int), np.zeros(LENGTHS))
    if not names:
        return model
    x = model.vectors(rows)
    rng = np.random.default_rng(seed)
    centres, owner = [], []
    for n in range(len(names)):
        own = x[y == n]
        c = own[rng.permutation(len(own))[: min(CENTROIDS, len(own))]]
        for _ in range(12):
            near = (own @ c.T).argmax(1)
            c = np.stack([own[near == k].sum(0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        centres.append(c)
        owner += [n] * len(c)
    model.centroids, model.owner = np.concatenate(centres).astype(np.float32), np.array(owner)
    cos = (x @ model.centroids.T).max(1)
    cls = length_class(rows)
    usual = [np.quantile(cos[cls == k], 0.1) if (cls == k).sum() >= 5 else np.nan for k in range(LENGTHS)]
    # A class without examples takes the value of the nearest shorter one, the shortest none.
    last = 0.0
    for k in range(LENGTHS):
        last = last if np.isnan(usual[k]) else usual[k]
        model.usual[k] = last
    return model


def _sparse(batch_texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
    at, n = [], []
    for text in batch_texts:
        c = counts(text)
        k = np.flatnonzero(c)
        at.append(k.astype(np.uint16).tobytes())
        n.append(c[k].astype(np.uint32).tobytes())
    return at, n


#: Labels that a model may have; their counts are all that the driver gathers to set the rates.
MOST_LABELS = 10_000


def labelled_sample(df: DataFrame, label: Column, per_label: int, *content: Column) -> DataFrame:
    """``label``, ``h`` and ``content`` (c0, c1, ...) of about ``per_label`` different rows a label (all, where there are fewer), by a hash of the content.

    Rates come from the number of different rows and are constants of the filter,
    so the sample is drawn inside the scan; rows that repeat are one. A limit of
    twice the expected size, which chance doesn't reach, makes the bound sure.
    """
    h = F.xxhash64(*content)
    counts = df.where(label.isNotNull()).groupBy(label.alias("label")).agg(F.approx_count_distinct(h).alias("n")).limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not counts:
        counts = [{"label": None, "n": 1}]
    rates = [F.lit(x) for r in counts if r["label"] is not None for x in (r["label"], min(1 << 30, (per_label << 30) // max(1, r["n"])))]
    most = F.try_element_at(F.create_map(*rates), label) if rates else F.lit(0)
    names = [f"c{n}" for n in range(len(content))]
    rows = df.where(label.isNotNull() & (F.pmod(F.xxhash64(h), F.lit(1 << 30)) < most)).select(label.alias("label"), h.alias("h"), *[c.alias(n) for c, n in zip(content, names)])
    once = rows.groupBy("label", "h").agg(*[F.first(n).alias(n) for n in names])
    return once.limit(2 * per_label * len(counts) + 100)


def learn(df: DataFrame, id_col: Column, text: Column, label: Column, per_language: int = PER_LANGUAGE) -> Model:
    sample = labelled_sample(df, label.cast("string"), per_language, id_col, text.cast("string"))

    def start():
        def step(texts: pa.Array) -> list[pa.Array]:
            at, n = _sparse(texts.to_pylist())
            return [pa.array(at, pa.binary()), pa.array(n, pa.binary())]

        return step

    new = [T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())]
    got = sorted((r.label, bytes(r.at), bytes(r.n)) for r in add_columns(sample, {"label": F.col("label")}, [F.col("c1")], new, start).collect())
    rows = np.zeros((len(got), BINS), np.uint32)
    for k, (_, at, n) in enumerate(got):
        rows[k, np.frombuffer(at, np.uint16)] = np.frombuffer(n, np.uint32)
    return fit(rows, [g[0] for g in got])


def identify(df: DataFrame, model: Model, text: Column, /, **keep: Column) -> DataFrame:
    """Columns ``keep``, ``lang_pred``, ``score`` and ``rejected``; a kept column with the name of a new one is left out."""

    def start():
        def step(has_letters: pa.Array, texts: pa.Array) -> list[pa.Array]:
            letters = np.array(has_letters.to_pylist(), bool)
            which, score, rejected = model.predict(np.stack([counts(t) for t in texts.to_pylist()]))
            known = letters & (which >= 0)
            pred = [model.names[w] if k else "und" for w, k in zip(which, known)]
            return [pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(rejected | ~known)]

        return step

    letters = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return add_columns(df, keep, [letters, text.cast("string")], new, start)


def drop_rejected(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose text is rejected; columns stay as they are."""
    at = df.columns.index(text_col)

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(at).to_pylist()
            which, _, rejected = model.predict(np.stack([counts(t) for t in texts]))
            letters = np.array([any(map(str.isalpha, t or "")) for t in texts])
            return batch.filter(pa.array(letters & (which >= 0) & ~rejected))

        return step

    return map_batches(df, df.schema, start)
