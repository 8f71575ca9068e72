"""Ranked lexical search over a two-level quantised index.

A term of a document has the impact (1000000000 * tf) div (1000 * tf + 8 * m),
where m grows with the document's length; a document's score is the sum of
weight times impact over a query's terms. The index keeps each document's terms
with two levels: an impact rounded up to one of 255 steps, a byte, and the
exact term counts. Bytes alone bound every score from above; the documents with the
highest bounds are scored exactly first, and the k-th best exact score so far is
a lower bound of what the k-th result has. Every document whose bound reaches it
is rescored in integers, ties included, so the result is exact.

The documents are read once for counts, written as a table of a few bytes a
term; corpus statistics come from it (sums of all documents), then the bytes. A
search reads index rows in blocks of bounded size, holds k results a query, and
leaves at most k rows a query and task; nothing else is shuffled. Terms are
counted if some query asks for them: queries come in blocks of about
``BLOCK_CHARS`` characters, which the driver holds one at a time as a broadcast,
and each block is a pass over the documents.

A null or blank document counts nowhere and is never found; a null or blank query
finds nothing. Repeated rows are documents, and queries, of their own. Equal
scores come by ascending id, null last. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracemill.llm.common import cut, map_batches, shape
from tracemill.llm.decontaminate import item_blocks

#: An impact is below a million; a byte stands for so much of it.
STEP = 3922
BLOCK_CHARS = 4_000_000
#: (document, query) cells of bounds that a task holds at a time, and documents at most.
CELLS, MOST_DOCUMENTS = 4_000_000, 4_096
#: Bytes of a text that are split into terms at a time.
PIECE = 1 << 20

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_counts(text: str | None, asked: Callable[[bytes], int | None]) -> tuple[int, Counter]:
    """All terms of a text counted with repeats, and the counts of the asked ones by what ``asked`` gives; None stands for the others."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    found: Counter = Counter()
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        found.update(map(asked, data[at:end].split()))
        at = end
    return sum(found.values()), found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def document_measure(n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """m of documents with n terms each: 64-bit integers, rounded down."""
    return 25 + (75 * n * n_docs) // all_terms


def _rows(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _lists(a: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column, also of a slice of one."""
    offsets = a.offsets.to_numpy()
    return a.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(), offsets - offsets[0]


def count_terms(docs: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """``id, n, terms, tfs`` of every document with a term: all its terms counted, and the asked ones with their counts."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType(), False)), T.StructField("tfs", T.ArrayType(T.IntegerType(), False))])

    def start():
        asked = vocabulary.value.get

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep, sizes, terms, tfs = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                n, found = term_counts(text, asked)
                if n:
                    found.pop(None, None)
                    order = sorted(found)
                    keep.append(k)
                    sizes.append(n)
                    terms.append(order)
                    tfs.append([found[t] for t in order])
            numbers = pa.list_(pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), pa.array(terms, numbers), pa.array(tfs, numbers)], names=["id", "n", "terms", "tfs"])

        return step

    return map_batches(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")), schema, start)


def statistics(counts: DataFrame, n_terms: int) -> tuple[int, int, dict[int, int]]:
    """Documents, all their terms, and the documents of each asked term: sums over the whole table, of a row a term and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, size = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            docs += batch.num_rows
            size += int(batch.column(0).to_numpy().sum())
            df += np.bincount(_lists(batch.column(1))[0], minlength=n_terms)
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], terms]), pa.int64()), pa.array(np.concatenate([[docs, size], df[terms]]), pa.int64())], names=["term", "n"])

    sums = {r.term: r.n for r in counts.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    docs, size = sums.pop(-1, 0), sums.pop(-2, 0)
    return docs, size, sums


def quantise(counts: DataFrame, n_docs: int, all_terms: int) -> DataFrame:
    """The index: ``id, m, terms, tfs`` and ``impacts``, a byte for each term, rounded up."""
    fields = counts.schema
    schema = T.StructType([fields["id"], T.StructField("m", T.LongType()), fields["terms"], fields["tfs"], T.StructField("impacts", T.BinaryType())])

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, n, terms, tfs = batch.columns
            m = document_measure(n.to_numpy(), n_docs, all_terms)
            tf, offsets = _lists(tfs)
            steps = -(-impact(tf.astype(np.int64), m[_rows(offsets)]) // STEP)
            level = steps.astype(np.uint8).tobytes()
            return pa.RecordBatch.from_arrays([ids, pa.array(m), terms, tfs, pa.array([level[a:b] for a, b in zip(offsets, offsets[1:])], pa.binary())], names=schema.names)

        return step

    return map_batches(counts, schema, start)


class Block:
    """Index rows of some documents by term: what bounds and exact scores are read from."""

    def __init__(self, batch: pa.RecordBatch, n_terms: int):
        self.ids = batch.column(0).to_pylist()
        self.m = batch.column(1).to_numpy()
        terms, offsets = _lists(batch.column(2))
        order = np.argsort(terms, kind="stable")
        self.rows = _rows(offsets)[order]
        self.tf = _lists(batch.column(3))[0][order].astype(np.int64)
        self.level = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8)[order]
        self.edges = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def bounds(self, queries: Queries) -> np.ndarray:
        """For each document and query what its score can reach at most, from the bytes alone."""
        out = np.zeros((len(self.ids), len(queries.terms)), np.int64)
        for t in np.flatnonzero(np.diff(self.edges)):
            a, b = self.edges[t], self.edges[t + 1]
            out[np.ix_(self.rows[a:b], queries.by_term[t][0])] += self.level[a:b, None].astype(np.int64) * queries.by_term[t][1]
        return out * STEP

    def exact(self, rows: np.ndarray, terms: list[tuple[int, int]]) -> np.ndarray:
        """Scores of the documents in ``rows`` for a query's (term, weight) list."""
        score = np.zeros(len(rows), np.int64)
        for t, w in terms:
            a, b = self.edges[t], self.edges[t + 1]
            if w and b > a:
                at = np.minimum(np.searchsorted(self.rows[a:b], rows), b - a - 1) + a
                hit = np.flatnonzero(self.rows[at] == rows)
                score[hit] += w * impact(self.tf[at[hit]], self.m[rows[hit]])
        return score


class Queries:
    """Queries as (term, weight) lists, weights times the repeats of a term, and the queries of each term."""

    def __init__(self, counts: list[dict[int, int]], weights: list[int]):
        self.terms = [[(t, weights[t] * c) for t, c in sorted(q.items())] for q in counts]
        by_term: list[tuple[list[int], list[int]]] = [([], []) for _ in weights]
        for q, terms in enumerate(self.terms):
            for t, w in terms:
                by_term[t][0].append(q)
                by_term[t][1].append(w)
        self.by_term = [(np.array(q, np.int64), np.array(w, np.int64)) for q, w in by_term]


def _order(hit: tuple[int, object]) -> tuple:
    score, i = hit
    return -score, i is None, 0 if i is None else i


def search_block(block: Block, queries: Queries, k: int, best: list[list[tuple[int, object]]]) -> int:
    """Bring the results ``best`` of each query, (score, id) in order, up to date with a block; gives the documents that were rescored."""
    bounds = block.bounds(queries)
    rescored = 0
    for q, terms in enumerate(queries.terms):
        bound, held = bounds[:, q], best[q]
        top = np.argpartition(bound, -k)[-k:] if len(bound) > k else np.arange(len(bound))
        lower = sorted([s for s, _ in held] + block.exact(top, terms).tolist())[-k:]
        floor = max(lower[0], 1) if len(lower) == k else 1
        rows = np.flatnonzero(bound >= floor)
        if not len(rows):
            continue
        rescored += len(rows)
        score = block.exact(rows, terms)
        good = np.flatnonzero(score >= floor)
        best[q] = sorted(held + [(int(score[x]), block.ids[rows[x]]) for x in good], key=_order)[:k]
    return rescored


def search(index: DataFrame, queries, n_queries: int, n_terms: int, k: int) -> DataFrame:
    """``query, id, score``: the k best of every task for each query of a broadcast, score above 0."""
    id_type = index.schema["id"].dataType
    arrow_type = to_arrow_type(id_type)
    schema = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])
    size = max(1, min(MOST_DOCUMENTS, CELLS // max(1, n_queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Queries(*queries.value)
        best: list[list[tuple[int, object]]] = [[] for _ in range(n_queries)]
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                search_block(Block(batch.slice(at, size), n_terms), asked, k, best)
        hits = [(q, i, s) for q, found in enumerate(best) for s, i in found]
        if hits:
            q, i, s = zip(*hits)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, arrow_type), pa.array(s, pa.int64())], names=schema.names)

    return index.mapInArrow(run, schema)


def ranked(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, id, score``: the k best documents of each item, the best first."""
    shape(docs, id_col, text_col)
    shape(items, item_col, item_text)
    spark = docs.sparkSession
    item_type = items.schema[item_col].dataType
    fields = T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", item_type), T.StructField("copies", T.IntegerType())])
    out = spark.createDataFrame([], T.StructType([fields["item_id"], T.StructField("rank", T.IntegerType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("score", T.LongType())]))
    for block in item_blocks(items, item_col, item_text, BLOCK_CHARS):
        vocabulary: dict[bytes, int] = {}
        asked = [term_counts(t, lambda w: vocabulary.setdefault(w, len(vocabulary)))[1] for _, t, _ in block]
        if not vocabulary:
            continue
        # Read three times: for the statistics, for the bytes, and if a task is lost.
        counts = cut(count_terms(docs, id_col, text_col, spark.sparkContext.broadcast(vocabulary)))
        n_docs, all_terms, df = statistics(counts, len(vocabulary))
        if not n_docs:
            continue
        weights = [weight(n_docs, df.get(t, 0)) for t in range(len(vocabulary))]
        index = cut(quantise(counts, n_docs, all_terms))
        hits = search(index, spark.sparkContext.broadcast((asked, weights)), len(block), len(vocabulary), k)
        order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        top = hits.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i, n) for q, (i, _, n) in enumerate(block)], fields)
        top = top.join(names, "query").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        out = out.unionByName(top.select("item_id", "rank", "id", "score"))
    return out
