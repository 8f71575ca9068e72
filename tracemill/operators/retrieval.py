"""Lexical and vector retrieval: BM25, regular expressions, cosine, fusion, reranking, caches."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.ordered import running_total
from tracemill.session import cut

#: Published defaults of Okapi BM25 with a floor for negative idf: k1, b, epsilon.
K1, B, EPSILON = 1.5, 0.75, 0.25


def tokens(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"[\s\x0b]+"), lambda t: t != "")


def bm25_index(docs: DataFrame, doc: str, text: str) -> dict[str, DataFrame]:
    """Documents as words, their lengths, totals of the corpus and the document frequency of every term. A null text raises.

    One pass counts: each document gives its distinct words and one row for itself
    with its length, so what is shuffled is a count a term and task. The counts are
    written once.
    """
    body = F.coalesce(F.col(text), F.raise_error(F.lit("document without text")).cast("string"))
    t = docs.select(F.col(doc).alias("doc"), tokens(body).alias("ts"))
    lengths = t.select("doc", F.size("ts").alias("dl"))
    itself = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size("ts").cast("long").alias("dl")))
    words = F.transform(F.array_distinct("ts"), lambda w: F.struct(w.alias("term"), F.lit(0).cast("long").alias("dl")))
    seen = cut(t.select(F.explode(F.concat(itself, words)).alias("x")).groupBy("x.term").agg(F.count("*").alias("df"), F.sum("x.dl").alias("dl")))
    corpus = seen.where("term is null").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    terms = seen.where("term is not null").select("term", "df")
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # The mean over terms, from the few different document frequencies.
    mean = terms.groupBy("df").agg(F.count("*").alias("k")).crossJoin(F.broadcast(corpus)).agg((F.sum(F.col("k") * raw) / F.sum("k")).alias("mean"))
    return {"words": t, "lengths": lengths, "corpus": corpus, "terms": terms, "mean": mean}


#: Different query terms that a broadcast may carry; more are joined by shuffle. So many stand in the plan and filter words before they become rows.
MOST_TERMS, LISTED = 1_000_000, 20_000


def bm25_scores(index: dict[str, DataFrame], queries: DataFrame, query: str, text: str) -> DataFrame:
    """``query, doc, score`` for documents that share a term with the query; a repeated query term counts again.

    Only words that some query has become postings.
    """
    q = cut(queries.select(F.col(query).alias("query"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf")))
    asked = q.select("term").distinct()
    n = asked.count()
    small = lambda d: F.broadcast(d) if n <= MOST_TERMS else d
    totals = index["corpus"].crossJoin(F.broadcast(index["mean"]))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    idf = index["terms"].join(small(asked), "term").crossJoin(F.broadcast(totals)).select("term", "avgdl", F.when(raw < 0, F.col("mean") * EPSILON).otherwise(raw).alias("idf"))
    words = index["words"].select("doc", F.size("ts").alias("dl"), "ts")
    if n <= LISTED:
        listed = [r.term for r in asked.collect()]
        words = words.select("doc", "dl", F.explode(F.filter("ts", lambda w: w.isin(listed))).alias("term"))
    else:
        words = words.select("doc", "dl", F.explode("ts").alias("term")).join(small(asked), "term")
    postings = words.groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weights = q.join(idf, "term")
    weights = F.broadcast(weights) if q.count() <= MOST_TERMS else weights
    # Rounded, as sums of the same parts in another order differ in their last digits, and equal documents would not tie.
    return postings.join(weights, "term").groupBy("query", "doc").agg(F.round(F.sum(part), 9).alias("score"))


def top_k(scores: DataFrame, k: int, by: str = "query", ties: Column | None = None, rounding: int | None = None) -> DataFrame:
    """The k best of each query, ties in ascending order of the document."""
    s = F.round("score", rounding) if rounding is not None else F.col("score")
    w = W.partitionBy(by).orderBy(F.desc("s"), ties if ties is not None else F.asc("doc"))
    return scores.withColumn("s", s).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("s")


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int, doc: str, text: str, query: str, query_text: str, rounding: int = 6) -> DataFrame:
    """Top k with documents of score zero filling up; a blank query has no result."""
    index = bm25_index(docs, doc, text)
    scores = bm25_scores(index, queries, query, query_text)
    live = queries.where(F.size(tokens(F.col(query_text))) > 0).select(F.col(query).alias("query"))
    # Only the first k documents by order can fill up, so k rows a query are enough.
    fill = index["lengths"].select("doc").orderBy("doc").limit(2 * k)
    zeros = live.crossJoin(F.broadcast(fill)).join(scores.select("query", "doc"), ["query", "doc"], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(scores.unionByName(zeros), k, rounding=rounding)


def valid_pattern(pattern: str, ignore_case: bool = True) -> str:
    """The pattern, escaped if it is none."""
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.sub(r"([\\.^$|?*+()\[\]{}-])", r"\\\1", pattern)
    return ("(?i)" if ignore_case else "") + pattern


def grep(docs: DataFrame, doc: str, text: str, pattern: str, k: int | None = None, ignore_case: bool = True) -> DataFrame:
    """Documents with their number of matches, most first; those without any are left out."""
    d = docs.select(F.col(doc).alias("doc"), F.regexp_count(text, F.lit(valid_pattern(pattern, ignore_case))).cast("double").alias("score")).where("score > 0")
    return d if k is None else d.orderBy(F.desc("score"), "doc").limit(k)


#: Queries of a block: as many travel to the documents by one broadcast or meet them in one cell.
BLOCK = 4096


def dealt(d: DataFrame, q: DataFrame, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both with ``block`` and ``slice``, so that every row of q (``query``, ...) meets every row of d (``doc``, ...) in one cell of bounded size."""
    blocks = max(1, -(-q.count() // BLOCK))
    slices = slices or max(1, -(-d.count() // (4 * BLOCK)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = q.withColumn("block", deal("query", blocks)).withColumn("slice", every(slices))
    d = d.withColumn("slice", deal("doc", slices)).withColumn("block", every(blocks))
    return d, q


def in_blocks(d: DataFrame, q: DataFrame) -> DataFrame:
    """Every row of q with every row of d. One block of queries is broadcast; of more, each meets each slice of the documents in a cell."""
    if q.count() <= BLOCK:
        return d.crossJoin(F.broadcast(q))
    d, q = dealt(d, q)
    return d.join(q.hint("shuffle_hash"), ["block", "slice"]).drop("block", "slice")


def grep_top_k(docs: DataFrame, queries: DataFrame, k: int, doc: str, text: str, query: str, pattern: str, ignore_case: bool = True) -> DataFrame:
    """``query, doc, score, rank``: the k documents with most matches of each query's pattern. The patterns are a column, so one pass over the documents matches a block of them."""

    @F.arrow_udf(T.StringType())
    def valid(patterns: pa.Array) -> pa.Array:
        return pa.array([None if p is None else valid_pattern(p, ignore_case) for p in patterns.to_pylist()], pa.string())

    q = queries.select(F.col(query).alias("query"), valid(F.col(pattern)).alias("pattern"))
    d = docs.select(F.col(doc).alias("doc"), F.col(text).alias("body"))
    score = F.regexp_count("body", F.col("pattern")).cast("double").alias("score")
    return top_k(in_blocks(d, q).select("query", "doc", score).where("score > 0"), k)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Zero where either vector is zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def _units(vectors: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the vectors of a dimension; those that are zero or not finite are left out."""
    fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False).to_numpy())
    m = pc.list_flatten(vectors.take(fits)).to_numpy().astype(float).reshape(-1, dim)
    with np.errstate(all="ignore"):
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
    sound = np.isfinite(m).all(axis=1)
    return fits[sound], m[sound]


#: Documents of a cell that are scored at a time.
STRIDE = 1024


def _best_of_cell(docs: pa.Table, queries: pa.Table, k: int, digits: int) -> pa.Table:
    """The k best documents of a cell for each of its queries: ``query, doc, score, rounded``.

    The score in units of its last digit and the document's place, ids descending,
    make one integer, so ties are settled and a partition finds the best.
    """
    if not len(docs) or not len(queries):
        return pa.table({})
    docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc", "descending")], null_placement="at_end"))
    n, m = len(docs), len(queries)
    keys, scores = np.empty((m, 0), np.int64), np.empty((m, 0))
    groups = []
    for dim in filter(None, pc.unique(pc.list_value_length(queries["v"])).to_pylist()):
        groups.append((*_units(queries["v"], dim), *_units(docs["v"], dim)))
    for at in range(0, n, STRIDE):
        to = min(n, at + STRIDE)
        part = np.zeros((m, to - at))
        for rows, q, places, d in groups:
            lo, hi = np.searchsorted(places, (at, to))
            part[np.ix_(rows, places[lo:hi] - at)] = q @ d[lo:hi].T
        key = np.rint(part * 10**digits).astype(np.int64) * n + np.arange(n - 1 - at, n - 1 - to, -1)
        keys, scores = np.hstack([keys, key]), np.hstack([scores, part])
        if keys.shape[1] > k:
            best = np.argpartition(keys, -k, axis=1)[:, -k:]
            keys, scores = np.take_along_axis(keys, best, 1), np.take_along_axis(scores, best, 1)
    rounded, place = np.divmod(keys.ravel(), n)
    return pa.table({
        "query": queries["query"].take(np.repeat(np.arange(m), keys.shape[1])),
        "doc": docs["doc"].take(n - 1 - place),
        "score": scores.ravel(),
        "rounded": rounded / 10.0**digits,
    })


def cosine_top_k(docs: DataFrame, doc: str, vector: str, queries: DataFrame, query: str, query_vector: str, k: int, rounding: int = 6) -> DataFrame:
    """``query, doc, score, rank``: the top k by cosine to ``rounding`` digits, ties in descending order of the document.

    A block of queries meets a slice of the documents in one matrix product, and
    each cell sends on only its k best of a query. A vector that is null, zero, not
    finite or of another length than the query scores zero, like any vector
    against such a query. ``doc`` is a key.
    """
    q = queries.select(F.col(query).alias("query"), doubles(F.col(query_vector)).alias("v"))
    d = docs.select(F.col(doc).alias("doc"), doubles(F.col(vector)).alias("v"))
    kinds = dict(q.dtypes)["query"], dict(d.dtypes)["doc"]
    d, q = dealt(d, q)
    cell = ("block", "slice")
    best = d.groupBy(*cell).cogroup(q.groupBy(*cell)).applyInArrow(lambda a, b: _best_of_cell(a, b, k, rounding), f"query {kinds[0]}, doc {kinds[1]}, score double, rounded double")
    w = W.partitionBy("query").orderBy(F.desc("rounded"), F.desc("doc"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rounded")


def fuse_max(*results: DataFrame, k: int | None = None) -> DataFrame:
    """Each document's best score over the retrievers, and its place."""
    u = results[0].select("query", "doc", "score")
    for r in results[1:]:
        u = u.unionByName(r.select("query", "doc", "score"))
    g = u.groupBy("query", "doc").agg(F.max("score").alias("score"))
    w = W.partitionBy("query").orderBy(F.desc("score"), "doc")
    g = g.withColumn("rank", F.row_number().over(w))
    return g if k is None else g.where(F.col("rank") <= k)


def rerank(results: DataFrame, scores: DataFrame, docs: DataFrame, doc: str, text: str, min_score: float | None = None, k: int | None = None) -> DataFrame:
    """Results under scores given from outside, clamped to 0..10; documents without content or score are dropped."""
    alive = docs.where(F.length(F.trim(F.col(text))) > 0).select(F.col(doc).alias("doc"))
    d = results.select("query", "doc").join(alive, "doc", "left_semi").join(scores, ["query", "doc"])
    d = d.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("score"))))
    if min_score is not None:
        d = d.where(F.col("score") >= min_score)
    w = W.partitionBy("query").orderBy(F.desc("score"), "doc")
    d = d.withColumn("rank", F.row_number().over(w))
    return d if k is None else d.where(F.col("rank") <= k)


def cache_split(docs: DataFrame, cache: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(documents whose content is in the cache, documents to compute), by id and content hash."""
    d = docs.withColumn("content_md5", F.md5(F.coalesce(F.col(text), F.lit(""))))
    keys = [doc, "content_md5"]
    return d.join(cache.select(*keys), keys, "left_semi"), d.join(cache.select(*keys), keys, "left_anti")


def cache_stats(cache: DataFrame, by: Sequence[str]) -> DataFrame:
    return cache.groupBy(*by).agg(F.count("*").alias("entries"), F.sum(F.size("embedding")).alias("numbers"))


#: Buckets of a corpus hash; a part of a knowledge base has so many characters, or one document.
BUCKETS, PART_CHARACTERS = 4_096, 50_000_000


def corpus_hash(docs: DataFrame, doc: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """One row: a SHA-256 that changes with any id or text, whatever the order or the partitions.

    A document's ``id:md5`` belongs to a bucket by the first digits of the MD5 of
    its id; a bucket is hashed over its items in order, the corpus over the
    hashes of its buckets in order. A bucket holds n / ``buckets`` items.
    """
    name = F.coalesce(F.col(doc).cast("string"), F.lit(""))
    bucket = (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % buckets).cast("int")
    item = F.concat(name, F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    each = docs.select(bucket.alias("b"), item.alias("i")).groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("i")), "|"), 256).alias("h"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "|")
    return each.agg(F.sha2(whole, 256).alias("corpus_sha256"))


def full_text(docs: DataFrame, order: str, title: str, text: str, part_characters: int = PART_CHARACTERS) -> DataFrame:
    """``part, knowledge_base``: all documents as one text, in order, in parts of about ``part_characters`` that follow each other by an empty line."""
    item = F.concat(F.lit("# "), F.col(title), F.lit("\n"), F.col(text))
    d = docs.select(F.col(order).alias("o"), item.alias("t")).where("t is not null")
    d = running_total(d, [F.asc("o"), F.asc("t")], F.length("t"), "end")
    part = F.floor((F.col("end") - F.length("t")) / part_characters).cast("long")
    parts = F.sort_array(F.collect_list(F.struct("end", "o", "t")))
    return d.groupBy(part.alias("part")).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("knowledge_base"))
