"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared
with those of its language by Jensen-Shannon distance (base 2, so 0 to 1). The
references come from the documents themselves, all of them: the shares of the
classes are medians over the documents of a language (of shares in thousandths,
so that a table of at most 1,001 rows a class gives them exactly, and capitals
or tables in a few documents don't move them); its common words are the
``COMMON`` most frequent terms, with their share of all its terms.

A histogram of few characters or words is far from any reference by chance, so
short documents are not judged by it (``MIN_CHARS``, ``MIN_TERMS``) and the
limit falls with the length. Documents without a language have no reference and
pass this part; in a language of fewer than ``MIN_DOCUMENTS`` texts they pass the
part of the classes.

Fixed rules come before: too few words, or too many words inside five-word
windows that repeat. Everything is a column expression; a text's windows are
compared by hash and sorted within its row, in n log n steps.

A null text is an empty one and fails the rules; equal rows get equal results; an
empty table gives an empty result; other columns are kept as they are unless a
new one has the name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.llm.common import WORD, cut, shape

COMMON = 24
MIN_DOCUMENTS = 20
MIN_CHARS, MIN_TERMS = 100, 100
#: Limits of the distances for long texts, and what they get for a text of n characters (terms), divided by n.
CHARS_LIMIT, CHARS_SLACK = 0.17, 20.0
TERMS_LIMIT, TERMS_SLACK = 0.3, 10.0
WINDOW, FEWEST_WORDS, MOST_REPEATED = 5, 10, 20
#: Hashes that are looked up one by one.
FEW = 32
#: References that are broadcast; more of them are joined by language and salt.
MOST_BROADCAST = 1_000
SALTS = 32

SPACE = r"[\x20\x09-\x0D]"
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Classes of characters that are counted, beside white space; all others are the last class, lower-case ASCII for the most part.
CLASSES = {
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "mark": r"[.,;:!?'\x22()\x2D]",
    "beyond": r"[^\x00-\x7F]",
    "symbol": r"[\x00-\x08\x0E-\x1F#$%&*+/<=>@\x5B-\x60{|}~\x7F]",
}
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body (or a lambda in it) reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), BREAK), "")


def rare(text: Column) -> Column:
    """The text without lower-case ASCII and white space: what the other classes are counted in."""
    return F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", "")


def class_counts(text: Column, rare: Column, in_words: Column) -> Column:
    """Code points of each class, of white space, then the rest."""
    counts = F.array(*[F.regexp_count(rare, F.lit(p)).cast("long") for p in CLASSES.values()], (F.length(text) - in_words).cast("long"))
    return let(counts, lambda c: F.concat(c, F.array(F.length(text) - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))))


def in_words(found: Column) -> Column:
    """Code points in the words."""
    return F.length(F.array_join(found, "")).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(found: Column) -> Column:
    """Words inside ``WINDOW``-word windows that the array of words holds twice or more, each word once."""

    def after(x: Column, k: int) -> Column:
        return F.slice(x, F.lit(k + 1), F.greatest(F.size(x) - k, F.lit(0)))

    def paired(x: Column, y: Column) -> Column:
        return F.zip_with(x, y, lambda a, b: F.xxhash64(a, b))

    def windows(w: Column) -> Column:
        """Hashes of five words: of two, of four by two pairs, then the fifth."""
        fours = let(paired(w, after(w, 1)), lambda two: paired(two, after(two, 2)))
        return F.slice(paired(fours, after(w, 4)), F.lit(1), F.size(w) - (WINDOW - 1))

    def places(h: Column) -> Column:
        """Places of the hashes that occur again, in order. A few are looked up one by one, many are sorted with their places."""
        ordered = F.sort_array(h)
        twice = let(ordered, lambda s: F.array_distinct(F.filter(s, lambda x, j: x == F.get(s, j - 1))))
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        by_sort = let(pairs, lambda s: F.filter(s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))))
        marked = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return let(twice, lambda t: F.when(F.size(t) <= FEW, F.transform(F.filter(marked, lambda x: F.array_contains(t, x["h"])), lambda x: x["i"])).otherwise(F.sort_array(F.transform(by_sort, lambda x: x["i"]))))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def count(w: Column) -> Column:
        return let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(places(h))).otherwise(0))

    hashed = F.transform(found, lambda x: F.xxhash64(x))
    return let(hashed, lambda w: F.when(F.size(w) > WINDOW, count(w)).otherwise(0)).cast("long")


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, from 0 to 1."""

    def half(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log(2 * x / (x + y))).otherwise(0.0)

    divergence = total(F.zip_with(p, q, lambda x, y: half(x, y) + half(y, x))) / 2 / F.log(F.lit(2.0))
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def common_terms(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """``lang, common, common_shares``: the most frequent terms of each language and their shares of all its terms."""
    d = docs.select(lang.alias("lang"), text.cast("string").alias("text")).where("lang is not null")
    # Two plans need the counts; written once, they don't read the texts twice.
    seen = cut(d.select("lang", F.explode(terms(F.col("text"))).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n")))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "term"))
    top = seen.select("*", first.alias("rank")).where(F.col("rank") <= COMMON)
    sums = seen.groupBy("lang").agg(F.sum("n").cast("double").alias("all"))
    common = top.join(sums, "lang").groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "term", F.try_divide("n", "all").alias("share")))).alias("c"))
    return cut(common.select("lang", F.transform("c", lambda x: x["term"]).alias("common"), F.transform("c", lambda x: x["share"]).alias("common_shares")))


def class_shares(measured: DataFrame) -> DataFrame:
    """``lang, class_shares``: median shares of the classes over the texts of each language that has enough of them."""
    shares = measured.where("lang is not null and chars > 0").select("lang", F.transform("classes", lambda x: F.floor(F.try_divide(1000 * x, F.col("chars")))).alias("s"))
    counted = shares.select("lang", F.posexplode("s").alias("class", "share")).groupBy("lang", "class", "share").agg(F.count("*").alias("n"))
    each = W.partitionBy("lang", "class")
    up_to = F.sum("n").over(each.orderBy("share").rowsBetween(W.unboundedPreceding, 0))
    counted = counted.select("*", up_to.alias("up_to"), F.sum("n").over(each).alias("docs"))
    medians = counted.where((2 * F.col("up_to") >= F.col("docs")) & (F.col("docs") >= MIN_DOCUMENTS)).groupBy("lang", "class").agg(F.min("share").cast("double").alias("m"))
    lists = medians.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("class", "m"))), lambda x: x["m"]).alias("m"))
    return cut(lists.select("lang", let(total(F.col("m")), lambda s: F.transform("m", lambda x: F.try_divide(x, s))).alias("class_shares")))


def beside_language(d: DataFrame, known: DataFrame, by: Column) -> DataFrame:
    """``d`` with the row of its language: broadcast if there are few, else joined by language and salt, as a language may hold most rows."""
    if known.count() <= MOST_BROADCAST:
        return d.join(F.broadcast(known), "lang", "left")
    dealt = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return d.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(dealt, ["lang", "salt"], "left").drop("salt")


def measures(d: DataFrame) -> DataFrame:
    """Of ``row, lang, text, common, common_shares`` the counts of the rules, the classes, and the distance from the common terms."""
    text = F.col("text")

    def apart(common: Column, found: Column) -> Column:
        hits = F.filter(found, lambda t: F.array_contains(common, t))
        counts = let(hits, lambda h: F.concat(F.transform(common, lambda w: F.size(h) - F.size(F.array_remove(h, w))), F.array(F.size(found) - F.size(h))))
        shares = F.transform(counts, lambda c: F.try_divide(c, F.size(found)))
        return distance(shares, let(F.col("common_shares"), lambda q: F.concat(q, F.array(F.greatest(F.lit(1.0) - total(q), F.lit(0.0))))))

    judged = (F.size("common") > 0) & (F.length(text) >= MIN_TERMS)
    by_terms = let(terms(text), lambda t: F.struct(F.size(t).alias("n"), F.when(F.size(t) >= MIN_TERMS, let(F.transform("common", lambda c: c), lambda c: apart(c, t))).alias("far")))
    by_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), in_words(w).alias("chars"), repeated_words(w).alias("again")))
    d = d.select("row", "lang", "text", by_words.alias("w"), rare(text).alias("rare"), duplicate_lines(text).alias("n_dup_lines"), F.when(judged, by_terms).alias("t"))
    symbols = F.regexp_count("rare", F.lit(SYMBOLS)).cast("long")
    return d.select("row", "lang", "w", "t", "n_dup_lines", symbols.alias("n_symbols"), F.length("text").alias("chars"), class_counts(text, F.col("rare"), F.col("w.chars")).alias("classes"))


def judge(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` (default: all) with the counts of the rules, ``base_failed``, both distances (null: not judged by it) and ``kept``."""
    shape(docs, text_col, lang_col)
    text, lang = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{lang_col}`")
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_distance", "terms_distance")
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    known = common_terms(docs, text, lang)
    d = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"), lang.alias("lang"))
    # The medians come from what is measured here; written once, it serves them and the verdicts.
    measured = cut(measures(beside_language(d, known, F.col("text"))))
    d = beside_language(measured, class_shares(measured), F.xxhash64("row"))
    shares = F.transform("classes", lambda c: F.try_divide(c, F.col("chars")))
    d = d.withColumn("chars_far", F.when((F.col("chars") >= MIN_CHARS) & F.col("class_shares").isNotNull(), distance(shares, F.col("class_shares"))))
    failed = (F.col("w.n") < FEWEST_WORDS) | (100 * F.col("w.again") > MOST_REPEATED * F.col("w.n"))
    strange = F.coalesce(F.col("chars_far") > CHARS_LIMIT + F.try_divide(F.lit(CHARS_SLACK), F.col("chars")), F.lit(False)) | F.coalesce(F.col("t.far") > TERMS_LIMIT + F.try_divide(F.lit(TERMS_SLACK), F.col("t.n")), F.lit(False))
    values = (F.col("w.n"), F.col("w.chars"), F.col("n_symbols"), F.col("n_dup_lines"), F.col("w.again"), failed, ~failed & ~strange, F.round("chars_far", 6), F.round("t.far", 6))
    return d.select(*[F.col("row").getField(c).alias(c) for c in keep], *[v.alias(n) for n, v in zip(new, values)])


def drop_failing(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with their columns as they are, that the rules and their language's reference keep."""
    shape(docs, text_col, lang_col)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    return judge(whole, keep=["whole"]).where("kept").select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])
