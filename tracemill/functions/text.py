"""Text functions: denoising, formatting, codecs, hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The noise that is cut from assertions and from free text, and words of consent.
VALUE_NOISE = r"""(?U)(#\w+|\$[\d,.]+|\b\d[\d,.]*\b|'[^']*'|"[^"]*")"""
FREE_NOISE = r"(?U)(#\w+|\$[\d,.]+|\b\d[\d,.]*\b|`[^`]*`)"
CONFIRM_WORDS = ("yes", "yeah", "yep", "confirm", "confirmed", "go ahead", "please do", "that's correct")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def denoise_value(c: Column) -> Column:
    """Without ids, amounts, numbers and quotations; lower case."""
    return F.lower(squeeze(F.regexp_replace(F.coalesce(c, F.lit("")), VALUE_NOISE, "")))


def unwrap_message(c: Column) -> Column:
    """The ``message`` of a JSON object, else the text itself, trimmed."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.coalesce(F.get_json_object(t, "$.message"), t)


def denoise_free(c: Column, cap: int = 200) -> Column:
    """Letters and spaces of a free text without its values, lower case, at most ``cap`` characters."""
    t = F.regexp_replace(unwrap_message(c), FREE_NOISE, " ")
    t = F.regexp_replace(t, "[^a-zA-Z ]+", " ")
    return F.substring(F.lower(F.trim(F.regexp_replace(t, r"\s+", " "))), 1, cap)


def confirms(c: Column, words: Sequence[str] = CONFIRM_WORDS) -> Column:
    return F.coalesce(c.rlike(r"(?iU)\b(" + "|".join(words) + r")\b"), F.lit(False))


def mentions(messages: Column, needle: Column) -> Column:
    """Whether a message holds the needle, whatever the case; commas are cut from the message only."""
    return F.exists(messages, lambda m: F.contains(F.replace(F.lower(m), F.lit(","), F.lit("")), F.lower(needle)))


def captured(c: Column, pattern: str, group: int = 1) -> Column:
    """A captured group; raises where the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group)).otherwise(F.raise_error(F.concat(F.lit("no match: "), c)).cast("string"))


def call_text(name: Column, args: Column) -> Column:
    """``name(k=v, ...)`` of a map of texts, in its order."""
    pairs = F.transform(F.map_entries(args), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(name, F.lit("("), F.array_join(pairs, ", "), F.lit(")"))


def call_parse(c: Column) -> Column:
    """The struct (name, arguments) of ``name(k=v, ...)``; null for any other text."""
    body = F.regexp_extract(c, r"^(\w+)\((.*)\)$", 2)
    args = F.transform(F.filter(F.split(body, ", "), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_extract(p, "=(.*)$", 1).alias("value")))
    return F.when(c.rlike(r"^\w+\(.*\)$"), F.struct(F.regexp_extract(c, r"^(\w+)\(", 1).alias("name"), F.map_from_entries(args).alias("arguments")))


def snippet(c: Column, n: int = 60) -> Column:
    """The first n characters on one line, with an ellipsis where something is cut."""
    t = F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" "))
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def truncate(c: Column, n: int) -> Column:
    """The first n characters and the number of those that are left out."""
    t = F.trim(c)
    cut = F.concat(F.rtrim(F.substring(t, 1, n)), F.lit(" …(+"), (F.length(t) - n).cast("string"), F.lit(" chars)"))
    return F.when(F.length(t) > n, cut).otherwise(t)


def truncate_middle(c: Column, n: int) -> Column:
    """n characters of a long text, two thirds from its start, around a note of what is left out."""
    head = n * 2 // 3
    note = F.concat(F.lit("\n… ("), (F.length(c) - n).cast("string"), F.lit(" chars elided) …\n"))
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, head)), note, F.ltrim(F.right(c, F.lit(n - head))))).otherwise(c)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def file_name(c: Column) -> Column:
    """A text that is safe as a file name: anything but letters, digits, dots, dashes and underscores becomes an underscore."""
    t = F.replace(c, F.lit(".."), F.lit("_"))
    return F.substring(F.regexp_replace(t, r"[^\p{L}\p{N}._-]", "_"), 1, 255)


def json_in(c: Column) -> Column:
    """The first JSON object in a text, fenced or not, if it parses."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    ok = lambda t: F.when((t != "") & F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(ok(fenced), ok(bare))


def deterministic_id(seed: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(seed, 256), 1, n)


def word_grams(words: Column, n: int) -> Column:
    """The n-grams of an array of words, joined by spaces."""
    # Shifted copies side by side: inside a lambda the words would be made anew for each place.
    size = F.greatest(F.lit(0), F.size(words) - n + 1)
    grams = F.slice(words, F.lit(1), size)
    for k in range(1, n):
        grams = F.zip_with(grams, F.slice(words, F.lit(k + 1), size), lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def char_grams(words: Column, lo: int, hi: int) -> Column:
    """Character n-grams within words padded by a space on both sides; a word shorter than n gives itself once."""

    def of(word: Column, n: int) -> Column:
        p = F.concat(F.lit(" "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(p) - n + 1)), lambda i: F.substr(p, i, F.lit(n)))

    def grams(n: int) -> Column:
        # A longer gram skips words that a shorter one has swallowed whole.
        fits = words if n == lo else F.filter(words, lambda w: F.length(w) + 2 >= n)
        return F.flatten(F.transform(fits, lambda w: of(w, n)))

    return F.concat(*[grams(n) for n in range(lo, hi + 1)])


def merge_chunks(chunks: Column) -> Column:
    """Texts of ordered chunks (struct: text, ids) in one; a space between two with ids that share none."""
    zero = F.struct(F.lit("").alias("text"), F.lit(None).cast("array<string>").alias("ids"))

    def step(acc: Column, c: Column) -> Column:
        apart = (F.size(acc["ids"]) > 0) & (F.size(c["ids"]) > 0) & ~F.arrays_overlap(acc["ids"], c["ids"])
        return F.struct(F.concat(acc["text"], F.when(F.coalesce(apart, F.lit(False)), " ").otherwise(""), F.coalesce(c["text"], F.lit(""))).alias("text"), F.coalesce(c["ids"], acc["ids"]).alias("ids"))

    return F.aggregate(chunks, zero, step)["text"]


def xml_texts(c: Column, tag: str) -> Column:
    """The bodies of all elements of a tag."""
    return F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}\b[^>]*>(.*?)</{tag}>"), F.lit(1))


def insert_words(text: Column, insert: Column, seed: Column, least: int = 3) -> Column:
    """``insert`` at a word position that depends on the seed; short texts stay as they are."""
    words = F.split(text, " ")
    at = F.pmod(F.xxhash64(seed), F.size(words) - 1).cast("int") + 1
    joined = F.array_join(F.concat(F.slice(words, F.lit(1), at), F.array(insert), F.slice(words, at + 1, F.size(words))), " ")
    return F.when(F.size(words) > least, joined).otherwise(text)


#: Parts of paths that say nothing about a difference.
SKIP = ("orders", "users", "products", "*", "")


def signature_tokens(c: Column) -> Column:
    """A state signature (``kind:path;kind:path``) as words: kinds and the parts of paths that say something."""

    def words(item: Column) -> Column:
        path = F.when(F.contains(item, F.lit(":")), F.substr(item, F.instr(item, ":") + 1)).otherwise("")
        parts = F.transform(F.split(path, r"\."), lambda p: F.replace(p, F.lit("[]"), F.lit("")))
        return F.concat(F.array(F.substring_index(item, ":", 1)), F.filter(parts, lambda p: ~p.isin(*SKIP)))

    return F.when(F.length(c) > 0, F.array_join(F.flatten(F.transform(F.split(c, ";"), words)), " ")).otherwise("")


#: What was done to an order, by the fields that it changes.
DEEDS = (
    ("cancel order", ("cancel_reason",)),
    ("return items", ("return_items", "return_payment_method_id")),
    ("exchange items", ("exchange_items", "exchange_new_items", "exchange_payment_method_id", "exchange_price_difference")),
    ("modify order items", ("items",)),
)
#: Where an address belongs, by the first part of its path.
ADDRESSES = (("change order address", "orders"), ("change user address", "users"))


def deeds(paths: Column) -> Column:
    """What was done, out of the paths (arrays of parts) that changed, as texts in a fixed order.

    Fields are told by whole parts. Paths of payments and states speak only where
    nothing else does, and where they don't either the last parts of all paths do.
    """
    parts = F.flatten(paths)
    has = lambda *names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    found = [F.when(has(*fields), text) for text, fields in DEEDS]
    found += [F.when(F.exists(paths, lambda p: (F.size(p) > 1) & (F.get(p, F.lit(0)) == table) & F.array_contains(p, "address")), text) for text, table in ADDRESSES]
    found.append(F.when(has("payment_methods"), F.when(has("balance"), "gift-card balance").otherwise("modify payment method")))
    named = F.array_compact(F.array(*found))
    last = F.array_sort(F.array_distinct(F.transform(paths, lambda p: F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit("")))))
    rest = F.when(has("payment_history"), F.array(F.lit("order payment/refund"))).when(has("status"), F.array(F.lit("order status"))).otherwise(last)
    return F.when(F.size(named) > 0, named).otherwise(rest)


def signature_gloss(c: Column) -> Column:
    """A cluster's signature for readers: what was missed, wrong or too much as deeds, statements, tools."""

    def state(s: Column) -> Column:
        items = F.filter(F.split(s, ";"), lambda x: F.contains(x, F.lit(":")))

        def of(kind: str, verb: str) -> Column:
            own = F.filter(items, lambda x: F.startswith(x, F.lit(f"{kind}:")))
            paths = F.transform(own, lambda x: F.filter(F.split(F.replace(F.substr(x, F.lit(len(kind) + 2)), F.lit("[]"), F.lit("")), r"\."), lambda p: ~p.isin("*", "")))
            return F.when(F.size(own) > 0, F.concat(F.lit(f"{verb}: "), F.array_join(deeds(paths), ", ")))

        return F.array_join(F.array_compact(F.array(of("missed", "missing"), of("wrong", "wrong"), of("extra", "extra"))), " · ")

    def one(p: Column) -> Column:
        rest = lambda k: F.substr(p, F.lit(k + 1))
        return (
            F.when(F.startswith(p, F.lit("db=")), F.nullif(state(rest(3)), F.lit("")))
            .when(F.startswith(p, F.lit("nl=")), F.concat(F.lit("says: "), rest(3)))
            .when(F.startswith(p, F.lit("chain=")), F.concat(F.lit("tools: "), F.replace(rest(6), F.lit("->"), F.lit(" → "))))
            .otherwise(p)
        )

    return F.when(F.length(c) > 0, F.array_join(F.array_compact(F.transform(F.split(c, r" \| "), one)), " | ")).otherwise("")


def as_texts(c: Column, kind: T.DataType) -> Column:
    """A value with every number and boolean in it as text (``True``, ``1.5``), dates in ISO form; texts and nulls stay."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[as_texts(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: as_texts(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: as_texts(v, kind.valueType))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return c.cast("string")


def json_of_texts(c: Column, kind: T.DataType) -> Column:
    """The JSON of :func:`as_texts`; a text stays as it is."""
    return c if isinstance(kind, T.StringType) else F.to_json(as_texts(c, kind), {"ignoreNullFields": "false"})
