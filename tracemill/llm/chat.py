"""Chat formatting: turn-aligned windows within a token budget, with loss masks.

Prefix sums of turn tokens cut a conversation into spans: the turns that start
in the same stretch of ``stride`` tokens share a window, so a window's own
turns exceed the stride by less than its last turn. Every later window starts
with the conversation's system turn and with as many of the preceding window's
last turns as fit ``history`` tokens. The loss mask covers assistant texts,
each only in the window that owns it: repeated targets are masked out.

The template writes a turn as ``<|role|>``, a line feed, the text, ``</s>``
and a line feed. Inside roles and texts the characters ``\\``, ``<``, ``[`` and
``|`` are written as ``\\e``, ``\\l``, ``\\b`` and ``\\p``, so no control string of this or
another bracketed template can occur there, and reading back is exact.

A null text or role counts as empty, turns sort by number (null first), then
role and text, so repeated rows stay; rows of a null conversation form one
conversation; an empty table gives an empty result; other columns are ignored.
Windows are the unit of work: only a digest gathers a conversation. Turns are
numbered within their conversation by one sort, which spills, so a conversation
with a large share of all rows takes one long task, not more memory. A stride below
one or a negative history raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.llm.common import shape

END = "</s>\n"
#: Written form of each character that must not occur in a text; the escape character first.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("|", "\\p"))


def escape(text: Column) -> Column:
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def tokens(text: Column) -> Column:
    """A token estimate: a quarter of the characters, rounded up, and four for the turn's marks."""
    return F.ceil(F.length(text) / 4).cast("long") + 4


def chat_windows(
    turns: DataFrame,
    *,
    stride: int = 512,
    history: int = 128,
    n_tokens: Column | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row a window: ``conv_id, window, formatted, n_repeated, n_turns, loss``.

    ``n_repeated`` of the ``n_turns`` turns, the first, are repeats; ``loss`` is an
    array of (start, end) code points in ``formatted``, ends exclusive.
    """
    shape(turns, conv_col, turn_col, role_col, text_col)
    if stride < 1 or history < 0:
        raise ValueError("stride must be positive, history not negative")
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        text.alias("text"),
        (tokens(text) if n_tokens is None else F.greatest(F.coalesce(n_tokens, F.lit(1)).cast("long"), F.lit(1))).alias("n"),
    )
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    d = d.select("*", F.row_number().over(order).alias("pos"), (F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("start"))
    d = d.withColumn("span", F.floor(F.col("start") / stride))
    by_span = W.partitionBy("conv_id").orderBy("span")
    whole = W.partitionBy("conv_id")
    system = F.when(F.col("role") == "system", F.struct("pos", "role", "text"))
    d = d.select(
        "*",
        F.min(F.struct("span", "start")).over(by_span.rangeBetween(1, W.unboundedFollowing)).alias("next"),
        F.min(system).over(whole).alias("system"),
        F.dense_rank().over(by_span).alias("rank"),
    )
    # The copy in the next window, if the turn is near enough to its start.
    own = F.struct(F.col("rank").alias("window"), F.lit(2).alias("kind"), "pos", "role", "text")
    again = F.struct((F.col("rank") + 1).alias("window"), F.lit(1).alias("kind"), "pos", "role", "text")
    near = F.col("next").isNotNull() & (F.col("start") >= F.col("next.start") - history) & (~F.coalesce(F.col("pos") == F.col("system.pos"), F.lit(False)))
    # The first turn of a later window brings the system turn along.
    first = F.row_number().over(W.partitionBy("conv_id", "span").orderBy("pos")) == 1
    d = d.withColumn("first", first)
    lead = F.struct(F.col("rank").alias("window"), F.lit(0).alias("kind"), F.col("system.pos").alias("pos"), F.col("system.role").alias("role"), F.col("system.text").alias("text"))
    brings = F.col("first") & (F.col("rank") > 1) & F.col("system").isNotNull() & (F.col("system.pos") < F.col("pos"))
    d = d.select("conv_id", F.explode(F.array_compact(F.array(F.when(brings, lead), F.when(near, again), own))).alias("t"))
    g = d.groupBy("conv_id", F.col("t.window").alias("window")).agg(F.sort_array(F.collect_list(F.struct("t.kind", "t.pos", "t.role", "t.text"))).alias("ts"))
    head = lambda t: F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n"))
    g = g.withColumn("parts", F.transform("ts", lambda t: F.struct(t["kind"].alias("kind"), t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body"))))
    g = g.withColumn("formatted", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("loss"))

    def add(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["body"])
        target = (p["kind"] == 2) & (p["role"] == "assistant")
        return F.struct((end + len(END)).alias("at"), F.when(target, F.array_append(acc["loss"], F.struct(start.alias("start"), end.alias("end")))).otherwise(acc["loss"]).alias("loss"))

    return g.select(
        "conv_id",
        F.col("window").cast("int").alias("window"),
        "formatted",
        F.size(F.filter("ts", lambda t: t["kind"] < 2)).alias("n_repeated"),
        F.size("ts").alias("n_turns"),
        F.aggregate("parts", zero, add)["loss"].alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Parse formatted windows: per window the turns it owns, as ``turns`` (role, text), and its ``targets`` (texts under the mask)."""
    parts = F.expr(r"slice(split(formatted, '</s>\n'), n_repeated + 1, n_turns - n_repeated)")
    turn = lambda s: F.struct(
        unescape(F.substring(F.substring_index(s, "|>\n", 1), 3, 2**31 - 1)).alias("role"),
        unescape(F.substr(s, F.instr(s, "|>\n") + 3)).alias("text"),
    )
    return windows.select("conv_id", "window", "formatted", F.transform(parts, turn).alias("turns"), F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), x["start"] + 1, x["end"] - x["start"]))).alias("targets"))


def chat_digest(windows: DataFrame) -> DataFrame:
    """One row a conversation: counts and SHA-256 digests of what :func:`read_back` gives."""
    r = read_back(windows).select("conv_id", F.struct("window", F.length("formatted").alias("size"), "turns", "targets").alias("w"))
    g = r.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    turns = F.flatten(F.transform("ws", lambda w: w["turns"]))
    loss = F.array_join(F.flatten(F.transform("ws", lambda w: w["targets"])), "")
    return g.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w["size"]).alias("formatted_chars"),
        F.size("ws").alias("n_windows"),
    )
