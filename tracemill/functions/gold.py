"""Gold scripts: messages of numbered chunks, some of which a listener has received.

``<message uuid="u" active="0,2"><chunk id=0>Hel</chunk>...</message>``: scripts are
read into structs, merged as structs and written again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MESSAGE = r'(?s)<message uuid="[^"]+"[^>]*>.*?</message>'


def _all(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def messages(script: Column) -> Column:
    """``array<struct<uuid, active: array<int>, chunks: array<struct<id, text>>>>`` of a script, in order; null and what holds no message give an empty array."""

    def one(m: Column) -> Column:
        active = F.filter(F.split(F.regexp_extract(m, r'active="([^"]*)"', 1), ","), lambda x: x.rlike(r"^\d+$"))
        chunk = r"<chunk id=(\d+)>([^<]*)</chunk>"
        chunks = F.zip_with(_all(m, chunk, 1), _all(m, chunk, 2), lambda i, t: F.struct(i.cast("int").alias("id"), t.alias("text")))
        return F.struct(F.regexp_extract(m, r'uuid="([^"]+)"', 1).alias("uuid"), F.transform(active, lambda x: x.cast("int")).alias("active"), chunks.alias("chunks"))

    return F.transform(_all(F.coalesce(script, F.lit("")), _MESSAGE, 0), one)


def written(uuid: Column, active: Column, chunks: Column) -> Column:
    """A message as text; its active ids sorted, each once."""
    ids = F.array_join(F.transform(F.array_sort(F.array_distinct(active)), lambda x: x.cast("string")), ",")
    body = F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("<chunk id="), c["id"].cast("string"), F.lit(">"), c["text"], F.lit("</chunk>"))), "")
    return F.concat(F.lit('<message uuid="'), uuid, F.lit('" active="'), ids, F.lit('">'), body, F.lit("</message>"))


def plain_text(script: Column) -> Column:
    """The text without tags."""
    return F.regexp_replace(script, r"</?(?:message|chunk)[^>]*>", "")


def received_text(script: Column) -> Column:
    """The text of the chunks that have been received, in order."""

    def own(m: Column) -> Column:
        return F.array_join(F.transform(F.filter(m["chunks"], lambda c: F.array_contains(m["active"], c["id"])), lambda c: c["text"]), "")

    return F.array_join(F.transform(messages(script), own), "")


def merge(df: DataFrame, by: Sequence[str], order: str, script: str) -> DataFrame:
    """``by, script, received, chunks`` of each group: every message once, in order of its first appearance, its active ids from all scripts, its chunks from the first.

    Messages meet by group and uuid, so a long group is spread over its messages. Groups without a message have none.
    """
    m = df.select(*by, F.col(order).alias("_at"), F.posexplode(messages(F.col(script))).alias("_k", "m")).select(*by, "_at", "_k", "m.*")
    place = F.struct("_at", "_k")
    g = m.groupBy(*by, "uuid").agg(F.min(place).alias("place"), F.min_by("chunks", place).alias("chunks"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("active")))).alias("active"))
    item = F.struct("place", written(F.col("uuid"), F.col("active"), F.col("chunks")).alias("text"))
    out = g.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["text"]), "").alias("script"), F.sum(F.size("active")).alias("received"), F.sum(F.size("chunks")).alias("chunks"))
    return out
