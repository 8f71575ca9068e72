"""SimHash near-duplicates by multi-index hashing.

Contract form (``fingerprints``): a text, with A-Z lower-cased, gives word
shingles; a bit of its fingerprint is set where more than half of the shingles'
XXH64 hashes have it set. Wide form (``wide_fingerprints``), for the similarity
of the pipeline: 64 bits of the different two-word shingles find candidates,
128 bits of the different five-word shingles judge them. (At a similarity of 0.8
of five-word shingles some 10 of 64 bits of their own differ, too many to look up;
of the two-word ones about 6 do.)

The 64 bits are cut into segments. A fingerprint is entered under every value in
the Hamming ball of radius one around each segment, so two fingerprints meet in
a segment just if they differ there in at most two bits; by the pigeonhole
principle none within 3 x segments - 1 bits is missed. What meets is verified
on all bits. A pair that meets several times counts in one place only: in its
first segment, exact values before flipped ones. A key under which many
fingerprints meet is dealt out as pairs of blocks, of which a task holds two;
there a spanning forest stands for the links, found by taking each linked one
off the list, so thousands of near copies of one text cost no square of them.

Equal fingerprints are one node, so copies cost nothing. A null or blank text
has fingerprint zero and links like any other. Null ids come last: a component
takes the smallest id that is not null. Repeated rows keep their rows. An empty
table gives an empty result. Columns of any name may be kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import SALTS, add_columns, beside, cut, hashable, row_hash, shape
from tracemill.llm.components import connected_components

SEED = 42
RADIUS = 4
SEGMENTS = 2
#: The wide form: segments, bits of two-word shingles and of five-word shingles that may differ. Of 128 bits, 19 differ on average at a similarity of 0.8.
WIDE_SEGMENTS, WIDE_RADIUS, CHECK_RADIUS = 3, 12, 28
#: Fingerprints under one key that a block holds, and from how many on a spanning forest stands for the links.
BLOCK = 4096
FEW = 64
#: Most keys in blocks whose table is broadcast (16 bytes each); beyond it, it is joined by a shuffle.
MOST_BROADCAST = 200_000


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    last = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    h = [digest(joined[a:b], SEED) for a, b in zip(starts[:last].tolist(), (starts + lengths)[width - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    hashes = np.array(h, np.uint64)
    for k in range(0, len(h), 65536):
        part = hashes[k : k + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: Column, width: int = 4, /, **keep: Column) -> DataFrame:
    """Columns ``keep`` and ``fp``, the fingerprint as a signed 64-bit number."""

    def start():
        return lambda texts: [pa.array(np.array([fingerprint(x, width) for x in texts.to_pylist()], np.uint64).view(np.int64))]

    return add_columns(df, keep, [text.cast("string").cast("binary")], [T.StructField("fp", T.LongType())], start)


def _mix(h: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit generator: every bit depends on all."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Different hashes of runs of ``width`` words, of all words if there are fewer."""
    width = min(width, len(words))
    last = len(words) - width + 1
    h = np.zeros(last, np.uint64)
    for k in range(width):
        h = _mix(h * np.uint64(31) + words[k : k + last] + np.uint64(k))
    return np.unique(h)


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


class WordHashes(dict):
    """Hashes of words, each made once."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def wide_fingerprint(text: bytes | None, known: WordHashes | None = None) -> tuple[int, int, int]:
    """(index, node, check), signed: 64 bits of two-word shingles, and two times 64 of five-word shingles. ``known`` keeps hashes of words."""
    known = WordHashes() if known is None else known
    words = (text or b"").lower().split()
    if not words:
        return 0, 0, 0
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    five = _shingles(h, 5)
    return _majority(_shingles(h, 2)), _majority(five), _majority(_mix(five + np.uint64(1)))


def wide_fingerprints(df: DataFrame, text: Column, /, **keep: Column) -> DataFrame:
    """Columns ``keep`` and ``index``, ``five`` and ``check``, and ``fp``, a hash of the three that names the node: what differs in any is told apart."""

    def start():
        def step(texts: pa.Array) -> list[pa.Array]:
            known = WordHashes()
            return [pa.array(x, pa.int64()) for x in zip(*[wide_fingerprint(x, known) for x in texts.to_pylist()])]

        return step

    new = [T.StructField(n, T.LongType()) for n in ("index", "five", "check")]
    return add_columns(df, keep, [text.cast("string").cast("binary")], new, start).withColumn("fp", F.xxhash64("index", "five", "check"))


def segment_widths(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each segment."""
    cuts = [64 * k // segments for k in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _value(index: Column, segment: int, first: int, width: int) -> Column:
    """A segment's value, with the segment's number in front."""
    return F.shiftrightunsigned(index, first).bitwiseAND((1 << width) - 1).bitwiseOR(segment << 40)


def _balls(values: Column, segments: int) -> Column:
    """All keys of a fingerprint: its segments' values, and these with one bit flipped."""
    keys = []
    for n, (_, width) in enumerate(segment_widths(segments)):
        v = F.element_at(values, n + 1)
        keys += [v, *[v.bitwiseXOR(F.lit(1 << k).cast("long")) for k in range(width)]]
    return F.array(*keys)


def _crowded(nodes: DataFrame, segments: int) -> DataFrame:
    """``key, blocks`` of the keys that may have more than two blocks of entries.

    Only values that many fingerprints share are spread over their balls: where
    none has more than BLOCK / 33, a key has no more than BLOCK.
    """
    values = F.array(*[_value(F.col("index"), n, a, w) for n, (a, w) in enumerate(segment_widths(segments))])
    many = nodes.select(F.explode(values).alias("v")).groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK // 33)
    parts = []
    for n, (_, width) in enumerate(segment_widths(segments)):
        flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(width)])
        own = many.where(F.shiftright("v", 40) == n)
        parts.append(own.select(F.explode(F.transform(flips, lambda x: F.col("v").bitwiseXOR(x))).alias("key"), "n"))
    keys = parts[0]
    for p in parts[1:]:
        keys = keys.unionByName(p)
    return keys.groupBy("key").agg((F.ceil(F.sum("n") / BLOCK) + 1).cast("int").alias("blocks")).where(F.col("blocks") > 2)


def _near(fields: list[np.ndarray], a, b, radius: int, check: int) -> np.ndarray:
    """Whether entries a and b (places, or arrays of them) are within the radii; ``fields``: index, or index, node and check bits."""
    bits = np.bitwise_count(fields[0][a] ^ fields[0][b]) <= radius
    if len(fields) > 1:
        bits &= np.bitwise_count(fields[1][a] ^ fields[1][b]) + np.bitwise_count(fields[2][a] ^ fields[2][b]) <= check
    return bits


def _here(index_a: np.ndarray, index_b: np.ndarray, key: np.ndarray, widths: list[tuple[int, int]]) -> np.ndarray:
    """Whether this key is the one where a pair counts."""
    segment = (key >> 40).astype(np.int64)
    value = (key & ((1 << 40) - 1)).astype(np.uint64)
    good = np.zeros(len(key), bool)
    earlier = np.zeros(len(key), bool)
    for n, (first, width) in enumerate(widths):
        mask = np.uint64((1 << width) - 1)
        a, b = (index_a >> np.uint64(first)) & mask, (index_b >> np.uint64(first)) & mask
        d = a ^ b
        size = np.bitwise_count(d)
        low = d & (~d + np.uint64(1))
        place = np.where(size == 2, np.minimum(a ^ low, b ^ low), np.minimum(a, b))
        good |= (segment == n) & ~earlier & (place == value)
        earlier |= size <= 2
    return good


def _forest(fields: list[np.ndarray], radius: int, check: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of a spanning forest of the links among all entries: whatever a taken entry links leaves the list."""
    left = np.arange(len(fields[0]))
    a, b = [], []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            k = todo.pop()
            near = _near(fields, left, k, radius, check)
            if near.any():
                hit = left[near]
                a.append(np.full(len(hit), k))
                b.append(hit)
                todo += hit.tolist()
                left = left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate(a or [none]), np.concatenate(b or [none])


def _verify(radius: int, check: int, segments: int, names: list[str]):
    """Links of entries sorted by (key, i, j), as (a, b) of nodes with a < b."""
    widths = segment_widths(segments)

    def links(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
        node = batch.column("fp").to_numpy()
        fields = [batch.column(c).to_numpy().view(np.uint64) for c in names]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))
        sizes = np.diff(np.append(starts, len(key)))
        end = np.repeat(starts + sizes, sizes)
        some = np.repeat(sizes <= FEW, sizes)
        out = []
        at = np.flatnonzero(some)
        for d in range(1, FEW):
            at = at[at + d < end[at]]
            if not len(at):
                break
            p = at[_near(fields, at, at + d, radius, check)]
            p = p[_here(fields[0][p], fields[0][p + d], key[p], widths)]
            out.append((node[p], node[p + d]))
        for s, n in zip(starts[sizes > FEW], sizes[sizes > FEW]):
            own = [f[s : s + n] for f in fields]
            a, b = _forest(own, radius, check)
            out.append((node[s + a], node[s + b]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), ())))
        real = a != b
        return np.minimum(a, b)[real], np.maximum(a, b)[real]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
            held.clear()
            if whole:
                a, b = links(whole[0])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j = (batch.column(c).to_numpy() for c in ("key", "i", "j"))
            # The last group of a batch may go on in the next one.
            change = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0))
            if last is not None and (key[0], i[0], j[0]) != last:
                yield from close()
            last = (key[-1], i[-1], j[-1])
            if len(change):
                held.append(batch.slice(0, change[-1] + 1))
                yield from close()
                held.append(batch.slice(change[-1] + 1))
            else:
                held.append(batch)
        yield from close()

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, check: int | None = None) -> DataFrame:
    """``a, b`` (a < b) of distinct nodes of ``fps`` (column ``fp``) that differ in at most ``radius`` bits.

    Each link comes once, but under crowded keys, where a spanning forest stands
    for the links. With ``check``, a node has the columns ``index`` (looked up,
    ``radius``), ``five`` and ``check`` (together at most ``check`` of 128 bits).
    """
    if not 1 <= segments <= 4 or check is None and not 0 <= radius < 3 * segments:
        raise ValueError("the index answers radii below three times its segments")
    names = ["fp"] if check is None else ["index", "five", "check"]
    nodes = fps.select("fp").distinct().select("fp", F.col("fp").alias("index")) if check is None else fps.select("fp", *names).dropDuplicates(["fp"])
    # Entries are many more than nodes, so they are made by more tasks than the nodes need.
    nodes = cut(nodes.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"))
    values = F.array(*[_value(F.col("index"), n, a, w) for n, (a, w) in enumerate(segment_widths(segments))])
    carried = names if check is None else ["fp", *names]
    entries = nodes.select(*carried, values.alias("values")).select(*carried, F.explode(_balls(F.col("values"), segments)).alias("key"))
    zero = F.lit(0).cast("int")
    crowd = cut(_crowded(nodes, segments))
    crowds = crowd.count()
    if crowds:
        crowd = F.broadcast(crowd) if crowds <= MOST_BROADCAST else crowd
        entries = entries.join(crowd, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        entries = entries.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        entries = entries.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        entries = entries.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *carried)
        parts = entries.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    else:
        parts = entries.repartition("key").sortWithinPartitions("key").select("key", zero.alias("i"), zero.alias("j"), *carried)
    return parts.mapInArrow(_verify(radius, check or 0, segments, names), "a long, b long")


def clusters(fps: DataFrame, links: DataFrame) -> DataFrame:
    """``id, tie, fp, root, component_id, first`` of every row (``id, tie, fp``): ``first`` is the smallest (id, tie) of the component, null ids last.

    A fingerprint or component of any size is spread over ``SALTS`` tasks on the way back to the rows.
    """
    roots = connected_components(links, "a", "b").select(F.col("node").alias("fp"), "root")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "tie")
    f = fps.select("id", "tie", "fp", F.pmod(F.xxhash64("id", "tie"), F.lit(SALTS)).alias("salt"))
    part = f.groupBy("fp", "salt").agg(F.min("id").alias("least"), F.min(order).alias("first"))
    nodes = part.groupBy("fp").agg(F.min("least").alias("least"), F.min("first").alias("first"), F.collect_set("salt").alias("salts"))
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = beside(nodes, "root", F.col("fp"), component_id=(F.min, F.col("least")), leader=(F.min, F.col("first")))
    table = whole.select("fp", F.explode("salts").alias("salt"), "root", "component_id", F.col("leader").alias("first"))
    return f.join(table, ["fp", "salt"]).select("id", "tie", "fp", "root", "component_id", F.struct(F.col("first.id").alias("id"), F.col("first.tie").alias("tie")).alias("first"))


def simhash_clusters(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = RADIUS, tie: Column | None = None) -> DataFrame:
    """One row a row of ``df``: ``id, tie, fp, root, component_id, first``, by fingerprints of the contract's form.

    ``root`` names the component, ``component_id`` is its smallest id, ``first``
    the smallest (id, tie) in it.
    """
    shape(df, id_col, text_col)
    tie = F.lit(0).cast("long") if tie is None else tie
    f = cut(fingerprints(df, F.col(text_col), width, id=F.col(id_col), tie=tie))
    return clusters(f, fingerprint_links(f, radius, max(SEGMENTS, radius // 3 + 1)))


def similar_clusters(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tie: Column | None = None) -> DataFrame:
    """The same columns, by wide fingerprints: documents whose five-word shingles are similar to 0.8 or more, as far as 128 bits tell."""
    shape(df, id_col, text_col)
    tie = F.lit(0).cast("long") if tie is None else tie
    f = cut(wide_fingerprints(df, F.col(text_col), id=F.col(id_col), tie=tie))
    return clusters(f, fingerprint_links(f, WIDE_RADIUS, WIDE_SEGMENTS, CHECK_RADIUS))


def fingerprint_text(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each component of :func:`similar_clusters`: the smallest id, of equal ids the smallest row hash. Columns stay as they are."""
    tie = row_hash(df)
    c = similar_clusters(df, id_col=id_col, text_col=text_col, tie=tie)
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    kept = c.select(key(F.col("first.id")).alias("k"), F.col("first.tie").alias("t")).distinct()
    cols = [F.col(f"`{n}`") for n in df.columns]
    keyed = df.select(F.struct(*cols).alias("row"), key(F.col(id_col)).alias("k"), F.xxhash64(*hashable(df)).alias("t"))
    # Repeated rows become one before they travel, however many there are.
    return keyed.dropDuplicates(["k", "t"]).join(kept, ["k", "t"], "left_semi").select(*[F.col("row").getField(n).alias(n) for n in df.columns])
