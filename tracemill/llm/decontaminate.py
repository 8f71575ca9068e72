"""Benchmark decontamination by pigeonhole edit matching.

A document leaks a test item if a stretch of it is within k edits of the item,
after both are lower-cased and reduced to words joined by single spaces; k is
one edit for every ``CHARS_PER_EDIT`` characters of the item. An item is split
into k + 1 pieces, so k edits leave at least one piece intact: an Aho-Corasick
automaton finds every exact piece hit, and Myers' bit-parallel algorithm
verifies the window around it. Hits whose places differ by few characters share a
band, whose window is hardly longer than the item; the many bands of an item in a
repetitive text are verified all at once, a step for each place in the window. An
item too short for any edit must occur as whole words.

Documents are read whole, by an automaton in each task, so nothing is shuffled.
Different items go to the tasks in blocks of about ``BLOCK_CHARS`` characters (a
longer item is a block of its own), as broadcasts that the driver makes one at a
time; each block is a pass over the documents. So the table of items may grow,
what the driver or a task holds may not. Benchmarks of less than a block, some
50,000 questions, take one pass.

Null and blank items and documents match nothing. Items that repeat give a row
each, rows of documents that repeat are judged each, a null id is kept as null,
an empty table on either side leaves the documents as they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracemill.llm.common import map_batches, shape

CHARS_PER_EDIT = 12
BLOCK_CHARS = 4_000_000
#: Characters of an item's windows from which they are verified all at once, and windows that are.
MANY, TOGETHER = 2_000, 8_192
_WORDS = re.compile(r"\w+")


def normalise(text: str | None) -> str:
    return " ".join(_WORDS.findall((text or "").lower()))


def myers(pattern: str, text: str, k: int, peq: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the best approximate occurrence of ``pattern`` in ``text`` with at most k edits, the first of equals; end exclusive."""
    m = len(pattern)
    if peq is None:
        peq = bits(pattern)
    pv, mv, score, top, mask = (1 << m) - 1, 0, m, 1 << (m - 1), (1 << m) - 1
    best, end = k + 1, 0
    get = peq.get
    for at, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score < best:
            best, end = score, at + 1
    return (best, end) if best <= k else None


def bits(pattern: str) -> dict[str, int]:
    """For each character the bit set of its places in the pattern."""
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        peq[c] |= 1 << i
    return dict(peq)


def bands(diagonals: list[int], k: int) -> list[int]:
    """Where each band begins; a band holds the diagonals up to 2k + 8 after its first one."""
    out, last = [], None
    for d in sorted(diagonals):
        if last is None or d > last + 2 * k + 8:
            out.append(d)
            last = d
    return out


class Symbols:
    """Characters of all items as small numbers, one more for any other."""

    def __init__(self, texts: list[str]):
        self.known = np.array(sorted({ord(c) for t in texts for c in set(t)}), np.uint32)

    def of(self, text: str) -> np.ndarray:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.known, code), max(0, len(self.known) - 1))
        return np.where(self.known[at] == code, at, len(self.known)) if len(self.known) else np.zeros(len(code), int)

    def bits(self, pattern: str) -> np.ndarray:
        """For each symbol the bit set of its places, 64 a column."""
        table = np.zeros((len(self.known) + 1, -(-len(pattern) // 64)), np.uint64)
        for i, c in enumerate(self.of(pattern)):
            table[c, i // 64] |= np.uint64(1 << (i % 64))
        return table


def myers_windows(table: np.ndarray, symbols: np.ndarray, starts: np.ndarray, length: int, m: int, k: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence with at most k edits in any of the windows of one length, the first of equals: a step of all windows at a time."""
    one, shift = np.uint64(1), np.uint64(63)
    words = table.shape[1]
    top = np.uint64((m - 1) % 64)
    best = None
    for at in range(0, len(starts), TOGETHER):
        begin = starts[at : at + TOGETHER]
        n = len(begin)
        pv = [np.full(n, ~np.uint64(0)) for _ in range(words)]
        mv = [np.zeros(n, np.uint64) for _ in range(words)]
        score, least, end = np.full(n, m), np.full(n, k + 1), np.zeros(n, np.int64)
        for j in range(length):
            place = begin + j
            inside = (place >= 0) & (place < len(symbols))
            symbol = np.where(inside, symbols[np.clip(place, 0, len(symbols) - 1)], len(table) - 1)
            carry = np.zeros(n, np.uint64)
            ph_in = mh_in = np.zeros(n, np.uint64)
            for w in range(words):
                eq = table[symbol, w]
                xv = eq | mv[w]
                part = eq & pv[w]
                total = part + pv[w]
                over = total < part
                total = total + carry
                carry = (over | (total < carry)).astype(np.uint64)
                xh = (total ^ pv[w]) | eq
                ph, mh = mv[w] | ~(xh | pv[w]), pv[w] & xh
                if w == words - 1:
                    score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
                ph_out, mh_out = ph >> shift, mh >> shift
                ph, mh = (ph << one) | ph_in, (mh << one) | mh_in
                ph_in, mh_in = ph_out, mh_out
                pv[w], mv[w] = mh | ~(xv | ph), ph & xv
            better = inside & (score < least)
            least[better], end[better] = score[better], place[better] + 1
        hit = np.lexsort((end, least))[0]
        if least[hit] <= k and (best is None or (least[hit], end[hit]) < best):
            best = (int(least[hit]), int(end[hit]))
    return best


class Matcher:
    """Finds the items of one block, (id, text, copies) each, in normalised documents."""

    def __init__(self, items: list[tuple], chars_per_edit: int = CHARS_PER_EDIT):
        self.items = [(i, t, len(t) // chars_per_edit) for i, t in ((i, normalise(t)) for i, t, *_ in items) if t]
        self.copies = [n[0] if n else 1 for i, t, *n in items if normalise(t)]
        self.peq = [bits(t) for _, t, _ in self.items]
        self.symbols = Symbols([t for _, t, _ in self.items])
        self.tables: dict[int, np.ndarray] = {}
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, k) in enumerate(self.items):
            if not k:
                pieces[f" {text} "].append((n, 0))
                continue
            cuts = [len(text) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces[text[a:b]].append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None, first: bool = False) -> list[tuple]:
        """(item id, distance, end in the normalised text) of every item that the text leaks, for each of its copies; ``first``: stop at one."""
        if not self.items:
            return []
        text = f" {normalise(text)} "
        starts: dict[int, list[int]] = defaultdict(list)
        for end, (size, at) in self.automaton.iter(text):
            for n, offset in at:
                starts[n].append(end + 1 - size - offset)
        found, symbols = [], None
        for n, diagonals in starts.items():
            item, pattern, k = self.items[n]
            if not k:
                found += [(item, 0, diagonals[0] + len(pattern))] * self.copies[n]
            else:
                best = None
                begin = bands(diagonals, k)
                length = len(pattern) + 4 * k + 8
                if len(begin) * length > MANY and len(begin) > 1:
                    symbols = self.symbols.of(text) if symbols is None else symbols
                    if n not in self.tables:
                        self.tables[n] = self.symbols.bits(pattern)
                    best = myers_windows(self.tables[n], symbols, np.array(begin) - k, length, len(pattern), k)
                else:
                    for d in begin:
                        a = max(0, d - k)
                        hit = myers(pattern, text[a : d - k + length], k, self.peq[n])
                        if hit and (best is None or hit[0] < best[0]):
                            best = (hit[0], a + hit[1])
                        if best and not best[0]:
                            break
                if best:
                    found += [(item, best[0], best[1] - 1)] * self.copies[n]
            if first and found:
                break
        return found


def item_blocks(items: DataFrame, id_col: str, text_col: str, limit: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The different items and how often each occurs, in blocks of about ``limit`` characters; the driver holds one block."""
    shape(items, id_col, text_col)
    d = items.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).groupBy("i", "t").agg(F.count("*").alias("n"))
    total = d.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // limit) or 1
    d = d.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(blocks)))
    for b in range(blocks):
        yield [(r.i, r.t, r.n) for r in d.where(F.col("b") == b).orderBy("i", "t").collect()]


def _shared(items: DataFrame, id_col: str, text_col: str) -> Iterator[Broadcast]:
    """Each block as a broadcast, which keeps it on disk and off the driver's heap."""
    for block in item_blocks(items, id_col, text_col):
        shared = items.sparkSession.sparkContext.broadcast(block)
        del block
        yield shared


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """``id, item_id, distance, match_end``: a row for each document and item that it leaks; the end is in the normalised text."""
    shape(docs, id_col, text_col)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item_type = items.schema[item_col].dataType
    schema = f"id {dict(d.dtypes)['id']}, item_id {item_type.simpleString()}, distance int, match_end long"
    arrow_type = to_arrow_type(item_type)
    out = None
    for block in _shared(items, item_col, item_text):

        def start(block=block):
            matcher = Matcher(block.value, chars_per_edit)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
                rows = [(k, *hit) for k, text in enumerate(batch.column(1).to_pylist()) for hit in matcher.find(text)]
                if not rows:
                    return None
                k, item, distance, end = zip(*rows)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int64())), pa.array(item, arrow_type), pa.array(distance, pa.int32()), pa.array(end, pa.int64())], names=["id", "item_id", "distance", "match_end"])

            return step

        part = map_batches(d, schema, start)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaking(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """``docs`` without the rows that leak an item; columns stay as they are."""
    shape(docs, text_col)
    at = docs.columns.index(text_col)
    for block in _shared(items, item_col, item_text):

        def start(block=block):
            matcher = Matcher(block.value, chars_per_edit)

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                return batch.filter(pa.array([not matcher.find(t, first=True) for t in batch.column(at).to_pylist()], pa.bool_()))

            return step

        docs = map_batches(docs, docs.schema, start)
    return docs
