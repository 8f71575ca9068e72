"""Personal data: exact patterns, and a linear-chain CRF over word shapes that adds secrets.

The four pattern kinds are found leftmost and without overlap, each by itself:
email, ip (parts up to 255), card (14 to 19 digits that pass Luhn), phone (10 to
15 digits); a match that fails its test is dropped and not tried again.

The conditional random field labels words (runs without white space) from
their shapes alone: length, share of digits, case, marks, changes between
letters and digits, and the kind of the words on either side. It is trained from
a small labelled table (``labelled_table``), by gradient steps on the exact
likelihood, and decoded by Viterbi for all sequences of a batch at once. A
sequence is a run of words around any word with a digit or an at sign, two words
on either side; other words can carry no label. Words labelled ``secret`` add a
span, its marks trimmed, where no pattern span overlaps it; the labels of the
pattern kinds only compete with it, so pattern spans always stay as they are.

Offsets are code points, ends exclusive. A null or empty text has no spans.
All searches take time in proportion to the text.
Repeated rows keep their rows; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Sequence
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import add_columns
from tracemill.llm.pii_lines import LINES

#: The kinds in their order, and the patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A chain of four numbers or more between dots, from its beginning and as long as it goes; addresses are its parts four by four.
_CHAIN = re.compile(r"(?<![0-9])(?<![0-9]\.)[0-9]++(?:\.[0-9]++){3,}+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(number: str) -> bool:
    """Whether a run of digits of any length is at most 255."""
    digits = number.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def base_spans(text: str) -> list[Span]:
    """All pattern spans by start, then in the order of the kinds."""
    out: list[tuple[int, int, int]] = []
    last = 0
    # An at sign is in no local part, so a match is a run of local characters up to one.
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            out.append((start, 0, m.end()))
            last = m.end()
    for m in _CHAIN.finditer(text):
        parts, at = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(_small(p) for p in four):
                out.append((at, 1, at + size))
            at += size + 1
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37:
            digits = re.sub(r"[^0-9]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


# --- word shapes ---------------------------------------------------------------

LABELS = ("other", "email", "ip", "card", "phone", "secret")
SECRET = LABELS.index("secret")
LOWER, UPPER, DIGIT, AT, DOT, DASH, QUOTE, EQUALS, OPEN, PLUS = (1 << k for k in range(10))
_CLASS = np.zeros(256, np.uint16)
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = (
        DIGIT if _s in "0123456789" else UPPER if _s.isupper() else LOWER if _s.isalpha() else
        {"@": AT, ".": DOT, "-": DASH, '"': QUOTE, "'": QUOTE, "=": EQUALS, ":": EQUALS, "(": OPEN, "+": PLUS}.get(_s, 0)
    )
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 11, 12, 13, 32]] = True
#: Sizes of the categorical features: length, digits, case, marks, dots, changes, hex, word before, word after.
SIZES = (8, 5, 4, 64, 4, 5, 2, 6, 6)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)])
NEAR = 2
#: Longer sequences of words are decoded in pieces.
PIECE_WORDS = 256


def word_features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, features, sequence) of the words near a digit or an at sign; sequence numbers rise where words are not neighbours."""
    none = np.zeros(0, np.int64)
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    small = np.where(code < 256, code, 255).astype(np.uint8)
    gap = _BREAK[small]
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return none, none, np.zeros((0, len(SIZES)), np.int64), none
    cls = _CLASS[small]
    mask = np.bitwise_or.reduceat(cls, starts)
    live = (mask & (DIGIT | AT)) > 0
    if not live.any():
        return none, none, np.zeros((0, len(SIZES)), np.int64), none
    near = live.copy()
    for k in range(1, NEAR + 1):
        near[k:] |= live[:-k]
        near[:-k] |= live[k:]
    words = np.flatnonzero(near)
    a, b, m = starts[words], ends[words], mask[words]
    size = b - a
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    digit, letter = (cls & DIGIT) > 0, (cls & (LOWER | UPPER)) > 0
    nd, nl = sums(digit), sums(letter)
    digits, letters = nd[b] - nd[a], nl[b] - nl[a]
    change = sums(np.concatenate([(digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1]), [False]]))
    changes = change[b - 1] - change[a]
    dots = sums((cls & DOT) > 0)
    hexes = sums(digit | ((code | 32) >= 97) & ((code | 32) <= 102) & (code < 128))
    f = np.zeros((len(words), len(SIZES)), np.int64)
    f[:, 0] = np.searchsorted([2, 3, 5, 9, 16, 25, 40], size, side="right")
    share = digits / size
    f[:, 1] = np.where(digits == 0, 0, np.where(share < 0.2, 1, np.where(share < 0.5, 2, np.where(digits < size, 3, 4))))
    f[:, 2] = ((m & LOWER) > 0) + 2 * ((m & UPPER) > 0)
    f[:, 3] = sum(((m & bit) > 0).astype(np.int64) << k for k, bit in enumerate((AT, DASH, QUOTE, EQUALS, OPEN, PLUS)))
    f[:, 4] = np.minimum(dots[b] - dots[a], 3)
    f[:, 5] = np.searchsorted([1, 2, 4, 7], changes, side="right")
    f[:, 6] = (hexes[b] - hexes[a] == digits + letters) & (digits + letters > 7)
    kind = np.where(m & AT, 4, np.where(m & DIGIT, 3, np.where(m & EQUALS, 2, np.where(m & (LOWER | UPPER), 1, 5))))
    joined = np.diff(words) == 1
    f[1:, 7] = np.where(joined, kind[:-1], 0)
    f[:-1, 8] = np.where(joined, kind[1:], 0)
    return a, b, f + OFFSETS[:-1], np.concatenate([[0], np.cumsum(~joined)])


class Crf:
    """Weights of the features (rows) and of label pairs."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def decode(self, features: np.ndarray, sequence: np.ndarray) -> np.ndarray:
        """The best labels of all words; all sequences advance together, a long one in pieces of about the root of its length."""
        score = self.emit[features].sum(1)
        if not len(sequence):
            return np.zeros(0, np.int64)
        first = np.flatnonzero(np.concatenate([[True], np.diff(sequence) != 0]))
        size = np.diff(np.append(first, len(sequence)))
        none = np.full(len(first), -1)
        if size.max() <= PIECE_WORDS:
            return self._pieces(score, first, size, none, none)
        piece = max(PIECE_WORDS, int(size.max() ** 0.5))
        count = -(-size // piece)
        owner = np.repeat(np.arange(len(first)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = first[owner] + nth * piece
        length = np.minimum(piece, first[owner] + size[owner] - start)
        entry, leave = self._borders(score, start, length, owner, nth)
        return self._pieces(score, start, length, entry, leave)

    def _borders(self, score: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best labels before and at the end of every piece of a cut sequence, -1 where there is none or the sequence is whole."""
        cut = np.flatnonzero(np.bincount(owner)[owner] > 1)
        cut = cut[np.argsort(-length[cut], kind="stable")]
        begin, size = start[cut], length[cut]
        # Best score of a piece for each label before it (columns: the label at its end), max-plus products word by word.
        through = self.move[None] + score[begin][:, None, :]
        for k in range(1, size[0]):
            on = np.searchsorted(-size, -k, side="left")
            best = through[:on, :, :1] + self.move[0]
            for c in range(1, len(self.move)):
                np.maximum(best, through[:on, :, c : c + 1] + self.move[c], out=best)
            through[:on] = best + score[begin[:on] + k][:, None, :]
        # The first piece of a sequence has no label before it.
        whole = np.empty((len(start), *self.move.shape))
        whole[cut] = through
        heads = cut[nth[cut] == 0]
        best = np.full((len(start), len(self.move)), -np.inf)
        best[heads] = self._ends(score, start[heads], length[heads])
        back = np.zeros(best.shape, np.int64)
        for k in range(1, nth.max() + 1):
            at = np.flatnonzero(nth == k)
            reach = best[at - 1][:, :, None] + whole[at]
            back[at], best[at] = reach.argmax(1), reach.max(1)
        entry, leave = np.full(len(start), -1), np.full(len(start), -1)
        last = np.zeros(len(start), bool)
        last[np.append(np.flatnonzero(np.diff(owner)), len(owner) - 1)] = True
        ends = np.flatnonzero(last & (nth > 0))
        leave[ends] = best[ends].argmax(1)
        for k in range(nth.max(), 0, -1):
            at = np.flatnonzero((nth == k) & (leave >= 0))
            entry[at] = leave[at - 1] = back[at, leave[at]]
        return entry, leave

    def _ends(self, score: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Best score of each sequence by its last label."""
        order = np.argsort(-size, kind="stable")
        begin, length = first[order], size[order]
        best = score[begin].copy()
        for k in range(1, length[0] if len(length) else 0):
            on = np.searchsorted(-length, -k, side="left")
            best[:on] = (best[:on, :, None] + self.move[None]).max(1) + score[begin[:on] + k]
        out = np.empty_like(best)
        out[order] = best
        return out

    def _pieces(self, score: np.ndarray, first: np.ndarray, size: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> np.ndarray:
        """Best labels of pieces, given the label before and at the end of each (-1: any)."""
        order = np.argsort(-size, kind="stable")
        first, size, entry, leave = first[order], size[order], entry[order], leave[order]
        back = np.zeros(score.shape, np.int8)
        best = score.copy()
        inside = entry >= 0
        best[first[inside]] += self.move[entry[inside]]
        for k in range(1, size[0]):
            at = first[: np.searchsorted(-size, -k, side="left")] + k
            reach = best[at - 1][:, :1] + self.move[0]
            source = np.zeros(reach.shape, np.int8)
            for c in range(1, len(self.move)):
                other = best[at - 1][:, c : c + 1] + self.move[c]
                source[other > reach] = c
                np.maximum(reach, other, out=reach)
            back[at] = source
            best[at] += reach
        label = np.zeros(len(score), np.int64)
        last = first + size - 1
        label[last] = np.where(leave >= 0, leave, best[last].argmax(1))
        for k in range(size[0] - 1, 0, -1):
            at = first[: np.searchsorted(-size, -k, side="left")] + k
            label[at - 1] = back[at, label[at]]
        return label


_MARKED = re.compile(r"\[(email|ip|card|phone|secret)\|([^\]]*)\]")


def labelled_table(lines: Sequence[str] = LINES) -> list[tuple[str, list[Span]]]:
    """The labelled table as texts with spans."""
    table = []
    for line in lines:
        text, spans, at = "", [], 0
        for m in _MARKED.finditer(line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text += m[2]
            at = m.end()
        table.append((text + line[at:], spans))
    return table


@lru_cache(maxsize=1)
def train(steps: int = 200) -> Crf:
    """Fit the field to the labelled table by Adam on the exact negative log-likelihood."""
    features, labels, sequences, n = [], [], [], 0
    for text, spans in labelled_table():
        a, b, f, s = word_features(text)
        y = np.zeros(len(a), np.int64)
        for lo, hi, kind in spans:
            y[(a < hi) & (b > lo)] = LABELS.index(kind)
        features.append(f)
        labels.append(y)
        sequences.append(s + n)
        n += (s[-1] + 1) if len(s) else 0
    f, y, s = np.concatenate(features), np.concatenate(labels), np.concatenate(sequences)
    first = np.flatnonzero(np.concatenate([[True], np.diff(s) != 0]))
    size = np.diff(np.append(first, len(s)))
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    k = len(LABELS)
    emit, move = np.zeros((OFFSETS[-1], k)), np.zeros((k, k))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emit, move)]
    log_sum = lambda x, axis: (lambda m: np.log(np.exp(x - m).sum(axis)) + m.squeeze(axis))(x.max(axis, keepdims=True))
    for t in range(1, steps + 1):
        score = emit[f].sum(1)
        ahead, behind = score.copy(), np.zeros_like(score)
        at = lambda d: first[: np.searchsorted(-size, -d, side="left")] + d
        for d in range(1, size[0]):
            ahead[at(d)] += log_sum(ahead[at(d) - 1][:, :, None] + move[None], 1)
        for d in range(size[0] - 1, 0, -1):
            behind[at(d) - 1] = log_sum((score[at(d)] + behind[at(d)])[:, None, :] + move[None], 2)
        whole = log_sum(ahead + behind, 1)[:, None]
        d_emit_words = np.exp(ahead + behind - whole)
        d_move = np.zeros((k, k))
        for d in range(1, size[0]):
            p = ahead[at(d) - 1][:, :, None] + move[None] + (score[at(d)] + behind[at(d)])[:, None, :] - whole[at(d)][:, :, None]
            d_move += np.exp(p).sum(0)
            np.add.at(d_move, (y[at(d) - 1], y[at(d)]), -1)
        d_emit_words[np.arange(len(y)), y] -= 1
        d_emit = np.zeros_like(emit)
        for c in range(f.shape[1]):
            np.add.at(d_emit, f[:, c], d_emit_words)
        for p, g, (m1, m2) in zip((emit, move), (d_emit / len(y) + 1e-4 * emit, d_move / len(y) + 1e-4 * move), state):
            m1 += 0.1 * (g - m1)
            m2 += 0.02 * (g * g - m2)
            p -= 0.15 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.98**t)) + 1e-8)
    return Crf(emit, move)


#: Labels of the field that add spans, and what a span of theirs must have: digits enough for a telephone, an at sign for an address.
ADDED = ("secret", "phone", "email")
ADDED_LABELS = [LABELS.index(k) for k in ADDED]
_CORE = re.compile(r"[A-Za-z0-9](?:.*[A-Za-z0-9])?", re.S)
_HOST = re.compile(r"@[A-Za-z0-9.-]*[A-Za-z0-9]")
#: Digits of a telephone number that the field may add; dates have fewer.
PHONE_DIGITS = (9, 15)


def _trimmed(text: str, lo: int, hi: int, kind: str) -> tuple[int, int] | None:
    """The span of a labelled word or run of words without its marks; None if it can't be of its kind."""
    if kind == "email":
        host = _HOST.search(text, lo, hi)
        start = host.start() if host else lo
        while start > lo and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        return (start, host.end()) if host and start < host.start() else None
    core = _CORE.search(text, lo, hi)
    if not core:
        return None
    lo, hi = core.span()
    if kind == "phone":
        lo -= lo > 0 and text[lo - 1] == "("
        return (lo, hi) if PHONE_DIGITS[0] <= sum("0" <= c <= "9" for c in text[lo:hi]) <= PHONE_DIGITS[1] else None
    # In an assignment without spaces the value is what follows the sign.
    cut = max(text.rfind("=", lo, hi), text.rfind(":", lo, hi))
    value = _CORE.search(text, cut + 1, hi) if cut >= 0 else None
    return value.span() if value else (lo, hi)


def _added(text: str, starts: np.ndarray, ends: np.ndarray, label: np.ndarray, sequence: np.ndarray, own: list[Span]) -> list[Span]:
    """Spans of the field where no pattern span is: secrets and addresses word by word, telephone numbers over neighbouring words."""
    begins = [a for a, _, _ in own]
    reach = list(accumulate((b for _, b, _ in own), max))
    out = []
    done = -1
    for k in np.flatnonzero(np.isin(label, ADDED_LABELS)).tolist():
        if k <= done:
            continue
        kind, last = LABELS[label[k]], k
        if kind == "phone":
            while last + 1 < len(label) and label[last + 1] == label[k] and sequence[last + 1] == sequence[k]:
                last += 1
        if span := _trimmed(text, int(starts[k]), int(ends[last]), kind):
            before = bisect_left(begins, span[1])
            if not before or reach[before - 1] <= span[0]:
                out.append((*span, kind))
        done = last
    return out


def find(texts: list[str | None], crf: Crf) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans) of each text; the field decodes the whole batch at once."""
    base = [base_spans(t or "") for t in texts]
    parts = [word_features(t or "") for t in texts]
    shift, sequences = 0, []
    for _, _, _, s in parts:
        sequences.append(s + shift)
        shift += (s[-1] + 1) if len(s) else 0
    label = crf.decode(np.concatenate([p[2] for p in parts]), np.concatenate(sequences)) if parts else np.zeros(0, int)
    out, at = [], 0
    rank = {k: n for n, k in enumerate((*KINDS, "secret"))}
    for text, own, (a, b, _, s) in zip(texts, base, parts):
        extra = _added(text or "", a, b, label[at : at + len(a)], s, own)
        at += len(a)
        out.append((own, sorted(own + extra, key=lambda s: (s[0], rank[s[2]], s[1]))))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def personal_data(df: DataFrame, text: Column, /, **keep: Column) -> DataFrame:
    """Columns ``keep``, then ``n_email, n_ip, n_card, n_phone`` (pattern spans), ``base_sha256``, ``spans`` (all, written), ``n_secret``, ``n_added``.

    ``n_added`` counts the spans of the field, secrets among them. A kept column with the name of a new one is left out.
    """
    crf = train()
    long = T.LongType()
    new = [T.StructField(f"n_{k}", long) for k in KINDS]
    new += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_secret", long), T.StructField("n_added", long)]

    def start():
        def step(texts: pa.Array) -> list[pa.Array]:
            found = find(texts.to_pylist(), crf)
            return [
                *[pa.array([sum(s[2] == k for s in own) for own, _ in found], pa.int64()) for k in KINDS],
                pa.array([hashlib.sha256(written(own).encode()).hexdigest() for own, _ in found], pa.string()),
                pa.array([written(spans) for _, spans in found], pa.string()),
                pa.array([sum(s[2] == "secret" for s in spans) for _, spans in found], pa.int64()),
                pa.array([len(spans) - len(own) for own, spans in found], pa.int64()),
            ]

        return step

    return add_columns(df, keep, [text.cast("string")], new, start)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans are replaced together, under the first one's kind."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]
