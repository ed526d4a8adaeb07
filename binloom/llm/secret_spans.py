"""Secrets: exact patterns, and a linear-chain conditional random field that adds spans.

Tokens are runs of the characters secrets are made of. The field tags each token of a line as
begin, inside or outside of a secret from its shape, its neighbouring words, the mark before
it and features of the whole file; tags are decoded by Viterbi. It is trained on a bounded
sample of documents whose pattern spans serve as labels, and what it finds beside them is
added. Lines in which no token can leave the outside tag by its own scores and the largest
gain of transitions are outside as a whole; this bound is exact, so they need no decoding.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm.common import filled, text_bytes, text_slices
from binloom.llm.hashing import BYTE_VALUES, RollingHash, spans, text_of

# Fixed values of the base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

#: Documents of the training sample with and without keywords of the patterns, on average.
SAMPLE_ROWS = 1200
#: Tokens on either side of a span that a training sequence holds.
REACH = 12
OUT, BEGIN, INSIDE = 0, 1, 2
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True


def _byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGIT, _UPPER = _byte_set(b"0123456789"), _byte_set(bytes(range(65, 91)))
_HEX, _VOWEL, _SIGN = _byte_set(b"0123456789abcdef"), _byte_set(b"aeiouAEIOU"), _byte_set(b"+/_.=-")
_CODE = _byte_set(b"{}[]()<>=;:\"'`$#@\\|")
_LENGTHS = np.array([2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64])
_SIZES = np.array([4096, 4096, 4096, 4096, 4096, 256, 4096, 1024, 4096])
_BEGINS = np.concatenate([[0], np.cumsum(_SIZES)])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind position, end) of the pattern spans, in order."""
    found = []
    folded = text.lower()
    if any(k in folded for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


@dataclass
class Tokens:
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    line: np.ndarray  # number of the line, over all texts
    features: np.ndarray  # tokens x templates, rows of the weight table


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    begin, end = spans(data, offsets, _TOKEN)
    n = len(begin)
    text = text_of(begin, offsets)
    if not n:
        return Tokens(begin, end, text, text, np.zeros((0, len(_SIZES)), np.int64))
    size = end - begin

    def share(member: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(member[data])])
        return sums[end] - sums[begin]

    digits, upper, vowels, signs = share(_DIGIT), share(_UPPER), share(_VOWEL), share(_SIGN)
    hexes = share(_HEX) == size
    kind = _DIGIT[data].astype(np.int8) + 2 * _UPPER[data]
    turn = np.zeros(len(data) + 1, np.int64)
    turn[2:] = np.cumsum(kind[1:] != kind[:-1])
    turns = turn[end] - turn[begin + 1]
    long = np.searchsorted(_LENGTHS, size, side="right")
    some = lambda count: np.digitize(count / size, (1e-9, 0.2, 0.5, 0.999))
    digit, big, vowel = some(digits), some(upper), some(vowels)
    turned = np.minimum(turns, 5)
    words = RollingHash(data, BYTE_VALUES)(begin, end)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = breaks[begin] + text  # a text begins a new line
    same_before = np.concatenate([[False], line[1:] == line[:-1]])
    before = np.where(same_before, np.concatenate([[0], words[:-1].view(np.int64)]), 1)
    after = np.where(np.concatenate([same_before[1:], [False]]), np.concatenate([words[1:].view(np.int64), [0]]), 1)
    at_start = begin == offsets[text]
    mark = np.where(at_start, 0, data[np.maximum(begin - 1, 0)]).astype(np.int64)
    second = np.where(begin - 2 < offsets[text], 0, data[np.maximum(begin - 2, 0)])
    mark = np.where(mark == 32, second, mark)
    lengths = np.maximum(np.diff(offsets), 1)
    code = np.concatenate([[0], np.cumsum(_CODE[data])])
    dense = np.digitize((code[offsets[1:]] - code[offsets[:-1]]) / lengths, (0.001, 0.01, 0.03))
    numbers = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    numeric = np.digitize((numbers[offsets[1:]] - numbers[offsets[:-1]]) / lengths, (0.005, 0.05))
    file = (dense * 3 + numeric)[text]
    head = RollingHash(data, BYTE_VALUES)(begin, np.minimum(end, begin + 4)).view(np.int64)
    columns = (
        (long * 5 + digit) * 5 + big,
        ((long * 6 + turned) * 2 + hexes) * 3 + np.minimum(signs, 2),
        ((digit * 5 + big) * 6 + turned) * 5 + vowel,
        before,
        after,
        mark,
        before * 257 + mark,
        (file * 12 + long) * 3 + np.minimum(digit, 2),
        head * 3 + np.minimum(digits + upper, 2),
    )
    features = np.stack([np.mod(c, s) + b for c, s, b in zip(columns, _SIZES, _BEGINS)], 1)
    return Tokens(begin, end, text, line, features)


@dataclass
class Field:
    weights: np.ndarray  # rows x tags
    steps: np.ndarray  # from tag x to tag

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, first byte, end byte) of the spans that the field tags."""
        found = tokens(data, offsets)
        if not len(found.begin):
            return []
        scores = self.weights[found.features].sum(1)
        gain = max(0.0, float(self.steps.max() - self.steps[OUT, OUT]))
        open_ = scores[:, 1:].max(1) - scores[:, OUT] + 2 * gain >= 0
        lines = np.unique(found.line[open_])
        first = np.searchsorted(found.line, lines)
        sizes = np.searchsorted(found.line, lines, side="right") - first
        order = np.argsort(sizes, kind="stable")
        out = []
        for part in np.array_split(order, max(1, len(order) // 256)):
            if len(part):
                out += self._decode(found, scores, first[part], sizes[part])
        return sorted(out)

    def _decode(self, found: Tokens, scores: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
        longest, n = int(sizes.max()), len(first)
        back = np.zeros((longest, n, 3), np.int8)
        best = scores[first].copy()
        best[:, INSIDE] = -1e9
        for t in range(1, longest):
            on = sizes > t
            options = best[on][:, :, None] + self.steps
            back[t, on] = options.argmax(1)
            best[on] = options.max(1) + scores[first[on] + t]
        tag, out = best.argmax(1), []
        tags = np.zeros((longest, n), np.int8)
        for t in range(longest - 1, -1, -1):
            on = sizes > t
            tags[t, on] = tag[on]
            if t:
                tag = np.where(on, back[t, np.arange(n), tag], tag)
        for k in np.flatnonzero(tags.max(0) > 0).tolist():
            row, start = tags[: sizes[k], k], None
            for t, y in enumerate([*row.tolist(), OUT]):
                if start is not None and y != INSIDE:
                    a, b = first[k] + start, first[k] + t - 1
                    out.append((int(found.text[a]), int(found.begin[a]), int(found.end[b])))
                    start = None
                if y == BEGIN:
                    start = t
        return out


def fit(texts: pa.Array, rounds: int = 50) -> Field:
    """Train the field on texts whose pattern spans are the labels, by full gradients."""
    features, tags, lengths = [], [], []
    for batch in text_slices([pa.RecordBatch.from_arrays([texts], names=["text"])]):
        data, offsets = text_bytes(batch.column(0))
        found = tokens(data, offsets)
        tag = np.zeros(len(found.begin), np.int64)
        for k, text in enumerate(batch.column(0).to_pylist()):
            for start, kind, end in base_spans(text or ""):
                if kind == 0:
                    start = ASSIGN.match(text, start).start(2)
                low, high = (offsets[k] + len(text[:x].encode()) for x in (start, end))
                a, b = np.searchsorted(found.end, low, side="right"), np.searchsorted(found.begin, high, side="left")
                tag[a : a + 1], tag[a + 1 : b] = BEGIN, INSIDE
        wanted = np.zeros(len(tag), bool)
        marked = np.flatnonzero(tag)
        for lag in range(-REACH, REACH + 1):
            wanted[np.clip(marked + lag, 0, max(0, len(tag) - 1))] = True
        wanted |= found.line % 50 == 0  # other lines, evenly
        odd = (found.features[:, 2] - _BEGINS[2]) // 30 % 25 > 0  # tokens with digits or capitals
        wanted |= odd & (found.line % 5 == 0)
        at = np.flatnonzero(wanted)
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(found.line[at]) > 0)])) if len(at) else at
        for piece in np.split(at, cut[1:]) if len(at) else []:
            for begin in range(0, len(piece), 2 * REACH + 1):
                part = piece[begin : begin + 2 * REACH + 1]
                features.append(found.features[part])
                tags.append(tag[part])
                lengths.append(len(part))
    weights, steps = np.zeros((int(_SIZES.sum()), 3)), np.zeros((3, 3))
    if not features:
        return Field(weights, steps)
    n, longest = len(features), max(lengths)
    x, y = np.zeros((n, longest, len(_SIZES)), np.int32), np.zeros((n, longest), np.int64)
    real = np.arange(longest) < np.array(lengths)[:, None]
    for k, (f, t) in enumerate(zip(features, tags)):
        x[k, : len(f)], y[k, : len(t)] = f, t
    rare, count = real[..., None] * np.eye(3)[y], real.sum()
    squares, step_squares = np.full(weights.shape, 1e-8), np.full((3, 3), 1e-8)
    for _ in range(rounds):
        scores = weights[x].sum(2)
        scores[:, 0, INSIDE] -= 1e9
        ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, longest):
            summed = np.logaddexp.reduce(ahead[:, t - 1, :, None] + steps, axis=1) + scores[:, t]
            ahead[:, t] = np.where(real[:, t, None], summed, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            summed = np.logaddexp.reduce(steps + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(real[:, t + 1, None], summed, 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        chance = np.exp(np.minimum(0, ahead + behind - total[:, None, None])) * real[..., None]
        slope = rare - chance
        gradient = np.stack(
            [np.bincount(x.reshape(-1), np.repeat(slope[..., k].reshape(-1), len(_SIZES)), len(weights)) for k in range(3)], 1
        )
        gradient = gradient / count * 1000 - 0.02 * weights
        pair = ahead[:, :-1, :, None] + steps + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(0, pair)) * real[:, 1:, None, None]).sum((0, 1))
        seen = np.bincount((y[:, :-1] * 3 + y[:, 1:])[real[:, 1:]], minlength=9).reshape(3, 3)
        step_gradient = (seen - expected) / count * 1000 - 0.02 * steps
        squares += gradient**2
        step_squares += step_gradient**2
        weights = weights + 0.3 * gradient / np.sqrt(squares)
        steps = steps + 0.3 * step_gradient / np.sqrt(step_squares)
    return Field(weights, steps)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Field:
    """Fit on a sample drawn by a hash of the text, half of it with a keyword of the patterns."""
    folded = F.lower("text")
    holds = [F.contains(folded, F.lit(k)) for k in KEYWORDS] + [F.contains(F.col("text"), F.lit("AKIA"))]
    rows = docs.select(filled(text_col).alias("text")).withColumn("marked", reduce(lambda a, b: a | b, holds))
    marked = max(1, rows.where("marked").count())
    chance = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("marked"), sample_rows / 2 / marked).otherwise(sample_rows / 2 / max(1, docs.count()))
    table = rows.where(chance < share).orderBy(F.xxhash64("text")).select("text").toArrow()
    return fit(table.column("text").combine_chunks())


def _spelled(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def secret_spans(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256 and spans for every row.

    Spans are ``kind:start:end`` in code points, the end exclusive, by start and then kind.
    Spans of the field that touch a pattern span are left to the pattern. Null texts are
    empty and have no spans. Ids may be null or repeated and are returned as they are; an
    empty table gives no rows; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(field)  # a fixed size

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            data, offsets = text_bytes(batch.column(1))
            leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            added: dict[int, list[tuple[int, int, int]]] = {}
            for text, begin, end in shipped.value.spans(data, offsets):
                added.setdefault(text, []).append(
                    (int(leads[begin] - leads[offsets[text]]), 3, int(leads[end] - leads[offsets[text]]))
                )
            rows = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                base = base_spans(text)
                more = [s for s in added.get(k, ()) if all(s[2] <= b[0] or b[2] <= s[0] for b in base)]
                counts = [sum(b[1] == kind for b in base) for kind in range(3)]
                digest = hashlib.sha256(_spelled(base).encode()).hexdigest()
                rows.append((*counts, digest, _spelled(sorted(base + more))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in zip(*rows))],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col), filled(text_col).alias("text"))
    return rows.mapInArrow(
        scanned, f"{id_col} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )
