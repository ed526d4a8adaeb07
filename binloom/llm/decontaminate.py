"""Benchmark decontamination: documents that hold a benchmark item up to a few edits.

Text is compared as UTF-8 bytes, A-Z as a-z, each run of white space as one space. An item of
n bytes is found where some part of a document is within ``edits(n)`` insertions, deletions
and substitutions of it.

1. Windows. An item is cut into 8-byte pieces. An edit spoils one piece at most, so every
   occurrence keeps a known number of pieces, nearly on one diagonal; where a document has
   that many, its windows of the item's size on those diagonals are looked at. This loses no
   occurrence. Items too short for 8-byte pieces take shorter ones.
2. CGK embedding. Windows and items walk through random bit functions of position and symbol,
   which turns few edits into few differing places of the walk.
3. Bit sampling. Each repeat compares a few sampled places of the walks; a window that agrees
   in one repeat is a candidate. ``REPEATS`` is set for the recall at the largest distance.
4. Verification. The exact edit distance between the item and any part of the region.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm.common import filled, text_bytes, text_slices
from binloom.llm.exact_dedup import without
from binloom.llm.hashing import BYTE_VALUES, RollingHash, text_of

#: Share of an item's bytes that may be edited.
EDIT_SHARE = 0.1
PIECE = 8
WALKS = 8
SAMPLES = 16  # per walk
REPEATS = WALKS * SAMPLES
PLACES = 4  # sampled places of a repeat
#: Item bytes that are sent to the tasks at once; more items take more passes over the documents.
BLOCK_BYTES = 8 << 20
_PAD = 256
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def edits(size: int) -> int:
    return int(size * EDIT_SHARE)


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes and their offsets."""
    space = _SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    places = np.concatenate([[0], np.cumsum(keep)])
    return _FOLD[data[keep]], places[offsets]


class Walks:
    """CGK embeddings at the sampled steps only."""

    def __init__(self, longest: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.steps = 3 * longest
        self.moves = rng.integers(0, 2, (WALKS, self.steps, _PAD + 1), dtype=np.uint8)
        self.picks = rng.random((WALKS, SAMPLES, PLACES))

    def keys(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A key per window and repeat; ``sizes`` are the items' sizes, windows end with the data."""
        n = len(starts)
        out = np.zeros((n, REPEATS), np.uint64)
        if not n:
            return out
        padded = np.concatenate([data.astype(np.int64), [_PAD]])
        last, ends = 3 * int(sizes.max()), np.minimum(starts + sizes, len(data))
        for walk in range(WALKS):
            wanted = (self.picks[walk][None] * (3 * sizes)[:, None, None]).astype(np.int64).reshape(n, -1)
            at, shown = starts.copy(), np.zeros((last, n), np.uint16)
            for step in range(last):
                symbol = padded[np.where((at < ends) & (at >= 0), at, len(data))]
                shown[step] = symbol
                at += self.moves[walk, step][symbol] | (at < 0)
            seen = shown[wanted, np.arange(n)[:, None]].reshape(n, SAMPLES, PLACES).astype(np.uint64)
            for k in range(PLACES):
                out[:, walk * SAMPLES : (walk + 1) * SAMPLES] = out[:, walk * SAMPLES : (walk + 1) * SAMPLES] * np.uint64(
                    257
                ) + seen[:, :, k]
        return out


def best_distance(item: bytes, region: bytes) -> int:
    """Smallest edit distance between the item and any part of the region, bit-parallel."""
    n = len(item)
    if not n:
        return 0
    masks: dict[int, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score = full, 0, n
    best = n
    for c in region:
        equal = masks.get(c, 0)
        across = (((equal & plus) + plus) ^ plus) | equal | minus
        up, down = minus | (full & ~(across | plus)), plus & across
        score += (up & top > 0) - (down & top > 0)
        best = min(best, score)
        up, down = (up << 1) & full, (down << 1) & full
        equal |= minus
        plus, minus = down | (full & ~(equal | up)), up & equal
    return best


class Matcher:
    """Finds the items of one block in many texts."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        data, offsets = normalised(*text_bytes(pa.array(texts, pa.string())))
        self.ids = np.array(ids, np.int64)
        self.data, self.offsets, self.sizes = data, offsets, np.diff(offsets)
        self.allowed = np.array([edits(s) for s in self.sizes], np.int64)
        self.width = np.array([min(PIECE, s // (edits(s) + 1)) for s in self.sizes], np.int64)
        self.walks = Walks(int(self.sizes.max(initial=1)))
        self.keys = self.walks.keys(data, offsets[:-1].astype(np.int64), self.sizes)
        self.need = np.maximum(1, self.sizes // np.maximum(1, self.width) - self.allowed)
        self.grams = {}
        rolling = RollingHash(data, BYTE_VALUES)
        for q in np.unique(self.width[self.width > 0]):
            item = np.flatnonzero(self.width == q)
            many = self.sizes[item] // q
            owner = np.repeat(item, many)
            piece = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            begin = offsets[owner] + piece * q
            hashes = rolling(begin, begin + q)
            order = np.argsort(hashes, kind="stable")
            hint = np.zeros(1 << 20, bool)
            hint[hashes >> np.uint64(44)] = True
            self.grams[int(q)] = (hashes[order], owner[order], piece[order] * q, hint)

    def _hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, piece place, diagonal) of all pieces found."""
        rolling, found = RollingHash(data, BYTE_VALUES), []
        for q, (hashes, owner, place, hint) in self.grams.items():
            if len(data) < q:
                continue
            begin = np.arange(len(data) - q + 1)
            grams = rolling(begin, begin + q)
            at = np.flatnonzero(hint[grams >> np.uint64(44)])
            low = np.searchsorted(hashes, grams[at], side="left")
            many = np.searchsorted(hashes, grams[at], side="right") - low
            at, low, many = at[many > 0], low[many > 0], many[many > 0]
            text = text_of(at, offsets)
            inside = at + q <= offsets[text + 1]
            at, low, many, text = at[inside], low[inside], many[inside], text[inside]
            entry = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append((np.repeat(text, many), owner[entry], place[entry], np.repeat(at, many) - place[entry]))
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        return tuple(np.concatenate(c) for c in zip(*found))

    def windows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, item, diagonal) where enough pieces lie nearly on one diagonal."""
        text, item, place, diagonal = self._hits(data, offsets)
        spread = 4 * self.allowed[item] + 2
        keep = np.zeros(len(text), bool)
        for shift in (0, 1):
            bucket = (diagonal + (1 << 40) + shift * (spread // 2)) // spread
            order = np.lexsort((place, bucket, item, text))
            t, i, b, p = text[order], item[order], bucket[order], place[order]
            fresh = np.ones(len(t), bool)
            fresh[1:] = (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])
            group = np.cumsum(fresh) - 1
            other = fresh.copy()
            other[1:] |= p[1:] != p[:-1]
            different = np.bincount(group, other, fresh.sum() or 1)
            keep[order] |= different[group] >= self.need[i] if len(t) else False
        found = np.unique(np.stack([text[keep], item[keep], diagonal[keep]]), axis=1)
        return found[0], found[1], found[2]

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item position, distance) of the items found."""
        data, offsets = normalised(data, offsets)
        text, item, diagonal = self.windows(data, offsets)
        out = {}
        for begin in range(0, len(text), 4096):
            t, i, d = (x[begin : begin + 4096] for x in (text, item, diagonal))
            same = (self.walks.keys(data, d.astype(np.int64), self.sizes[i]) == self.keys[i]).any(1)
            for a, b, c in zip(t[same].tolist(), i[same].tolist(), d[same].tolist()):
                k, size = int(self.allowed[b]), int(self.sizes[b])
                if out.get((a, b), k + 1) == 0:
                    continue
                low, high = max(int(offsets[a]), c - 2 * k), min(int(offsets[a + 1]), c + size + 2 * k)
                item_bytes = self.data[self.offsets[b] : self.offsets[b + 1]].tobytes()
                distance = best_distance(item_bytes, data[low:high].tobytes())
                if distance <= k:
                    out[a, b] = min(distance, out.get((a, b), distance))
        return [(a, b, d) for (a, b), d in out.items()]


def _blocks(items: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1].encode())
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """(id, item, distance) of every document that holds an item, once per pair.

    ``items`` has an id and ``text``. Null and empty texts and items match nothing, and a row
    or item without id is passed over. Equal items are all reported; rows with one id are
    reported together. Empty tables give no rows; other columns are ignored. Items are sent
    to the tasks in blocks of a fixed size, one pass over the documents for each.
    """
    schema = f"{id_col} long, {item_col} long, distance int"
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text"))
    rows = rows.where("text != ''")
    wanted = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long"), filled("text")).orderBy(item_col)
    spark = docs.sparkSession
    result = spark.createDataFrame([], schema)
    for ids, texts in _blocks(wanted):
        shipped = spark.sparkContext.broadcast((ids, texts))

        def search(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shipped.value)
            for batch in text_slices(batches, "text"):
                found = matcher.matches(*text_bytes(batch.column(1)))
                if found:
                    text, item, distance = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(text)), pa.array(matcher.ids[list(item)]), pa.array(distance, pa.int32())],
                        names=[id_col, item_col, "distance"],
                    )

        result = result.unionByName(rows.mapInArrow(search, schema))
    return result.groupBy(id_col, item_col).agg(F.min("distance").alias("distance"))


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    return without(docs, contaminated(docs, items, id_col, text_col).select(id_col), id_col)
