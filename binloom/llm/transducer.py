"""Token counts by a compiled finite-state transducer.

The tokenizer is compiled, state by state as texts need it, into a deterministic transducer
over bytes. Within one pre-token a state is what later bytes can still depend on: the longest
ending that may grow into a token, the last token of the encoding up to each place of that
ending, and the counts there relative to now. A transition is annotated with the change of the
token count, so the sum of all annotations over a text is its number of tokens. A pre-token's
first byte resets the state; where pre-tokens begin is decided by the classes of neighbouring
characters alone.

Texts are cut into chunks that run side by side. A chunk with a reset maps every entry state
to the same exit state; the others run from the exit state of the chunk before, one after
another, and only the bytes before a chunk's first reset wait for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm.common import filled, text_bytes, text_slices
from binloom.llm.encoders import byte_letters

#: States that a worker keeps; beyond it the compilation starts anew, with the same counts.
MAX_STATES = 200_000
CHUNK = 128
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
_FIXED = np.zeros(128, np.uint8)
_FIXED[:] = OTHER
_FIXED[[*range(65, 91), *range(97, 123)]] = LETTER
_FIXED[48:58] = NUMBER
_FIXED[[9, 10, 11, 12, 13, 32]] = SPACE


class Transducer:
    """Counts tokens as one byte-level tokenizer file gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = {c: b for b, c in byte_letters().items()}
        added = self.tokenizer.get_added_tokens_decoder()
        self.specials = [t.content for t in added.values()]
        self.tokens = {
            bytes(letters[c] for c in word): n for word, n in self.tokenizer.get_vocab(with_added_tokens=False).items() if n not in added
        }
        self.names = {word: word for word in self.tokens}
        self.growing = {word[:k] for word in self.tokens for k in range(1, len(word))}
        self.classes = np.zeros(0x110000, np.uint8)
        self.classes[:128] = _FIXED
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self._restart()

    def _restart(self) -> None:
        start = (b"", (None,), (0,))
        self.states, self.number = [start], {start: 0}
        self.column = np.zeros(256, np.uint8)  # of each byte seen; column 0 is empty
        self.target = np.full((1024, 64), -1, np.int32)
        self.change = np.zeros((1024, 64), np.int8)

    def _widen(self, rows: int, columns: int) -> None:
        more = ((0, rows), (0, columns))
        self.target = np.pad(self.target, more, constant_values=-1)
        self.change = np.pad(self.change, more)

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """The table columns of the bytes; a byte has one from when it is first seen."""
        new = np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column == 0))
        if len(new):
            used = int(self.column.max())
            self.column[new] = np.arange(used + 1, used + 1 + len(new))
            if used + len(new) >= self.target.shape[1]:
                self._widen(0, used + len(new) + 16 - self.target.shape[1])
        return self.column[data]

    def _follows(self, before: bytes | None, token: bytes) -> bool:
        """Whether the two tokens can stand side by side in an encoding."""
        if before is None:
            return True
        if (known := self.fits.get((before, token))) is None:
            shown = (before + token).decode("latin-1").translate(byte_letters())
            known = [t.id for t in self.tokenizer.model.tokenize(shown)] == [self.tokens[before], self.tokens[token]]
            self.fits[before, token] = known
        return known

    def _compile(self, state: int, column: int) -> None:
        byte = int(np.flatnonzero(self.column == column)[0])
        ending, last, counts = self.states[state]
        grown = ending + bytes((byte,))
        size = len(grown)
        for length in range(size, 0, -1):  # one token fits, found from the longest
            token = grown[size - length :]
            if token in self.tokens and self._follows(last[size - length], token):
                token = self.names[token]
                break
        else:
            raise ValueError("no token ends here")
        count = counts[size - length] + 1
        for kept in range(size, -1, -1):
            if not kept or grown[size - kept :] in self.growing:
                break
        last, counts = (*last, token)[size - kept :], (*counts, count)[size - kept :]
        key = (grown[size - kept :], last, tuple(c - count for c in counts))
        if (number := self.number.get(key)) is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
            if number >= len(self.target):
                self._widen(len(self.target) // 4, 0)
        self.target[state, column] = number
        self.change[state, column] = count

    def _step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        target = self.target[state, byte]
        if (target < 0).any():
            missing = target < 0
            for pair in np.unique(state[missing].astype(np.int64) * 256 + byte[missing]).tolist():
                self._compile(pair >> 8, pair & 255)
            target = self.target[state, byte]
        return target, self.change[state, byte]

    def _class_of(self, points: np.ndarray) -> np.ndarray:
        """Character classes; the library is asked once for each character beyond ASCII."""
        found = self.classes[points]
        for point in np.unique(points[found == 0]).tolist():
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for kind, before in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
                if len(cut(before + chr(point))) == 1:
                    break
            else:
                kind = SPACE
            self.classes[point] = kind
        return self.classes[points]

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether a pre-token begins at each byte."""
        place = np.flatnonzero((data & 0xC0) != 0x80)
        wide = data.astype(np.int64)
        padded = np.concatenate([wide, [0, 0, 0]])
        head = wide[place]
        more = [padded[place + k] & 63 for k in (1, 2, 3)]
        point = np.select(
            [head < 0x80, head < 0xE0, head < 0xF0],
            [head, (head & 31) << 6 | more[0], (head & 15) << 12 | more[0] << 6 | more[1]],
            (head & 7) << 18 | more[0] << 12 | more[1] << 6 | more[2],
        )
        kind, n = self._class_of(point), len(point)
        fresh = np.zeros(n + 1, bool)
        fresh[np.searchsorted(place, offsets)] = True
        before = np.where(fresh[:n], 0, np.concatenate([[0], kind[:-1]]))
        after = np.where(fresh[1:], 0, np.concatenate([kind[1:], [0]]))
        blank = point == 32
        after_blank = ~fresh[:n] & np.concatenate([[False], blank[:-1]])
        begins = (kind != before) & ~after_blank
        begins |= (kind == SPACE) & (after != SPACE) & (after != 0)
        begins |= fresh[:n]
        quote = np.flatnonzero((point == 39) & (before != OTHER) & ~after_blank)
        if len(quote):
            text = np.cumsum(fresh[:n])
            at = lambda k: np.where(quote + k < n, point[np.minimum(quote + k, n - 1)], 0) * (
                text[np.minimum(quote + k, n - 1)] == text[quote]
            )
            one = np.isin(at(1), [ord(c) for c in "stmd"])
            two = sum((at(1) == ord(a)) & (at(2) == ord(b)) for a, b in ("re", "ve", "ll")).astype(bool)
            for found, size in ((one, 1), (two & ~one, 2)):
                begins[quote[found] + 1] = False
                end = quote[found] + 1 + size
                end = end[end < n]
                begins[end[(kind[end] == LETTER)]] = True
        out = np.zeros(len(data), bool)
        out[place[begins]] = True
        return out

    def changes(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The annotation of every byte's transition."""
        if len(self.states) > MAX_STATES:
            self._restart()
        n = len(data)
        if not n:
            return np.zeros(0, np.int8)
        resets = self.starts(data, offsets)
        lanes = -(-n // CHUNK)
        size = lanes * CHUNK
        byte = np.zeros(size, np.uint8)
        byte[:n] = self._columns(data)
        byte[n:] = byte[n - 1]
        reset = np.ones(size, bool)
        reset[:n] = resets
        byte, reset = byte.reshape(lanes, CHUNK).T.copy(), reset.reshape(lanes, CHUNK).T.copy()
        out = np.zeros((CHUNK, lanes), np.int8)
        state, met = np.zeros(lanes, np.int32), np.zeros(lanes, bool)
        for k in range(CHUNK):
            state = np.where(reset[k], 0, state)
            met |= reset[k]
            on = np.flatnonzero(met)
            state[on], out[k, on] = self._step(state[on], byte[k, on])
        heads = np.where(met, reset.argmax(0), CHUNK)
        waiting = np.flatnonzero(heads > 0)
        ready = met.copy()  # chunks whose exit is known
        while len(waiting):
            now = waiting[ready[waiting - 1]]
            entry, left = state[now - 1], heads[now]
            for k in range(int(left.max())):
                on = np.flatnonzero(left > k)
                entry[on], out[k, now[on]] = self._step(entry[on], byte[k, now[on]])
            through = ~met[now]
            state[now[through]] = entry[through]
            ready[now] = True
            waiting = waiting[~np.isin(waiting, now)]
        return out.T.reshape(-1)[:n]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null is empty."""
        owner, extra = np.arange(len(texts)), np.zeros(len(texts), np.int64)
        for special in self.specials:
            if pa.compute.any(pa.compute.match_substring(texts, special)).as_py():
                parts = [(t or "").split(special) for t in texts.to_pylist()]
                sizes = np.array([len(p) for p in parts])
                extra += np.bincount(owner, sizes - 1, len(extra)).astype(np.int64)
                owner, texts = np.repeat(owner, sizes), pa.array([s for p in parts for s in p], pa.large_string())
        data, offsets = text_bytes(texts)
        sums = np.concatenate([[0], np.cumsum(self.changes(data, offsets), dtype=np.int64)])
        return np.bincount(owner, sums[offsets[1:]] - sums[offsets[:-1]], len(extra)).astype(np.int64) + extra


@cache
def transducer(path: str) -> Transducer:
    """One transducer per file and Python worker."""
    return Transducer(path)


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit for every row.

    Null texts are empty: 0 bytes, 0 tokens. Ids may be null or repeated and are returned as
    they are; an empty table gives no rows; other columns are ignored.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer)
        for batch in text_slices(batches, "text"):
            tokens = machine.count(batch.column(1))
            size = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, pa.array(tokens), pa.array(tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col), filled(text_col).alias("text"))
    return rows.mapInArrow(counted, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
