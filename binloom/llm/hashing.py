"""Vectorised word spans and hashes over the UTF-8 bytes of many texts."""

from __future__ import annotations

import numpy as np

from binloom.llm.common import mixed

#: Multiplier of the rolling hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
#: A 64-bit value per byte; A-Z have those of a-z.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
#: The white space of words: space and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Letters, digits and all bytes of characters beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i <= n, from doubled blocks."""
    if not _powers or len(_powers[0]) <= n:
        tables = []
        for base in (BASE, _INVERSE):
            out = np.ones(1, np.uint64)
            while len(out) <= n:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            tables.append(out)
        _powers[:] = tables
    return _powers[0], _powers[1]


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each run of ``member`` bytes; runs don't cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = member[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    begin = inside & (np.concatenate([[True], ~inside[:-1]]) | fresh[:-1])
    end = inside & (np.concatenate([~inside[1:], [True]]) | fresh[1:])
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


class RollingHash:
    """Hashes of any byte spans of ``data``; equal spans have equal hashes."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        powers, self.inverse = _power_tables(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        plain = (self.sums[end] - self.sums[begin]) * self.inverse[begin]
        return mixed(plain + (end - begin).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def text_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the text that each position lies in."""
    return np.searchsorted(offsets, positions, side="right") - 1
