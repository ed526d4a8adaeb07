"""Exact token ids at corpus speed: whole texts are cut where tokens never cross.

A text is cut at single spaces between plain characters, where the tokenizer's own splitting
always cuts; each different piece is encoded once by the tokenizer's model and kept in a
bounded table of the Python worker. Texts with other characters next to a space, or with the
strings of special tokens, go through the library as a whole.
"""

from __future__ import annotations

import re
import struct
from functools import cache

import numpy as np

#: Pieces kept by a worker; beyond it the table starts anew, with the same results.
MAX_PIECES = 500_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = f"!-~{_LETTERS[6:]}"
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
_MARKS = r"!-/:-@\[-`{-~"
_PIECE = {
    "byte": re.compile(rf"{_CONTRACTED}| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|[ \n]+(?![^ \n])|[ \n]+"),
    "word": re.compile(rf"{_CONTRACTED}|[{_LETTERS}]+|[0-9]|[{_MARKS}]+"),
}
_OTHER = re.compile(rf"[^\n {_PLAIN}]")
#: Other characters next to a space, or first or last; the spaces themselves are looked at by ``_unsafe_space``.
_UNSAFE_OTHER = re.compile(rf"[^ {_PLAIN}](?:(?= )|\Z|(?<= [\s\S])|(?<=\A[\s\S]))")


def _unsafe_space(text: str) -> bool:
    return text[0] == " " or text[-1] == " " or "  " in text or _UNSAFE_OTHER.search(text) is not None


@cache
def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, spare = {}, 256
    for byte in range(256):
        table[byte] = chr(byte if byte in printable else spare)
        spare += byte not in printable
    return table


class _Table(dict):
    """A dict that fills itself and starts anew when it is full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= MAX_PIECES:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Encoder:
    """Packed ids of texts, equal to the library's with ``add_special_tokens=False``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "byte" if self.tokenizer.normalizer is None else "word"
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4")
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.words, self.units = _Table(self._word), _Table(self._unit)
        self.spaced = _Table(lambda unit: self._unit(f" {unit}")) if self.kind == "byte" else self.units

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.asarray(ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # only the space has a stand-in there
            shown = word.replace(" ", "\u0120")
        else:
            shown = word.encode().decode("latin-1").translate(byte_letters())
        ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def _plain(self, text: str) -> bytes:
        text = text.lower() if self.kind == "word" else text
        return b"".join(map(self.words.__getitem__, _PIECE[self.kind].findall(text)))

    def _unit(self, unit: str) -> bytes:
        """Ids of what stands between two spaces, with the one before it."""
        if unit.isascii() and unit.isprintable():
            if unit.lstrip(" ").isalpha():  # a single piece
                return self._word(unit.lower() if self.kind == "word" else unit)
            return self._plain(unit)
        return self._whole(unit) if _OTHER.search(unit) else self._plain(unit)

    def packed(self, text: str) -> bytes:
        """Ids of one text as little-endian integers of ``dtype``."""
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self._whole(text)
        if _unsafe_space(text):
            return self._whole(text) if _OTHER.search(text) else self._plain(text)
        first, *rest = text.split(" ")
        return self.units[first] + b"".join(map(self.spaced.__getitem__, rest))

    def ids(self, text: str, end: int | None = None) -> np.ndarray:
        tail = b"" if end is None else np.array([end], self.dtype).tobytes()
        return np.frombuffer(self.packed(text) + tail, self.dtype)


@cache
def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    return Encoder(path)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
