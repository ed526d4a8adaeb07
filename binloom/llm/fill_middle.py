"""Fill-in-the-middle texts, put together by a secondary sort.

A text is cut into units (lines); two drawn places make them prefix, middle and suffix. Each
part leaves its task as pieces, bounded runs of units keyed by document and by their place in
the output. One exchange by document, sorted by place inside each partition, brings the
pieces of a document together in output order, and they stream through incremental digests
or into whole texts. To restore a text, the same stream is cut at its marks, sorted again by
the place in the original inside the partitions it is in, and streamed once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm.common import filled, text_slices

# The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Marks in the order in which each form's output holds them.
ORDER = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Place of each part in the original text.
ORIGINAL = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Bytes after which a piece ends at the next unit; a longer unit is cut.
PIECE_BYTES = 1 << 15
#: What tells the rows of a table apart: id, a hash of the text and the partition read from.
KEY = ("id", "hash", "part")
_KEYED = "id long, hash long, part int, place int, seq int, piece binary"
FACTS = ("n", "form", "prefix_chars", "middle_chars")
_FACTS = "n long, form string, prefix_chars long, middle_chars long"


@dataclass(frozen=True)
class Rates:
    """How often a text is transformed and how often the suffix comes first, in hundredths."""

    seed: int = 7
    transformed: int = 100
    suffix_first: int = 50


@dataclass(frozen=True)
class Cut:
    """Where a text is cut: units, form, ends of prefix and middle in bytes, their characters."""

    n: int
    form: str
    ends: tuple[int, int]
    chars: tuple[int | None, int | None]


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte after each line; the last line may have no end of line."""
    ends = np.flatnonzero(data == 10) + 1
    return ends if not len(data) or (len(ends) and ends[-1] == len(data)) else np.append(ends, len(data))


def cut(doc_id: int | None, text: bytes, ends: np.ndarray, rates: Rates) -> Cut:
    """The cut that id and text decide; a null id draws as the empty string."""
    drawn = hashlib.sha256(f"{rates.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(ends)
    if not text or any(mark in text for mark in ORIGINAL) or h3 % 100 >= rates.transformed:
        return Cut(n, "plain", (0, 0), (None, None))
    byte = [int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    data = np.frombuffer(text, np.uint8)
    chars = (_characters(data[: byte[0]]), _characters(data[byte[0] : byte[1]]))
    return Cut(n, "spm" if h4 % 100 < rates.suffix_first else "psm", (byte[0], byte[1]), chars)


def runs(begin: int, end: int, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of the pieces of a part: whole units up to the limit, longer units in parts."""
    while begin < end:
        if end - begin <= PIECE_BYTES:
            stop = end
        else:
            k = int(np.searchsorted(ends, begin + PIECE_BYTES, side="right")) - 1
            stop = int(ends[k]) if k >= 0 and ends[k] > begin else begin + PIECE_BYTES
        yield begin, stop
        begin = stop


def output_pieces(text: bytes, ends: np.ndarray, made: Cut) -> Iterator[bytes]:
    """The output of one text in pieces, in order; marks are pieces of their own."""
    if made.form == "plain":
        yield from (text[a:b] for a, b in runs(0, len(text), ends))
        return
    parts = {PREFIX: (0, made.ends[0]), MIDDLE: made.ends, SUFFIX: (made.ends[1], len(text))}
    for mark in ORDER[made.form]:
        yield mark
        yield from (text[a:b] for a, b in runs(*parts[mark], ends))


def restored_parts(pieces: Iterable[bytes], form: str) -> Iterator[tuple[int, bytes]]:
    """Cuts an output at its marks: place of the part in the original, bytes.

    A mark may lie across pieces, so as many bytes as can begin one are held back.
    """
    part, waiting, held = 0, list(ORDER[form]), b""
    for piece in pieces:
        held += piece
        while waiting and (at := held.find(waiting[0])) >= 0:
            if at:
                yield part, held[:at]
            part, held = ORIGINAL[waiting[0]], held[at + len(waiting.pop(0)) :]
        keep = len(waiting[0]) - 1 if waiting else 0
        if len(held) > keep:
            yield part, held[: len(held) - keep]
            held = held[len(held) - keep :]
    if held:
        yield part, held
    if waiting:
        raise ValueError(f"no {waiting[0].decode()} in an output of form {form}")


def pieces(docs: DataFrame, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Output pieces of every row: key, ``place`` 0, ``seq``, ``piece``, facts of the cut.

    Null and empty texts are one empty piece of form plain. Rows that are equal in id and text
    keep their pieces side by side (see ``_documents``); other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            rows = []
            for row in batch.to_pylist():
                text = row["text"]
                ends = unit_ends(np.frombuffer(text, np.uint8))
                made = cut(row["id"], text, ends, rates)
                facts = (made.n, made.form, *made.chars)
                for seq, piece in enumerate([*output_pieces(text, ends, made)] or [b""]):
                    rows.append((row["id"], row["hash"], row["part"], 0, seq, piece, *facts))
            yield _batch(rows)

    text = filled(text_col)
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text).alias("hash"),
        F.spark_partition_id().alias("part"),
        text.cast("binary").alias("text"),
    ).mapInArrow(work, f"{_KEYED}, {_FACTS}")


_SCHEMA = pa.schema(
    [("id", pa.int64()), ("hash", pa.int64()), ("part", pa.int32()), ("place", pa.int32()), ("seq", pa.int32())]
    + [("piece", pa.binary()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in _SCHEMA)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


def assembled(parts: DataFrame) -> DataFrame:
    """Pieces of a document together and in output order: one exchange, sorted inside it."""
    return parts.repartition(*KEY).sortWithinPartitions(*KEY, "place", "seq")


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[int, bytes]]]]:
    """Documents of a sorted stream: first row with ``copies``, and the pieces with their place.

    Equal rows of one partition share a key, so each of their pieces comes ``copies`` times
    in a row: the stream gives it once. Nothing but the current batch is held.
    """
    stream = (row for batch in batches for row in batch.to_pylist())
    row = next(stream, None)
    while row is not None:
        first, key = row, tuple(row[k] for k in KEY)
        first["copies"], at = 1, (row["place"], row["seq"])
        row = next(stream, None)
        while row is not None and tuple(row[k] for k in KEY) == key and (row["place"], row["seq"]) == at:
            first["copies"] += 1
            row = next(stream, None)

        def rest() -> Iterator[tuple[int, bytes]]:
            nonlocal row
            yield first["place"], first["piece"]
            last = at
            while row is not None and tuple(row[k] for k in KEY) == key:
                if (here := (row["place"], row["seq"])) != last:
                    yield row["place"], row["piece"]
                last = here
                row = next(stream, None)

        inside = rest()
        yield first, inside
        for _ in inside:  # whatever the caller left
            pass


def fill_in_middle(docs: DataFrame, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole outputs: id, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    A row per row of ``docs``, repeated and null ids included; null texts are empty ones. An
    output is put together in the task that holds its document, so it needs its own length.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = Rows((id_col, *FACTS, "output")), 0
        for first, parts in _documents(batches):
            output = b"".join(piece for _, piece in parts).decode()
            for _ in range(first["copies"]):
                out.add(first["id"], *(first[k] for k in FACTS), output)
                size += len(output)
                if size >= 1 << 20:
                    yield out.batch()
                    size = 0
        yield out.batch()

    return assembled(pieces(docs, rates, id_col, text_col)).mapInArrow(work, f"{id_col} long, {_FACTS}, output string")


class Rows:
    """Rows of a result until they leave as a batch; numbers are long, all else text."""

    def __init__(self, names: tuple[str, ...]):
        self.names, self.rows = names, []

    def add(self, *row) -> None:
        self.rows.append(row)

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else ([] for _ in self.names)
        texts = ("form", "output", "output_sha256", "restored_sha256")
        arrays = [pa.array(c, pa.string() if k in texts else pa.int64()) for k, c in zip(self.names, columns)]
        self.rows = []
        return pa.RecordBatch.from_arrays(arrays, names=list(self.names))


def restoring(sorted_pieces: DataFrame) -> DataFrame:
    """Pieces in the order of the original text, and per document its output's digest first.

    Reads nothing but the outputs and their forms. The rows stay in their partitions, so the
    second sort needs no exchange.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for first, parts in _documents(batches):
            digest = hashlib.sha256()
            key, facts = [first[k] for k in KEY], [first[k] for k in FACTS]

            def seen() -> Iterator[bytes]:
                for _, piece in parts:
                    digest.update(piece)
                    yield piece

            for seq, (part, piece) in enumerate(restored_parts(seen(), first["form"])):
                rows.append((*key, part, seq, piece, *facts))
                size += len(piece)
                if size >= 1 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            rows += [(*key, -1, 0, digest.digest(), *facts)] * first["copies"]
        yield _batch(rows)

    return sorted_pieces.mapInArrow(work, sorted_pieces.schema).sortWithinPartitions(*KEY, "place", "seq")


def fill_in_middle_digests(docs: DataFrame, rates: Rates = Rates(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of outputs and of the texts restored from them; no output is held as a whole.

    A row per row of ``docs``: id, ``n``, ``form``, ``prefix_chars`` and ``middle_chars`` (null
    for plain), ``output_sha256``, ``restored_sha256``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows((id_col, *FACTS, "output_sha256", "restored_sha256"))
        for first, parts in _documents(batches):
            digest = hashlib.sha256()
            next(parts)  # the output's digest
            for _, piece in parts:
                digest.update(piece)
            for _ in range(first["copies"]):
                out.add(first["id"], *(first[k] for k in FACTS), first["piece"].hex(), digest.hexdigest())
                if len(out.rows) >= 4096:
                    yield out.batch()
        yield out.batch()

    rows = restoring(assembled(pieces(docs, rates, id_col, text_col)))
    return rows.mapInArrow(work, f"{id_col} long, {_FACTS}, output_sha256 string, restored_sha256 string")
