"""Alignment of two tokenizers' tokens over the bytes of each text.

Both id lists of a document are turned into cumulative byte ends. Dictionaries from end to
index are intersected as hash sets; the sorted common ends cut both lists into groups, and
the links (pairs of tokens that share bytes) are expanded inside each group. Corpus counts of
linked id pairs come from a grouped sum; they return to the documents by a join in which the
frequent pairs, of which there is a bounded number, are broadcast and all others shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.llm.common import filled, text_slices
from binloom.llm.encoders import Encoder, byte_letters
from binloom.session import cut_lineage

#: A pair is kept as ``a << PAIR_BITS | b``.
PAIR_BITS = 20
#: Tokens whose ends one dictionary holds; a group beyond that doubles its block.
BLOCK = 1 << 16
#: A pair with more than one in so many of all (document, pair) rows is broadcast; the rows
#: add up, so there are fewer such pairs than this.
HOT_PAIRS = 100_000

ALIGNED = (
    "row long, id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, pairs array<long>, hits array<int>"
)


class EntryBytes:
    """Bytes of the entries of a vocabulary."""

    def __init__(self, entries: list[bytes]):
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.lengths = np.array([len(e) for e in entries])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def joined(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(self.starts[ids] - before, lengths) + np.arange(lengths.sum())].tobytes()


class ByteSide(Encoder):
    """Side A: byte-level ids; strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.specials = []
        back = {ord(shown): byte for byte, shown in byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        entries = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            entries[k] = bytes(back[ord(c)] for c in entry)
        self.table = EntryBytes(entries)

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.packed(" " + text), self.dtype) for text in texts]


class PieceSide:
    """Side B: pieces of a model that sets a space before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.table = EntryBytes(
            [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        )

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(ids, "<i4") for ids in self.model.encode(texts, num_threads=1)]


@cache
def byte_side(path: str) -> ByteSide:
    return ByteSide(path)


@cache
def piece_side(path: str) -> PieceSide:
    return PieceSide(path)


def shared_ends(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int]]:
    """Tokens of either list up to each common end, in order."""
    index_a, index_b = dict(zip(ends_a, count(1))), dict(zip(ends_b, count(1)))
    ends = sorted(index_a.keys() & index_b.keys())
    return list(map(index_a.__getitem__, ends)), list(map(index_b.__getitem__, ends))


def blocks(ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """Runs of groups: tokens before the run, and the cuts of both lists counted from there.

    Each dictionary holds ``BLOCK`` ends, so a text of any length needs a bounded amount;
    what follows the last common end of a block is taken again with the next one.
    """
    i = j = 0
    size = BLOCK
    while i < len(ends_a):
        stop_a = min(i + size, len(ends_a))
        stop_b = int(np.searchsorted(ends_b, ends_a[stop_a - 1], side="right"))
        cuts_a, cuts_b = shared_ends(ends_a[i:stop_a].tolist(), ends_b[j:stop_b].tolist())
        if not cuts_a:
            if stop_a == len(ends_a):
                raise ValueError("the lists do not cover the same bytes")
            size *= 2
            continue
        yield i, j, cuts_a, cuts_b
        i, j, size = i + cuts_a[-1], j + cuts_b[-1], BLOCK


def slice_links(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Linked pairs of a run of groups.

    Two tokens that share bytes share one stretch, and it ends where the first of them ends.
    So each end inside a group stands for one link: that of the tokens that hold its last byte.
    """
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")
    ends = ends[np.diff(ends, prepend=0) > 0]
    a, b = ids_a[np.searchsorted(ends_a, ends)], ids_b[np.searchsorted(ends_b, ends)]
    return a.astype(np.int64) << PAIR_BITS | b


def shown_groups(ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> bytes:
    """The groups as text, each with a closing semicolon."""
    group_a = np.searchsorted(cuts_a, np.arange(len(ids_a)), side="right")
    group_b = np.searchsorted(cuts_b, np.arange(len(ids_b)), side="right")
    shown = np.empty(len(ids_a) + len(ids_b), "S8")
    before = np.concatenate([[0], cuts_b])
    place_a, place_b = np.arange(len(ids_a)) + before[group_a], np.arange(len(ids_b)) + cuts_a[group_b]
    most = int(max(ids_a.max(), ids_b.max())).bit_length()
    comma, bar, semicolon = (_decimals(mark, most) for mark in ",|;")
    shown[place_a], shown[place_b] = comma[ids_a], comma[ids_b]
    shown[place_a[cuts_a - 1]], shown[place_b[cuts_b - 1]] = bar[ids_a[cuts_a - 1]], semicolon[ids_b[cuts_b - 1]]
    return shown.tobytes().translate(None, b"\0")


@cache
def _decimals(mark: str, bits: int) -> np.ndarray:
    """Each id of so many bits in decimals with ``mark`` behind it."""
    return np.array([f"{k}{mark}" for k in range(1 << bits)], "S8")


def align(ids_a: np.ndarray, ids_b: np.ndarray, lengths_a: np.ndarray, lengths_b: np.ndarray) -> tuple[int, np.ndarray, str]:
    """Number of groups, linked pairs and digest of the groups of one document."""
    ends_a, ends_b = np.cumsum(lengths_a[ids_a]), np.cumsum(lengths_b[ids_b])
    digest, groups, links = hashlib.sha256(), 0, []
    for i, j, cuts_a, cuts_b in blocks(ends_a, ends_b):
        run_a, run_b = slice(i, i + cuts_a[-1]), slice(j, j + cuts_b[-1])
        links.append(slice_links(ids_a[run_a], ids_b[run_b], ends_a[run_a], ends_b[run_b]))
        shown = shown_groups(ids_a[run_a], ids_b[run_b], np.array(cuts_a), np.array(cuts_b))
        digest.update(shown if run_a.stop < len(ids_a) else shown[:-1])
        groups += len(cuts_a)
    return groups, np.concatenate(links), digest.hexdigest()


def _aligned(texts: list[str], side_a: ByteSide, side_b: PieceSide) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "hits")}
    for text, ids_a, ids_b in zip(texts, side_a.encoded(texts), side_b.encoded(texts)):
        plain = b" " + text.encode()
        if not text or side_a.table.joined(ids_a) != plain or side_b.table.joined(ids_b) != plain:
            row = (0, 0, 0, 0, "", [], [])
        else:
            groups, links, digest = align(ids_a, ids_b, side_a.table.lengths, side_b.table.lengths)
            pairs, hits = np.unique(links, return_counts=True)
            row = (len(ids_a), len(ids_b), groups, len(links), digest, pairs, hits)
        for values, value in zip(out.values(), row):
            values.append(value)
    return out


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, digest of the groups, and linked id pairs with hits.

    ``pairs`` holds the different pairs of the document as ``a << PAIR_BITS | b``, ``hits``
    how many of its links each has. Null and empty texts, and texts whose tokens' bytes are
    not those of the text, have no tokens: zeros, an empty digest and no pairs. Repeated and
    null ids are rows of their own under ``row``; other columns are not read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in text_slices(batches, "text"):
            done = _aligned(batch.column(1).to_pylist(), byte_side(bytes_path), piece_side(pieces_path))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in done["pairs"]])]).astype(np.int32)
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, kind), *done.pop(name)]).astype(kind)))
                for name, kind in (("pairs", np.int64), ("hits", np.int32))
            ]
            digests = pa.array(done.pop("groups_sha256"), pa.string())
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            counts = [pa.array(values, pa.int64()) for values in done.values()]
            yield pa.RecordBatch.from_arrays(
                [rows, batch.column(0), *counts, digests, *lists],
                names=["row", "id", *done, "groups_sha256", "pairs", "hits"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text")).mapInArrow(work, ALIGNED)


def pair_counts(rows: DataFrame) -> DataFrame:
    """Linked id pairs of the corpus: pair, ``n_docs``, and whether no pair of its A id has more.

    The window runs over the pairs of one A id, at most as many as B has entries.
    """
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    same_a = Window.partitionBy(F.shiftright("pair", PAIR_BITS))
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(same_a))


def alignment_counts(docs: DataFrame, bytes_path: str, pieces_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its alignment, and how its links stand in the whole corpus.

    ``n_best`` counts the links whose pair is in as many documents as any pair of the same A
    id, ties included; ``count_sum`` adds the documents of each link's pair. Rows are as in
    ``aligned``; an empty table gives no rows.
    """
    rows = cut_lineage(aligned(docs, bytes_path, pieces_path, id_col, text_col))
    counts = cut_lineage(pair_counts(rows))
    total = rows.agg(F.sum(F.size("pairs").cast("long"))).head()[0] or 0
    links = rows.select("row", F.inline(F.arrays_zip("pairs", "hits"))).withColumnRenamed("pairs", "pair")
    hot = counts.where(F.col("n_docs") * HOT_PAIRS > F.lit(total))  # fewer than HOT_PAIRS: their rows add up to total
    frequent = links.join(F.broadcast(hot), "pair")
    rare = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(
        counts.where(F.col("n_docs") * HOT_PAIRS <= F.lit(total)), "pair"
    )
    best = F.when(F.col("best"), F.col("hits")).otherwise(0)
    sums = (
        frequent.unionByName(rare)
        .groupBy("row")
        .agg(F.sum(best).alias("n_best"), F.sum(F.col("n_docs") * F.col("hits")).alias("count_sum"))
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return rows.join(sums, "row", "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
