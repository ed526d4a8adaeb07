"""Best-fit packing of token sequences with large-item matching.

Documents longer than the capacity are cut into full pieces and a rest. Pieces of one length
are interchangeable, so the packing is planned on the counts of the at most ``capacity``
lengths, whatever the number of documents, and pieces then find their place by their rank
among the pieces of their length:

1. pieces above one third of the capacity fit at most twice into a bin; from the longest
   down, each takes the longest other one that fits beside it;
2. smaller pieces, from the longest down, go to the bin with the smallest gap that holds
   them; what no gap holds opens new bins.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from binloom.llm.common import filled, text_slices
from binloom.llm.encoders import encoder
from binloom.session import cut_lineage


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token pieces of all texts: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(tokenizer)
        for batch in text_slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = codec.ids(text, end_id).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
            columns = zip(*rows)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Places for ``counts[length]`` pieces: per length runs (pieces, first bin, offset).

    A run puts its pieces into consecutive bins, one each, at the same offset. Returns the
    runs in the order of the pieces' ranks, and the number of bins. The work depends on the
    number of different lengths and gaps, not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> ranges of bins (first, how many)
    bins = 0

    order: list[int] = []

    def leave(gap: int, first: int, many: int) -> None:
        if gap:
            if gap not in gaps:
                bisect.insort(order, gap)
            gaps[gap].append((first, many))

    large = [n for n in lengths if 3 * n > capacity]
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        k = bisect.bisect_right(large, capacity - n) - 1
        while k >= 0 and not left[large[k]]:
            large.pop(k)
            k -= 1
        if k < 0:
            many, other = left[n], 0
        else:
            other = large[k]
            many = left[n] // 2 if other == n else min(left[n], left[other])
            if not many:  # a single one of its length is left; it looks for a shorter partner
                k -= 1
                while k >= 0 and not left[large[k]]:
                    k -= 1
                other, many = (large[k], 1) if k >= 0 else (0, 1)
        runs[n].append((many, bins, 0))
        left[n] -= many
        if other:
            runs[other].append((many, bins, n))
            left[other] -= many
        leave(capacity - n - other, bins, many)
        bins += many
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(order, n)
            while k < len(order) and not gaps[order[k]]:
                del gaps[order[k]]
                order.pop(k)
            if k < len(order):
                gap = order[k]
                first, many = gaps[gap].pop()
                placed = min(many, left[n])
                if placed < many:
                    gaps[gap].append((first + placed, many - placed))
                runs[n].append((placed, first, capacity - gap))
                leave(gap - n, first, placed)
                left[n] -= placed
            else:
                slots = min(capacity // n, left[n])
                many = left[n] // slots
                for slot in range(slots):
                    runs[n].append((many, bins, slot * n))
                leave(capacity - slots * n, bins, many)
                left[n] -= many * slots
                bins += many
    return dict(runs), bins


def ranked(rows: DataFrame, total: int) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0.

    A length is ranked in about ``sqrt(total)`` buckets, and the buckets' counts are summed
    up in their order, so neither a bucket nor the list of buckets grows with the hottest
    length as a whole.
    """
    buckets = int(total**0.5) + 1
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")
    rows = rows.withColumn("within", F.row_number().over(within) - 1)
    return rows.join(counts, ["length", "bucket"]).withColumn("rank", F.col("within") + F.col("before"))


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Each document is its ids and ``end_id``; a null text is empty and takes one place. Rows
    with one id are packed one by one, a null id is kept, an empty table gives no rows, and
    other columns are ignored. Full pieces are sequences of their own and take no part in
    the ranking.
    """
    cut = cut_lineage(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    counts.pop(capacity, None)
    runs, bins = plan(counts, capacity)
    keys, firsts, starts, offsets = [], [], [], []
    for length in sorted(runs):
        rank = 0
        for many, first, offset in runs[length]:
            keys.append(length << 44 | rank)
            firsts.append(first)
            starts.append(rank)
            offsets.append(offset)
            rank += many
    keys, firsts, starts, offsets = (np.array(x, np.int64) for x in (keys, firsts, starts, offsets))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(firsts[at] + rank - starts[at]), pa.array(offsets[at])],
                names=[*names, "sequence_id", "offset"],
            )

    short = ranked(cut.where(F.col("length") < capacity), sum(counts.values())).select(*names, "rank")
    short = short.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    full = cut.where(F.col("length") == capacity).select(
        *names, (F.monotonically_increasing_id() + bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    packed = short.unionByName(full)
    return packed if id_col == "doc_id" else packed.withColumnRenamed("doc_id", id_col)
