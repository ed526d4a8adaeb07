"""Near-duplicate documents: an LSH forest over MinHash signatures, confirmed on full sets.

A document's signature is a row of minima. Each tree of the forest is one order of the
signature's places: all signatures are sorted by it, and those with the longest common
prefixes stand side by side. A document takes its nearest neighbours in each order as
candidates, so it looks only as deep as its region is crowded: far down among thousands of
alike documents, at the first place where it has few neighbours. Candidates whose whole
signatures are far apart are left out; the others are confirmed on their full shingle sets.
Crowds that agree in the first places of a tree and still fall into several components are
then compared in whole, in blocks, since the neighbours of a row do not reach across them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm.common import attach, filled, mixed, text_bytes, text_slices
from binloom.llm.components import components
from binloom.llm.exact_dedup import cell_filter, in_filter, without
from binloom.llm.hashing import BYTE_VALUES, NOT_SPACE, RollingHash, spans, text_of
from binloom.session import cut_lineage

WORDS = 5
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 75
PLACES = 64
TREES = 20
DEPTH = 8
NEIGHBOURS = 6
#: Rows that agree in so many first places of an order are all compared, however many they are.
WHOLE_DEPTH = 4
#: Rows of one side of a comparison inside such a crowd.
CROWD_ROWS = 512
#: Places that two signatures must share to be confirmed: 3.5 standard errors below a link.
SHARED = 36

_rng = np.random.default_rng(20240501)
_FACTORS = _rng.integers(0, 1 << 32, (3, PLACES), dtype=np.uint32) | np.uint32(1)
#: The order of each tree: its first places; no two trees begin alike.
_begins = _rng.permutation(PLACES)[:TREES]
ORDERS = np.stack([np.concatenate([[f], (o := _rng.permutation(PLACES))[o != f]])[:DEPTH] for f in _begins])
_MULTIPLIERS = mixed(np.arange(11, 11 + WORDS, dtype=np.uint64)) | np.uint64(1)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all shingles in the order of the texts; not distinct.

    Words are runs without white space, A-Z as a-z. Texts of fewer than five words have
    their whole sequence as one shingle, texts without words have none.
    """
    data, offsets = text_bytes(texts)
    begin, end = spans(data, offsets, NOT_SPACE)
    words, owner = RollingHash(data, BYTE_VALUES)(begin, end), text_of(begin, offsets)
    counts = np.bincount(owner, minlength=len(texts))
    n = len(words) - WORDS + 1
    if n > 0:
        total = sum((words[k : n + k] * _MULTIPLIERS[k] for k in range(WORDS)), np.zeros(n, np.uint64))
        whole = owner[:n] == owner[WORDS - 1 :]
        owners, found = owner[:n][whole], mixed(total[whole])
    else:
        owners, found = owner[:0], words[:0]
    few = (counts > 0) & (counts < WORDS)
    if few.any():
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        short = np.flatnonzero(few)
        total = counts[short].astype(np.uint64)
        for k in range(WORDS - 1):
            has = counts[short] > k
            at = np.minimum(first[short] + k, len(words) - 1)
            total = total + np.where(has, words[at] * _MULTIPLIERS[k], np.uint64(0))
        owners, found = np.concatenate([owners, short]), np.concatenate([found, mixed(total)])
        order = np.argsort(owners, kind="stable")
        owners, found = owners[order], found[order]
    return owners, found


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    owners, found = shingles(texts)
    return [np.unique(s) for s in np.split(found, np.searchsorted(owners, np.arange(1, len(texts))))]


def signatures(owners: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """n x PLACES minima, 16 bits each."""
    out = np.full((n, PLACES), 0xFFFFFFFF, np.uint32)
    if len(found):
        begins = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]]))
        low = (found >> np.uint64(32)).astype(np.uint32)
        for k in range(PLACES):
            v = low * _FACTORS[0, k] + _FACTORS[1, k]
            v ^= v >> np.uint32(15)
            v *= _FACTORS[2, k]
            out[owners[begins], k] = np.minimum.reduceat(v, begins)
    return (out >> np.uint32(16)).astype(np.uint16)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a contiguous matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _matrix(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        owners, found = shingles(batch.column(1))
        sets = [np.unique(s) for s in np.split(found, np.searchsorted(owners, np.arange(1, batch.num_rows)))]
        prints = np.array([(s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(s))) for s in sets], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                _binary(prints.reshape(-1, 2)),
                _binary(signatures(owners, found, batch.num_rows)),
            ],
            names=["id", "n", "print", "places"],
        )


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for begin in range(0, whole.num_rows, 4096):
            batch = whole.slice(begin, 4096)
            places = _matrix(batch.column(2), "<u2", PLACES)
            low = _binary((places & 0xFF).astype(np.uint8))
            for tree, order in enumerate(ORDERS):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(places), tree, np.int32)),
                        _binary(places[:, order].astype(">u2")),
                        batch.column(0),
                        batch.column(1),
                        low,
                    ],
                    names=["tree", "key", "id", "n", "low"],
                )


_NEIGHBOUR_SCHEMA = "a long, b long, shared int, tree int, key binary, id long, n long, low binary"


def _near(rows: dict[str, np.ndarray]) -> list[np.ndarray]:
    """a, b, shared of the candidates among sorted rows."""
    out = []
    n = len(rows["id"])
    for lag in range(1, min(NEIGHBOURS, n - 1) + 1):
        i = np.flatnonzero((rows["tree"][lag:] == rows["tree"][:-lag]) & (rows["head"][lag:] == rows["head"][:-lag])) + lag
        j = i - lag
        small, large = np.minimum(rows["n"][i], rows["n"][j]), np.maximum(rows["n"][i], rows["n"][j])
        fits = (100 * small >= PERCENT * large) & (rows["id"][i] != rows["id"][j])
        i, j = i[fits], j[fits]
        shared = (rows["low"][i] == rows["low"][j]).sum(1)
        alike = shared >= SHARED
        a, b = rows["id"][i[alike]], rows["id"][j[alike]]
        out.append(np.stack([np.minimum(a, b), np.maximum(a, b), shared[alike]]))
    return out


def _neighbours(batches: Iterator[pa.RecordBatch], border: bool = True) -> Iterator[pa.RecordBatch]:
    """Candidates of one sorted partition, and the rows at its two borders."""
    kept: pa.Table | None = None
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        rows = {
            "tree": table.column("tree").to_numpy(),
            "head": np.array([k[:2] for k in table.column("key").to_pylist()]),
            "id": table.column("id").to_numpy(),
            "n": table.column("n").to_numpy(),
            "low": _matrix(table.column("low"), np.uint8, PLACES),
        }
        pairs = _near(rows)
        found = np.concatenate(pairs, 1) if pairs else np.zeros((3, 0), np.int64)
        if found.shape[1]:
            yield _candidates(np.unique(found, axis=1))
        if border and first:
            yield _border(table.slice(0, NEIGHBOURS))
        first = False
        kept = table.slice(max(0, table.num_rows - NEIGHBOURS))
    if border and kept is not None:
        yield _border(kept)


def _candidates(found: np.ndarray) -> pa.RecordBatch:
    n = found.shape[1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(found[0]),
            pa.array(found[1]),
            pa.array(found[2].astype(np.int32)),
            pa.nulls(n, pa.int32()),
            pa.nulls(n, pa.binary()),
            pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.binary()),
        ],
        names=["a", "b", "shared", "tree", "key", "id", "n", "low"],
    )


def _border(table: pa.Table) -> pa.RecordBatch:
    n = table.num_rows
    columns = [table.column(c).combine_chunks() for c in ("tree", "key", "id", "n", "low")]
    return pa.RecordBatch.from_arrays(
        [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *columns],
        names=["a", "b", "shared", "tree", "key", "id", "n", "low"],
    )


def candidates(signed: DataFrame) -> DataFrame:
    """(a, b, shared) of all neighbours in the sorted orders, each pair once.

    Rows are sorted over all partitions. The rows at the borders of the partitions, a fixed
    number for each, are sorted and compared once more, so no neighbours are missed there.
    """
    rows = signed.select("id", "n", "places").mapInArrow(_tree_rows, "tree int, key binary, id long, n long, low binary")
    rows = rows.repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
    found = cut_lineage(rows.mapInArrow(_neighbours, _NEIGHBOUR_SCHEMA))
    borders = found.where("tree IS NOT NULL").select("tree", "key", "id", "n", "low").distinct()
    borders = borders.coalesce(1).sortWithinPartitions("tree", "key", "id")
    late = borders.mapInArrow(lambda batches: _neighbours(batches, border=False), _NEIGHBOUR_SCHEMA)
    pairs = found.where("tree IS NULL").unionByName(late).groupBy("a", "b").agg(F.max("shared").alias("shared"))
    return cut_lineage(pairs)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "hashes"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets are alike enough."""
    for batch in batches:
        alike = []
        for a, b in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([a, b]))
            common = int((both[1:] == both[:-1]).sum())
            alike.append(100 * common >= PERCENT * (len(a) + len(b) - common))
        yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among candidate pairs. A document is in a bounded number of pairs."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("set_b"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    return cut_lineage(joined.mapInArrow(_linked, "a long, b long"))


def _begin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row once per tree with its first places there, as one number."""
    for batch in batches:
        places = _matrix(batch.column(2), "<u2", PLACES)
        for tree, order in enumerate(ORDERS):
            begin = np.ascontiguousarray(places[:, order[:WHOLE_DEPTH]]).view("<i8").ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(places), tree, np.int32)), pa.array(begin), batch.column(0), batch.column(1)],
                names=["tree", "begin", "id", "component"],
            )


def _crowd_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components among the rows of each cell; cells come one after the other."""
    held: pa.Table | None = None

    def linked(rows: pa.Table) -> pa.RecordBatch:
        found = _cross_links(rows.column("component").to_numpy(), [np.frombuffer(h, np.uint64) for h in rows.column("hashes").to_pylist()])
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        cell = np.stack([table.column(c).to_numpy() for c in ("tree", "begin", "low", "high")])
        ends = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1
        for begin, end in itertools.pairwise([0, *ends]):
            yield linked(table.slice(begin, end - begin))
        held = table.slice(ends[-1] if len(ends) else 0)
    if held is not None:
        yield linked(held)


def _cross_links(component: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Pairs of different components with linked sets, from the exact sizes of all intersections."""
    out = [np.zeros((2, 0), np.int64)]
    if len(sets) and component.min() != component.max():
        sizes = np.array([len(s) for s in sets])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        known, word = np.unique(np.concatenate(sets), return_inverse=True)
        has = np.zeros(len(known), np.int64)
        for i in range(len(sets) - 1):
            mine, begin = word[bounds[i] : bounds[i + 1]], bounds[i + 1]
            has[mine] = 1
            common = np.add.reduceat(has[word[begin:]], bounds[i + 1 : -1] - begin)
            has[mine] = 0
            alike = 100 * common >= PERCENT * (sizes[i] + sizes[i + 1 :] - common)
            other = np.unique(component[i + 1 :][alike & (component[i + 1 :] != component[i])])
            out.append(np.stack([np.full(len(other), component[i]), other]))
    return np.unique(np.concatenate(out, 1), axis=1)


def crowd_links(groups: DataFrame, rows: DataFrame) -> DataFrame | None:
    """Links (a, b) between the components of rows that the search among neighbours did not compare.

    ``groups`` has id, component and places. Rows that agree in the first ``WHOLE_DEPTH`` places
    of a tree stand together there; up to ``NEIGHBOURS + 1`` of them are all neighbours. Larger crowds
    of more than one component are compared in whole, in blocks of ``CROWD_ROWS``, on full sets.
    None where there is no such crowd.
    """
    begins = groups.select("id", "component", "places").mapInArrow(_begin_rows, "tree int, begin long, id long, component long")
    sizes = begins.groupBy("tree", "begin").agg(
        F.count(F.lit(1)).alias("size"), F.min("component").alias("least"), F.max("component").alias("most")
    )
    crowds = cut_lineage(sizes.where((F.col("size") > NEIGHBOURS + 1) & (F.col("least") != F.col("most"))).select("tree", "begin", "size"))
    if crowds.isEmpty():
        return None
    members = cut_lineage(begins.join(crowds, ["tree", "begin"]))
    sets = sets_of(rows, cut_lineage(members.select("id").distinct()))
    blocks = F.ceil(F.col("size") / CROWD_ROWS).cast("long")
    own = F.pmod(F.xxhash64("id"), F.col("_blocks"))
    cells = members.join(sets, "id").withColumn("_blocks", blocks).withColumn("_own", own).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    )
    cell = ["tree", "begin", "low", "high"]
    placed = cells.select(
        "tree", "begin", F.least("_own", "_other").alias("low"), F.greatest("_own", "_other").alias("high"), "component", "hashes"
    ).repartition(*cell).sortWithinPartitions(*cell)
    return cut_lineage(placed.mapInArrow(_crowd_links, "a long, b long").distinct())


def sets_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, hashes): the full set of one text of each of ``ids``.

    Only texts that the filter lets through are shuffled to meet the exact list of ids.
    """
    bits, blocks = cell_filter(ids.select(F.col("id").alias("_hash")), ids.count())
    likely = in_filter(rows.where("id IS NOT NULL").withColumn("_hash", F.col("id")), bits, blocks).where("_in")
    sets = likely.select("id", "text").join(ids, "id", "left_semi").mapInArrow(_set_rows, "id long, hashes binary")
    return cut_lineage(sets.dropDuplicates(["id"]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id`` and ``kept`` (the smallest id of its component).

    Texts with the same set of shingles meet in one representative first. Null and empty
    texts, and texts of white space alone, have no shingles and are linked with nothing. Rows
    that share an id and a text are kept or dropped together. A row without id keeps a null
    component and is kept. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), filled(text_col).alias("text"))
    signed = cut_lineage(rows.mapInArrow(_signed, "id long, n long, print binary, places binary"))
    named = signed.where("n > 0 AND id IS NOT NULL")
    groups = named.groupBy("print", "n").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("size"), F.min_by("places", "id").alias("places")
    )
    groups = cut_lineage(groups)
    pairs = candidates(groups)
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    ends = cut_lineage(ends)
    sets = sets_of(rows, ends)
    # First each document's best candidate; of the others, those between components found so far.
    best = pairs.groupBy(F.col("a")).agg(F.max_by("b", "shared").alias("b")).unionByName(
        pairs.groupBy("b").agg(F.max_by("a", "shared").alias("a")).select("a", "b")
    )
    best = cut_lineage(best.distinct())
    links = confirmed(best, sets)
    found = cut_lineage(components(links))
    side = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_at"))
    apart = pairs.join(best, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    apart = apart.withColumns({f"{c}_at": F.coalesce(f"{c}_at", c) for c in "ab"}).where("a_at != b_at")
    apart = cut_lineage(apart.select("a", "b", "a_at", "b_at"))
    late = confirmed(apart, sets).join(apart, ["a", "b"]).select(F.col("a_at").alias("a"), F.col("b_at").alias("b"))
    merged = components(late).select(F.col("id").alias("component"), F.col("component").alias("joined"))
    known = found.unionByName(
        merged.select(F.col("component").alias("id"), "component").join(found, "id", "left_anti")
    )
    joined = known.join(merged, "component", "left").select("id", F.coalesce("joined", "component").alias("component"))
    groups = cut_lineage(
        groups.join(joined, "id", "left").withColumn("component", F.coalesce("component", "id"))
    )
    crowded = crowd_links(groups, rows)
    if crowded is not None:
        merged = components(crowded).select(F.col("id").alias("component"), F.col("component").alias("joined"))
        groups = cut_lineage(
            groups.join(merged, "component", "left").withColumn("component", F.coalesce("joined", "component"))
        )
    groups = groups.select("print", "size", "component")
    linked = attach(named.select("id", "n", "print"), groups, "print", "size", signed.count())
    alone = signed.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    return linked.select("id", "n", "component").unionByName(alone).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.col("id").eqNullSafe(F.col("component")).alias("kept"),
    )


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of near-duplicates."""
    return without(docs, near_duplicates(docs, id_col, text_col).where("NOT kept").select(id_col), id_col)
