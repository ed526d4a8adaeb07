"""Sharding by a hierarchical weighted hash tree.

Shards hang in racks, racks in regions; a node weighs what its shards weigh. A row descends
from the root: at each level every child draws ``-ln(u) / weight``, with ``u`` from a digest
of row id, node name and salt, and the least draw wins, so a child gets its share by weight.
A draw depends on its own child alone. When weights change, rows leave lighter children and
enter heavier ones; between children of equal weights none moves. So movement stays in the
subtrees whose weights change, and a shard that opens a region of its own takes rows only
into itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.llm.common import filled
from binloom.session import cut_lineage

#: Hexadecimal digits of the digest that make a draw: 52 bits, exact as a double.
DRAW_DIGITS = 13
#: Shards of a tree: its nodes travel inside the plan.
MAX_SHARDS = 4096


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree: its number, where it hangs, and its weight."""

    shard: int
    region: str
    rack: str
    weight: float = 1.0


Tree = tuple[Shard, ...]


def tree(shards: int, regions: int = 2, racks: int = 2, per_rack: int = 2) -> Tree:
    """A tree for so many shards: a full one, and a region for each shard beyond it.

    For any two counts from the full tree on, the larger one's rows move only into its own
    shards. A count below the full tree raises ValueError.
    """
    full = regions * racks * per_rack
    if shards < full:
        raise ValueError(f"a tree of {regions} x {racks} x {per_rack} has at least {full} shards")
    place = lambda k: (k // (racks * per_rack), k // per_rack % racks) if k < full else (regions + k - full, 0)
    return tuple(Shard(k, f"r{region}", f"r{region}.k{rack}") for k in range(shards) for region, rack in [place(k)])


def _checked(nodes: Tree) -> Tree:
    if not 0 < len(nodes) <= MAX_SHARDS:
        raise ValueError(f"a tree has 1 to {MAX_SHARDS} shards")
    if len({s.shard for s in nodes}) < len(nodes):
        raise ValueError("shard numbers must differ")
    if any(not (isfinite(s.weight) and s.weight >= 0) for s in nodes) or not any(s.weight for s in nodes):
        raise ValueError("weights must be finite, not negative and not all zero")
    if len({s.rack for s in nodes}) < len({(s.region, s.rack) for s in nodes}):
        raise ValueError("a rack hangs in one region")
    return nodes


def levels(nodes: Tree) -> list[dict[str, dict[str, float]]]:
    """Per level the children of each parent with their weights; nodes without weight are left out."""
    out: list[dict] = [defaultdict(lambda: defaultdict(float)) for _ in range(3)]
    for s in _checked(nodes):
        if s.weight:
            for level, parent, child in ((0, "", s.region), (1, s.region, s.rack), (2, s.rack, str(s.shard))):
                out[level][parent][child] += s.weight
    return out


def _draw(key: Column, node: Column, weight: Column, salt: str) -> Column:
    """An exponential time at the child's rate."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(salt), node, key)), 1, DRAW_DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DRAW_DIGITS)
    return -F.ln(u) / weight


def _descend(key: Column, parent: Column, children: dict[str, dict[str, float]], level: int, salt: str) -> Column:
    """The child of ``parent`` with the least draw; draws of equal size go by name."""
    below = [
        (p, F.array(*(F.struct(F.lit(c).alias("node"), F.lit(w).alias("weight")) for c, w in sorted(kids.items()))))
        for p, kids in sorted(children.items())
    ]
    if level == 0:
        candidates = below[0][1]
    else:
        candidates = F.element_at(F.create_map(*(x for p, kids in below for x in (F.lit(p), kids))), parent)
    drawn = F.transform(
        candidates,
        lambda c: F.struct(_draw(key, F.concat(F.lit(f"{level}:"), c["node"]), c["weight"], salt).alias("draw"), c["node"].alias("node")),
    )
    return F.array_min(drawn)["node"]


def with_shard(rows: DataFrame, key: Column, nodes: Tree, name: str, salt: str = "tree") -> DataFrame:
    """``rows`` with the shard of ``key`` as the column ``name``, replacing one of that name.

    A projection: no exchange, and a row's shard depends on its key and the tree only. A null
    key draws as the empty text.
    """
    steps = levels(nodes)
    key = F.coalesce(key.cast("string"), F.lit(""))
    taken = {c.lower() for c in rows.columns}
    region, rack = (next(c for c in (f"_{level}{'_' * k}" for k in range(len(taken) + 1)) if c not in taken) for level in ("region", "rack"))
    rows = rows.withColumn(region, _descend(key, F.lit(""), steps[0], 0, salt))
    rows = rows.withColumn(rack, _descend(key, F.col(region), steps[1], 1, salt))
    return rows.withColumn(name, _descend(key, F.col(rack), steps[2], 2, salt).cast("int")).drop(region, rack)


def slots(rows: DataFrame, shard: str = "shard", order: str = "id") -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps, ascending in ``order``: ``slot``.

    Rows are dealt out by ranges of (shard, order), so a large shard lies in many partitions.
    A task numbers its own rows; the counts of the partitions give each its start. Equal
    values of ``order`` may stand in any order among themselves, and may lie in several
    partitions. The numbered rows are written once, so a repeated task cannot renumber them.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            place = np.zeros(batch.num_rows, np.int64)
            values = batch.column(batch.schema.get_field_index(shard)).to_numpy(zero_copy_only=False)
            for value in np.unique(values):
                own = np.flatnonzero(values == value)
                place[own] = seen[value] + np.arange(len(own))
                seen[value] += len(own)
            parts = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(place)], names=[*batch.schema.names, "part", "place"])

    schema = ", ".join(f"{name} {kind}" for name, kind in [*rows.dtypes, ("part", "int"), ("place", "bigint")])
    dealt = rows.withColumn("source", F.spark_partition_id()).repartitionByRange(shard, order, "source").drop("source")
    placed = cut_lineage(dealt.sortWithinPartitions(shard, order).mapInArrow(number, schema))
    before = Window.partitionBy(shard).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition and shard
    counts = placed.groupBy(shard, "part").agg(F.count("*").alias("n"))
    starts = cut_lineage(counts.select(shard, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    return placed.join(starts, [shard, "part"]).withColumn("slot", F.col("start") + F.col("place")).drop("part", "place", "start")


def sharded(
    docs: DataFrame, nodes: Tree, grown: Tree | None = None, salt: str = "tree", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``law``,
    ``shard``, ``slot`` (ascending in id), and ``grown_shard``, the shard in a second tree.

    The law is ``key``: the id and the tree decide. Rows of one id, all rows without id among
    them, therefore share a shard; null texts count as empty. Texts are read once and never
    shuffled; other columns are not read. An empty table gives no rows.
    """
    text = filled(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = with_shard(rows, F.col("id"), nodes, "shard", salt)
    rows = rows.withColumn("grown_shard", F.lit(None).cast("int")) if grown is None else with_shard(rows, F.col("id"), grown, "grown_shard", salt)
    return slots(rows).select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, nodes: Tree, path: str, salt: str = "tree", id_col: str = "doc_id") -> None:
    """Writes all rows and columns of ``docs`` as Parquet, a folder ``shard=k`` per shard.

    Each task writes its own file into the folders that its rows need, so no shard is gathered
    anywhere. A column of the caller named ``shard`` is replaced.
    """
    with_shard(docs, F.col(id_col), nodes, "shard", salt).write.partitionBy("shard").parquet(path)
