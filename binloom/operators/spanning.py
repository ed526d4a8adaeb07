"""Minimum spanning forests, and principal trees through rows by soft assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.operators.sampling import draw
from binloom.params import DEFAULTS
from binloom.session import cut_lineage

#: Centres of a tree: their distances and the equations of their places fit the driver.
MAX_CENTRES = 2048


def spanning_forest(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) of the minimum spanning tree of every connected part.

    In each round every part takes its least edge to another part, so the parts at least
    halve. Edges of equal weight go by their ends, which makes the choice unique and free of
    cycles. Loops and null weights are left out; of parallel edges the least counts.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    plain = edges.where("src <> dst AND weight IS NOT NULL").select(low.alias("src"), high.alias("dst"), "weight")
    rest = cut_lineage(plain.groupBy("src", "dst").agg(F.min("weight").alias("weight")).select(
        "src", "dst", "weight", F.col("src").alias("_a"), F.col("dst").alias("_b")
    ))
    chosen = [rest.select("src", "dst", "weight").limit(0)]
    while not rest.isEmpty():
        edge = F.struct("weight", "src", "dst")
        ends = rest.select(F.col("_a").alias("part"), F.col("_b").alias("to"), edge.alias("e")).unionByName(
            rest.select(F.col("_b").alias("part"), F.col("_a").alias("to"), edge.alias("e"))
        )
        least = cut_lineage(ends.groupBy("part").agg(F.min(F.struct("e", "to")).alias("_m")).select("part", "_m.to", "_m.e"))
        chosen.append(least.select("e.src", "e.dst", "e.weight").distinct())
        other = least.select(F.col("part").alias("to"), F.col("to").alias("_back"))
        # Two parts that chose each other share their edge; the lesser one becomes the root.
        parent = cut_lineage(least.join(other, "to").select(
            "part", F.when((F.col("_back") == F.col("part")) & (F.col("part") < F.col("to")), F.col("part")).otherwise(F.col("to")).alias("up")
        ))
        while True:
            above = parent.select(F.col("part").alias("up"), F.col("up").alias("_next"))
            doubled = cut_lineage(parent.join(above, "up").select("part", F.col("_next").alias("up"), (F.col("_next") != F.col("up")).alias("moved")))
            parent = doubled.select("part", "up")
            if doubled.where("moved").isEmpty():
                break
        named = lambda side: parent.select(F.col("part").alias(side), F.col("up").alias(f"{side}_"))  # noqa: B023, E731
        rest = cut_lineage(
            rest.join(named("_a"), "_a").join(named("_b"), "_b").where("_a_ <> _b_")
            .select("src", "dst", "weight", F.col("_a_").alias("_a"), F.col("_b_").alias("_b"))
        )
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return out


def _soft_sums(points: DataFrame, centres: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Per centre the weight of its rows and their weighted sum; and the mean squared error.

    A row's weights over the centres fall with its squared distances by ``sigma`` and add up
    to 1. A task returns one row per centre, whatever it reads.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, total, error = np.zeros(len(centres)), np.zeros(centres.shape), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for begin in range(0, len(rows), 1024):
                x = rows[begin : begin + 1024]
                square = np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2.0 * x @ centres.T, 0.0)
                soft = np.exp(-(square - square.min(1, keepdims=True)) / sigma)
                soft /= soft.sum(1, keepdims=True)
                weight += soft.sum(0)
                total += soft.T @ x
                error += float((soft * square).sum())
        sums = pa.array(total.tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(weight), sums, pa.array(np.full(len(centres), error / len(centres)))],
            names=["k", "w", "s", "e"],
        )

    parts = points.select("vec").mapInArrow(work, "k int, w double, s array<double>, e double")
    each = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(centres.shape[1])]
    rows = parts.groupBy("k").agg(F.sum("w").alias("w"), F.sum("e").alias("e"), *each).orderBy("k").collect()  # a row per centre
    table = np.array([list(r)[1:] for r in rows])
    return table[:, 0], table[:, 2:], float(table[:, 1].sum() / max(table[:, 0].sum(), 1e-300))


def principal_tree(
    points: DataFrame,
    centres: int = 64,
    stiffness: float = 1.0,
    sigma: float | None = None,
    rounds: int = 5,
    stop: float = 1e-3,
    seed: int = DEFAULTS.seed,
) -> tuple[DataFrame, DataFrame]:
    """A tree through the rows: edges (src, dst, weight) and nodes (node, vec).

    ``points`` has (id, vec). Centres begin at rows drawn by hash. Each round takes the minimum
    spanning tree of the centres (squared distances), assigns every row softly to all
    centres, and moves the centres to where assigned rows and tree neighbours, weighted by
    ``stiffness``, pull them: one pass over the rows and one system of equations in the
    centres. Ends when the mean squared error falls by less than ``stop`` of itself.
    ``sigma`` is the variance of the assignment, by default a tenth of the mean squared
    distance of a row to its centre at the start. Weights of the returned edges are distances.
    """
    if not 1 < centres <= MAX_CENTRES:
        raise ValueError(f"a tree has 2 to {MAX_CENTRES} centres")
    spark = points.sparkSession
    points = cut_lineage(points.select("id", F.col("vec").cast("array<double>").alias("vec")))
    drawn = points.orderBy(draw(["id"], seed), "id").limit(centres).collect()  # at most MAX_CENTRES rows
    place = np.unique(np.array([r["vec"] for r in drawn], float), axis=0)
    if len(place) < 2:
        raise ValueError("a tree needs two different rows")
    if sigma is None:
        sigma = max(_soft_sums(points, place, 1e-9)[2] / 10.0, 1e-12)
    before = float("inf")
    for _ in range(rounds):
        tree = np.array([(r["src"], r["dst"]) for r in _tree(spark, place).collect()], int).reshape(-1, 2)  # one edge less than centres
        laplacian = np.zeros((len(place), len(place)))
        for a, b in tree:
            laplacian[[a, b], [a, b]] += 1.0
            laplacian[[a, b], [b, a]] -= 1.0
        weight, total, error = _soft_sums(points, place, sigma)
        pull = stiffness * weight.sum() / len(place)
        place = np.linalg.solve(pull * laplacian + np.diag(np.maximum(weight, 1e-9)), total + np.maximum(1e-9 - weight, 0.0)[:, None] * place)
        if before - error < stop * error:
            break
        before = error
    edges = _tree(spark, place).select("src", "dst", F.sqrt("weight").alias("weight"))
    nodes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(place)], "node int, vec array<double>")
    return cut_lineage(edges), nodes


def _tree(spark, place: np.ndarray) -> DataFrame:
    """Minimum spanning tree of the centres by squared distances."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column(0).to_pylist():
                square = ((place[a + 1 :] - place[a]) ** 2).sum(1)
                others = np.arange(a + 1, len(place), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), a, np.int32)), pa.array(others), pa.array(square)], names=["src", "dst", "weight"])

    return spanning_forest(spark.range(len(place) - 1).mapInArrow(pairs, "src int, dst int, weight double"))
