"""Permutation tests without sorting: a keyed permutation says where each row goes.

Rows are numbered once. A replicate is a key, and a Feistel network turns key and place into
another place of ``[0, n)``; values beyond n walk on until they are inside. So a replicate
costs one pass over the rows, whatever their number, and two replicates share nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from binloom.params import DEFAULTS
from binloom.session import cut_lineage

#: Different labels of one test; their counts travel with the plan.
MAX_LABELS = 100_000
FEISTEL_ROUNDS = 6


def _mixed(values: np.ndarray) -> np.ndarray:
    """Finalising bit mix of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def moved_places(place: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Place of each row under the permutation of ``[0, n)`` that its key names."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = place.astype(np.uint64)
    keys = _mixed(key.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & mask
        for number in range(FEISTEL_ROUNDS):
            salt = np.uint64(number * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (_mixed(right ^ keys[walking] ^ salt) & mask)
        out[walking] = left << np.uint64(half) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def moved(place: str, key: Column, n: int) -> Column:
    """Column form of ``moved_places``."""

    @F.pandas_udf("long")
    def go(at: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(moved_places(at.to_numpy(), keys.to_numpy(), n))

    return go(F.col(place), key.cast("long"))


def numbered(df: DataFrame, order: Sequence[str] = (), name: str = "place") -> tuple[DataFrame, int]:
    """``df`` with numbers 0 to n - 1, and n. Tasks number their rows; counts give the starts.

    With ``order`` the numbers follow these columns, so they are the same however the rows are
    partitioned; without it rows are numbered where they lie.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = pa.array(np.arange(at, at + batch.num_rows))
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), places], names=[*batch.schema.names, "_part", "_at"]
            )

    schema = ", ".join(f"`{c}` {kind}" for c, kind in [*df.dtypes, ("_part", "int"), ("_at", "bigint")])
    rows = cut_lineage(df.mapInArrow(number, schema))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = cut_lineage(counts.select("_part", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    n = starts.agg(F.sum("_n")).head()[0] or 0
    return rows.join(starts.drop("_n"), "_part").select(*df.columns, (F.col("_start") + F.col("_at")).alias(name)), n


def _replicated(rows: DataFrame, reps: int) -> DataFrame:
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))


def permuted_rows(rows: DataFrame, n: int, reps: int, seed: int = DEFAULTS.seed, place: str = "place") -> DataFrame:
    """Every replicate of numbered rows with the rows in another order: ``rep`` and a new ``place``."""
    return _replicated(rows, reps).withColumn(place, moved(place, F.col("rep") + F.lit(seed * 1_000_003), n))


def permuted_labels(rows: DataFrame, n: int, label: str, reps: int, seed: int = DEFAULTS.seed, place: str = "place") -> DataFrame:
    """Every replicate of numbered rows with the labels dealt out anew, each as often as it is.

    Laid end to end by label, the labels fill ``[0, n)``; a row gets the label of the stretch
    in which its moved place lies. No row meets another one.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n")).orderBy(label).limit(MAX_LABELS + 1).collect()
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    names, ends = [r[label] for r in counts], np.cumsum([r["_n"] for r in counts])
    kind = dict(rows.dtypes)[label]

    @F.pandas_udf("int")
    def stretch(at: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, at.to_numpy(), side="right").astype(np.int32))

    table = F.broadcast(rows.sparkSession.createDataFrame(list(enumerate(names)), f"_label int, `{label}` {kind}"))  # at most MAX_LABELS rows
    dealt = permuted_rows(rows.drop(label), n, reps, seed, place).withColumn("_label", stretch(place))
    return dealt.join(table, "_label").drop("_label")


def permuted_features(
    rows: DataFrame, n: int, columns: Sequence[str], reps: int, seed: int = DEFAULTS.seed, place: str = "place"
) -> DataFrame:
    """Every replicate of numbered rows with each column in an order of its own.

    Returns ``rep``, ``place`` and ``columns``; a value travels to its new place by itself, so
    one exchange by (rep, place) puts the rows of all replicates together.
    """
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).cast("double").alias("v")) for k, c in enumerate(columns)])
    long = _replicated(rows.select(place, F.inline(cells)), reps)
    key = (F.col("rep") + F.lit(seed * 1_000_003)) * F.lit(len(columns) + 1) + F.col("k") + 1
    # A cell travels as one number for replicate, place and column, and its value.
    bits = max(1, (len(columns) - 1).bit_length())
    row = F.col("rep").cast("long") * n + moved(place, key, n)
    sent = long.select((F.shiftleft(row, bits) + F.col("k")).alias("_cell"), "v")
    to = F.shiftright("_cell", bits)
    own = F.col("_cell") - F.shiftleft(to, bits)
    values = [F.max(F.when(own == k, F.col("v"))).alias(c) for k, c in enumerate(columns)]
    met = sent.repartition(to).groupBy(to.alias("_row")).agg(*values)
    at = F.col("_row") % n
    return met.select(((F.col("_row") - at) / n).cast("int").alias("rep"), at.alias(place), *columns)


def permutation_statistic(
    df: DataFrame,
    columns: Sequence[str],
    statistic: Callable[[DataFrame], DataFrame],
    cluster: Callable[[DataFrame], DataFrame],
    permute: str = "features",
    reps: int = 200,
    alternative: str = "greater",
    seed: int = DEFAULTS.seed,
) -> DataFrame:
    """Observed statistic and its permutation p-value ``(b + 1) / (reps + 1)``.

    ``cluster`` takes rows with ``rep``, ``place`` and ``columns`` of many replicates at once
    and returns them with ``label``; ``statistic`` takes those and returns (rep, stat). The
    observed rows are replicate 0. ``permute`` says what is permuted: the values of each
    feature, the order of whole rows, or the labels of the observed clusters, which are not
    clustered again. ``two.sided`` compares distances from the mean of the replicates.
    """
    if permute not in ("features", "rows", "labels") or alternative not in ("greater", "two.sided"):
        raise ValueError("permute is features, rows or labels; alternative is greater or two.sided")
    rows, n = numbered(df.select(*columns))
    rows = cut_lineage(rows)
    observed = cut_lineage(cluster(rows.withColumn("rep", F.lit(0))))
    if permute == "labels":
        null = permuted_labels(observed.drop("rep"), n, "label", reps, seed)
    else:
        made = permuted_features(rows, n, columns, reps, seed) if permute == "features" else permuted_rows(rows, n, reps, seed)
        null = cluster(made)
    return compared(cut_lineage(statistic(observed).unionByName(statistic(null)).select("rep", "stat")), reps, alternative)


def compared(stats: DataFrame, reps: int, alternative: str = "greater") -> DataFrame:
    """``observed`` and ``p`` from (rep, stat), with the observed statistic as replicate 0."""
    seen = stats.filter("rep = 0").select("stat").scalar()
    null = stats.filter("rep > 0")
    if alternative == "greater":
        beyond = F.col("stat") >= seen
    else:
        mean = null.agg(F.avg("stat")).scalar()
        beyond = F.abs(F.col("stat") - mean) >= F.abs(seen - mean)
    return null.agg(F.max(seen).alias("observed"), ((F.count_if(beyond) + 1) / F.lit(reps + 1.0)).alias("p"))
