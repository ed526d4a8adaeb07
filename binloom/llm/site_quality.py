"""Quality by hierarchical empirical Bayes: a document's own evidence over its site's record.

A classifier on features of the whole text gives each document's own chance. Hosts and the
paths below them have posteriors from the chances of all their documents: a path shrinks
toward its host and a host toward the global prior, the more the fewer documents it has. How
strongly is estimated from the data itself, from the spread between sites against the spread
within. A document's score combines its evidence with the posterior of its path, from which
the document's own share is taken out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm.common import attach, filled, mixed, text_bytes, text_slices
from binloom.llm.hashing import LETTERS, NOT_SPACE, RollingHash, spans, text_of
from binloom.session import cut_lineage

#: Rows of the labelled sample, on average, at any input size.
LABELLED_ROWS = 5000
FOLDS = 5
BINS = 8


def _some(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_GROUPS = (
    _some(bytes(range(65, 91))),
    _some(b"0123456789"),
    _some(b"!?"),
    _some(b".,"),
    _some(b"#$%&*+=<>@^_{|}~[]\\/"),
    _some(bytes(range(128, 256))),
)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x features: sizes, shares of characters, and repetition of words and lines."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    begin, end = spans(data, offsets, NOT_SPACE)
    owner = text_of(begin, offsets)
    count = lambda at, w=None: np.bincount(at, w, n).astype(float)
    words, long = count(owner), (end - begin).astype(float)
    rolling = RollingHash(data)
    hashes = rolling(begin, end)
    pairs = hashes + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first, many = np.unique(mixed(pairs), return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, owner[first], many)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])])
    line_begin, line_end = spans(data, offsets, ~_some(b"\n"))
    line_owner = text_of(line_begin, offsets)
    marks = rolling(line_begin, line_end) + line_owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, line_first = np.unique(mixed(marks), return_index=True)
    lines = count(line_owner)
    letters = count(text_of(np.flatnonzero(LETTERS[data]), offsets))
    columns = [
        np.log1p(words),
        _ratio(count(owner, long), words),
        np.sqrt(np.maximum(0, _ratio(count(owner, long**2), words) - _ratio(count(owner, long), words) ** 2)),
        _ratio(count(owner, long <= 2), words),
        _ratio(count(owner, long >= 16), words),
        _ratio(count(owner[first]), words),
        _ratio(most, words),
        _ratio(count(owner, again), words),
        np.log1p(lines),
        _ratio(count(line_owner[line_first]), lines),
        _ratio(words, lines),
        _ratio(letters, size),
    ]
    for member in _GROUPS:
        columns.append(_ratio(count(text_of(np.flatnonzero(member[data]), offsets)), size))
    return np.stack(columns, 1)


@dataclass
class QualityModel:
    edges: np.ndarray  # features x inner bin edges
    weights: np.ndarray
    bias: float

    def design(self, x: np.ndarray) -> np.ndarray:
        """1 where a feature reaches an edge."""
        return (x[:, :, None] >= self.edges[None]).reshape(len(x), -1).astype(float)

    def chances(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.design(features(data, offsets)) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: pa.Array, labels: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> QualityModel:
    """Logistic regression on steps of the features, by Newton steps."""
    parts = [
        features(*text_bytes(b.column(0))) for b in text_slices([pa.RecordBatch.from_arrays([texts], names=["text"])])
    ]
    if not parts:
        return QualityModel(np.zeros((0, BINS - 1)), np.zeros(0), 0.0)
    x = np.concatenate(parts)
    model = QualityModel(np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T, np.zeros(x.shape[1] * (BINS - 1)), 0.0)
    rows = np.column_stack([model.design(x), np.ones(len(x))])
    pull = np.full(rows.shape[1], ridge)
    pull[-1] = 1e-3
    beta = np.zeros(rows.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        curve = rows.T @ (rows * (p * (1 - p))[:, None]) + np.diag(pull)
        step = np.linalg.solve(curve, rows.T @ (labels - p) - pull * beta)
        beta = beta + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
    model.weights, model.bias = beta[:-1], float(beta[-1])
    return model


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled_rows: int = LABELLED_ROWS
) -> QualityModel:
    """Fit on a sample of labelled rows, drawn by a hash of the id; every fifth id is held out."""
    marks = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").cast("double").alias("quality"))
    marks = marks.where(F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS != 0)
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    few = marks.where(chance < labelled_rows / max(1, marks.count()))
    rows = docs.select(F.col(id_col).alias("id"), filled(text_col).alias("text")).join(few, "id")
    table = rows.orderBy(F.xxhash64("id"), "id").select("text", "quality").toArrow()
    return fit(table.column("text").combine_chunks(), table.column("quality").to_numpy())


def _strength(sites: DataFrame, parent: str) -> float:
    """Documents that a site's parent counts as, by the method of moments.

    ``sites`` has the sums of a site: n, total, squares, and its parent's mean.
    """
    row = sites.select(
        F.sum(F.col("squares") - F.col("total") ** 2 / F.col("n")).alias("within"),
        F.sum(F.col("n") - 1).alias("freedom"),
        F.sum(F.col("n") * (F.col("total") / F.col("n") - F.col(parent)) ** 2).alias("between"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("sites"),
    ).first()
    if not row["sites"]:
        return 1.0
    within = max(1e-6, row["within"] / max(1, row["freedom"]))
    between = (row["between"] - (row["sites"] - 1) * within) / row["n"]
    return float(min(1e6, within / max(between, within * 1e-6)))


def _logit(p):
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def site_quality(
    docs: DataFrame,
    model: QualityModel,
    host_col: str = "source",
    path_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, ``own`` chance, ``host`` and ``path`` posterior, ``score`` and ``kept`` (score >= 0.5).

    A null host or path is a site of its own. Null texts are empty and get the chance of an
    empty text. Null and repeated ids are returned as they are, a row each; an empty table
    gives no rows; other columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            own = shipped.value.chances(*text_bytes(batch.column(3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own)], names=["id", "host_key", "path_key", "own"])

    kind = dict(docs.dtypes)[id_col]
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), name(host_col).alias("host_key"), name(path_col).alias("path_key"), filled(text_col).alias("text")
    )
    own = cut_lineage(rows.mapInArrow(scored, f"id {kind}, host_key string, path_key string, own double"))
    sums = [F.count(F.lit(1)).alias("n"), F.sum("own").alias("total"), F.sum(F.col("own") ** 2).alias("squares")]
    paths = cut_lineage(own.groupBy("host_key", "path_key").agg(*sums))
    hosts = paths.groupBy("host_key").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))
    whole = hosts.agg(F.sum("n"), F.sum("total")).first()
    count, prior = whole[0] or 0, (whole[1] or 0.0) / max(1, whole[0] or 0)
    hosts = hosts.withColumn("prior", F.lit(prior))
    to_prior = _strength(hosts, "prior")
    hosts = cut_lineage(
        hosts.select("host_key", "n", ((F.col("total") + to_prior * F.lit(prior)) / (F.col("n") + to_prior)).alias("host"))
    )
    paths = paths.join(hosts.select("host_key", "host"), "host_key")
    to_host = _strength(paths, "host")
    sites = cut_lineage(
        paths.select(F.xxhash64("host_key", "path_key").alias("site"), "n", "total", "host", "host_key", "path_key")
    )
    joined = attach(own.withColumn("site", F.xxhash64("host_key", "path_key")), sites.drop("host_key", "path_key"), "site", "n", count)
    others = (F.col("total") - F.col("own") + to_host * F.col("host")) / (F.col("n") - 1 + to_host)
    odds = _logit(F.col("own")) + _logit(others) - _logit(F.lit(prior))
    return joined.select(
        F.col("id").alias(id_col),
        "own",
        "host",
        others.alias("path"),
        (1 / (1 + F.exp(-odds))).alias("score"),
        (odds >= 0).alias("kept"),
    )
