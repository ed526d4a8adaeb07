"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters. Words, word beginnings and writing patterns whose share differs clearly between
   toxic and other rows of a bounded labelled sample are dealt into lexicon voters and
   pattern voters, each for one class. A voter votes when one of its entries occurs.
2. Label model. Votes are modelled per class by their means (the voters' accuracies) and one
   shared covariance (their correlations); expectation maximisation over labelled and
   unlabelled rows gives each row a posterior label. Correlated voters share one weight.
3. Classifier. A logistic regression on the entries themselves is trained on the posteriors
   and scores every whole text.

Rows held out by id take no part in 1 to 3. Ids, languages and sources are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binloom.llm.common import filled, mixed, text_bytes, text_slices
from binloom.llm.hashing import BYTE_VALUES, LETTERS, RollingHash, spans, text_of

#: Rows of the labelled and of the unlabelled sample, on average, at any input size.
LABELLED_ROWS = 5000
FREE_ROWS = 2000
FOLDS = 5
STEMS = (4, 5, 6)
VOTERS = 12  # lexicon voters per kind and class
#: Entries need this many standard errors between the classes' shares.
CLEAR = 7.0
#: and this logarithm of the shares' ratio.
STRONG = 2.5
SHOUT, MARKS = np.uint64(1), np.uint64(2)


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def entries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, entry hash) of all words, word beginnings and patterns; not distinct.

    A word is a run of letters, digits and bytes beyond ASCII, A-Z as a-z. Patterns: a word
    of 4 or more capitals, and two exclamation or question marks in a row.
    """
    begin, end = spans(data, offsets, LETTERS)
    texts, rolling = text_of(begin, offsets), RollingHash(data, BYTE_VALUES)
    owners, found = [texts], [rolling(begin, end)]
    for n in STEMS:
        long = end - begin > n
        owners.append(texts[long])
        found.append(rolling(begin[long], begin[long] + n) + np.uint64(n))
    capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    shouted = (end - begin >= 4) & (capitals[end] - capitals[begin] == end - begin)
    loud = (data == 33) | (data == 63)
    twice = np.flatnonzero(loud[:-1] & loud[1:]) if len(data) else np.zeros(0, np.int64)
    owners += [texts[shouted], text_of(twice, offsets)]
    found += [np.full(shouted.sum(), SHOUT), np.full(len(twice), MARKS)]
    return np.concatenate(owners), np.concatenate(found)


@dataclass
class ToxicityModel:
    entries: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray  # of the voters: share of votes by class
    correlations: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        owner, found = entries(data, offsets)
        owner, at = self.known(owner, found)
        pairs = np.unique(owner * len(self.entries) + at) if len(self.entries) else np.zeros(0, np.int64)
        total = np.bincount(
            pairs // max(1, len(self.entries)), self.weights[pairs % max(1, len(self.entries))], len(offsets) - 1
        )
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))

    def known(self, owner: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that are entries of the model, as positions in ``entries``."""
        return _known(self.entries, owner, found)


def _known(known: np.ndarray, owner: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return owner[:0], np.zeros(0, np.int64)
    hint = np.zeros(1 << 20, bool)
    hint[known >> np.uint64(44)] = True
    likely = hint[found >> np.uint64(44)]
    owner, found = owner[likely], found[likely]
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    same = known[at] == found
    return owner[same], at[same]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior label of each row, class means of the votes, and their correlations.

    ``votes`` is rows x voters of 0/1; ``labels`` is 0, 1 or NaN. Labelled rows begin the
    iteration and keep their label, the vote of a voter that does not err; the posteriors of
    the others come from their votes.
    """
    known = ~np.isnan(labels)
    q = np.where(known, labels, 0.0)
    weight = known.astype(float)
    for _ in range(rounds):
        on = [(weight * (1 - q))[:, None], (weight * q)[:, None]]
        share = np.array([w.sum() + 1 for w in on])
        means = np.array([((votes * w).sum(0) + 0.01) / (w.sum() + 1) for w in on])
        spread = sum(((votes - m) * w).T @ (votes - m) for m, w in zip(means, on)) / share.sum()
        spread += 0.02 * np.eye(votes.shape[1])
        slope = np.linalg.solve(spread, means[1] - means[0])
        odds = (votes - means.mean(0)) @ slope + np.log(share[1] / share[0])
        fresh = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        before, q = q, np.where(known, labels, fresh)
        weight = np.ones(len(q))
        if np.abs(q - before).max(initial=0) < 1e-6:
            break
    scale = np.sqrt(np.diag(spread))
    return q, means, spread / scale / scale[:, None]


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.05, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias for soft targets by Newton steps; both classes weigh alike."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)]).astype(np.float64)
    share = np.clip(target.mean(), 1e-3, 1 - 1e-3)
    weight = target / (2 * share) + (1 - target) / (2 * (1 - share))
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-3
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        curve = x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(pull)
        step = np.linalg.solve(curve, x.T @ (weight * (target - p)) - pull * beta)
        beta = beta + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
    return beta[:-1], float(beta[-1])


def _entry_counts(texts: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All entries of the texts, and in how many texts of each group they occur."""
    names, counts = np.zeros(0, np.uint64), np.zeros((0, len(groups)))
    done = 0
    for batch in text_slices([pa.RecordBatch.from_arrays([texts], names=["text"])]):
        owner, found = entries(*text_bytes(batch.column(0)))
        _, first = np.unique(mixed(found + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
        owner, (fresh, at) = owner[first] + done, np.unique(found[first], return_inverse=True)
        done += batch.num_rows
        hits = np.stack([np.bincount(at, g[owner].astype(float), len(fresh)) for g in groups], 1)
        merged, at = np.unique(np.concatenate([names, fresh]), return_inverse=True)
        both = np.concatenate([counts, hits])
        counts = np.stack([np.bincount(at, both[:, k], len(merged)) for k in range(len(groups))], 1)
        names = merged
    return names, counts


def fit(texts: pa.Array, labels: np.ndarray) -> ToxicityModel:
    """Voters, label model and classifier from sampled texts; label NaN: unlabelled."""
    known = ~np.isnan(labels)
    positive, negative = known & (labels == 1), known & (labels == 0)
    empty = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -2.0, np.zeros((2, 0)), np.zeros((0, 0)))
    if not positive.any() or not negative.any():
        return empty
    names, hits = _entry_counts(texts, np.stack([negative, positive]))
    share = (hits + 0.5) / (np.array([negative.sum(), positive.sum()]) + 1)
    pooled = (hits.sum(1) + 0.5) / (known.sum() + 1)
    z = (share[:, 1] - share[:, 0]) / np.sqrt(pooled * (1 - pooled + 1e-9) * (1 / negative.sum() + 1 / positive.sum()))
    chosen = np.flatnonzero((np.abs(z) >= CLEAR) & (np.abs(np.log(share[:, 1] / share[:, 0])) >= STRONG))
    if not len(chosen):
        return empty
    names, z = names[chosen], z[chosen]
    x, done = np.zeros((len(labels), len(names)), np.float32), 0
    for batch in text_slices([pa.RecordBatch.from_arrays([texts], names=["text"])]):
        owner, at = _known(names, *entries(*text_bytes(batch.column(0))))
        x[owner + done, at] = 1
        done += batch.num_rows
    # deal the entries into voters, strongest first, so that each voter has strong ones
    voter = np.zeros(len(names), np.int64)
    for sign in (1, -1):
        side = np.flatnonzero(np.sign(z) == sign)
        side = side[np.argsort(-np.abs(z[side]), kind="stable")]
        voter[side] = np.arange(len(side)) % VOTERS + (0 if sign > 0 else VOTERS)
    votes = np.stack([x[:, voter == v].max(1, initial=0) for v in range(2 * VOTERS)], 1).astype(float)
    posterior, means, correlations = label_model(votes, labels)
    weights, bias = logistic(x, posterior)
    return ToxicityModel(names, weights, bias, means, correlations)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    labelled_rows: int = LABELLED_ROWS,
    free_rows: int = FREE_ROWS,
) -> ToxicityModel:
    """Fit on a sample of rows that are not held out, drawn by a hash of the id."""
    rows = docs.where(~F.coalesce(held_out(id_col), F.lit(True))).select(F.col(id_col).alias("id"), filled(text_col).alias("text"))
    marks = labels.where("toxic IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("double").alias("toxic"))
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    few = marks.where(chance < labelled_rows / max(1, marks.count()))
    free = rows.where(chance > 1 - free_rows / max(1, docs.count())).join(marks, "id", "left_anti")
    sample = rows.join(few, "id").unionByName(free.withColumn("toxic", F.lit(None).cast("double")))
    table = sample.orderBy(F.xxhash64("id"), "id").select("text", "toxic").toArrow()
    return fit(table.column("text").combine_chunks(), table.column("toxic").to_numpy())


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for every row.

    Null and empty texts are scored as a text without entries; repeated rows each get a
    row; a null id counts as held out; an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's entries

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            values = shipped.value.scores(*text_bytes(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values), pa.array((values >= 0.5).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"],
            )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col), F.coalesce(held_out(id_col), F.lit(True)).alias("held_out"), filled(text_col).alias("text"))
    return rows.mapInArrow(scored, f"{id_col} {kind}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col))
            yield batch.filter(pa.array(shipped.value.scores(*text_bytes(texts)) < 0.5))

    return docs.mapInArrow(clean, docs.schema)
