"""Operator 9, quality by ordinal cumulative-link regression.

P(grade <= k) = sigmoid(t_k - w . x) with one weight vector for all grades and ascending
thresholds t_k, kept in order by learning their differences as exponentials.  All columns that at
least RARE rows of the sample hold are learned, each valued 1 / sqrt(known columns of the text).
Expected grade and tail probability P(grade >= chosen) follow.  Features are those of hashed_text.

Only rows whose crc32 of doc_id leaves a remainder by 5 are learned from, at most LABELLED.

Defined results: null or empty text: decided by the thresholds alone.  Null doc_id: scored, held
out.  Repeated rows are scored alike; of several ratings of one doc_id the highest counts.  Fewer than two grades: every expected grade is that grade (0 without labels), tail 1.0 if
it reaches the chosen grade, else 0.0.  Empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashed_text import Adam, Matrix, feature_rows, margins, restrict, sample, sigmoid

LABELLED = 6000  # most rows to fit on
EPOCHS, CHUNKS, RATE, DECAY, RARE = 12, 8, 0.2, 1e-4, 4
KEEP_TAIL = 0.5


@dataclass
class Model:
    grades: list[int]
    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def cuts_of(free: np.ndarray) -> np.ndarray:
    """Ascending thresholds of the first one and the logarithms of the gaps."""
    return free[0] + np.append(0, np.cumsum(np.exp(free[1:])))


def link_loss(x: Matrix, k: np.ndarray, w: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of grades k (from 0), and its gradients by weights and by free."""
    cuts, eta, n = cuts_of(free), x.dot(w), max(1, len(k))
    edge = np.concatenate(([-np.inf], cuts, [np.inf]))
    hi, lo = sigmoid(edge[k + 1] - eta), sigmoid(edge[k] - eta)
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi) / p / n * (k < len(cuts)), lo * (1 - lo) / p / n * (k > 0)
    by_cut = np.bincount(np.maximum(k - 1, 0), dlo, len(cuts) + 1)[:-1] - np.bincount(k, dhi, len(cuts) + 1)[:-1]
    after = by_cut[::-1].cumsum()[::-1]  # a gap moves all later thresholds
    return float(-np.log(p).mean()), x.back(dhi - dlo), np.append(after[0], after[1:] * np.exp(free[1:]))


def fit(rows: list[np.ndarray], ratings: list[int], seed: int = 9) -> Model:
    grades = sorted(set(ratings))
    n_cuts = len(grades) - 1
    if n_cuts < 1:
        return Model(grades or [0], np.zeros(0, np.int32), np.zeros(0), np.zeros(0))
    columns, held = np.unique(np.concatenate(rows), return_counts=True)
    known = columns[held >= RARE]
    x, y = Matrix(restrict(rows, known), len(known), True), np.searchsorted(grades, ratings)
    share = np.clip([(y <= k).mean() for k in range(n_cuts)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    free = np.append(start[0], np.log(np.maximum(np.diff(start), 1e-3)))
    w = np.zeros(len(known))
    adam, rng = Adam(len(w) + n_cuts, RATE), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for chosen in np.array_split(rng.permutation(len(y)), CHUNKS):
            _, d_w, d_free = link_loss(x.part(chosen), y[chosen], w, free)
            move = adam.step(np.append(d_w + DECAY * w, d_free))
            w += move[: len(w)]
            free += move[len(w) :]
    return Model(grades, known, w, cuts_of(free))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", labelled: int = LABELLED) -> Model:
    common.small_batches(docs.sparkSession)
    own = labels.where(~common.held_out_flag(F.col("doc_id")) & F.col(column).isNotNull())
    own = own.groupBy(F.col("doc_id").alias("id")).agg(F.max(column).cast("int").alias("label"))
    chosen = own.join(F.broadcast(sample(own, labelled, "id")), "id")  # at most labelled rows, so it can be broadcast
    rows = feature_rows(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")), "label").toPandas()
    return fit([np.frombuffer(f, np.int32) for f in rows["features"]], rows["label"].tolist())


def score(docs: DataFrame, model: Model, least: int | None = None) -> DataFrame:
    """(doc_id, held_out, expected_grade, tail_probability, kept); least: the grade of the tail,
    by default the highest."""
    common.small_batches(docs.sparkSession)
    least = model.grades[-1] if least is None else least
    found = margins(docs, model.vocabulary, model.weights, True, "doc_id")
    above = [1 / (1 + F.exp(F.lit(float(t)) - F.col("margin"))) for t in model.thresholds]  # P(grade > k)
    expected = F.lit(float(model.grades[0]))
    for gap, p in zip(np.diff(model.grades), above):
        expected = expected + float(gap) * p
    k = next((i for i, g in enumerate(model.grades) if g >= least), len(model.grades))
    tail = F.lit(0.0) if k == len(model.grades) else F.lit(1.0) if k == 0 else above[k - 1]
    scored = found.select("doc_id", common.held_out_flag(F.col("doc_id")).alias("held_out"), expected.alias("expected_grade"), tail.alias("tail_probability"))
    return scored.withColumn("kept", F.col("tail_probability") >= KEEP_TAIL)
