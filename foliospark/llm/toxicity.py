"""Operator 4, toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts, the unlabelled set is a sample of all texts.  With class
prior p the risk is p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)) under the
logistic loss; where the bracket is negative its gradient is followed upwards (the non-negative
correction).  A linear model over all hashed columns of the sample is trained in numpy, in two
steps from weights of zero, with weights of either sign and a learned intercept:

1. The risk with a penalty on each weight of STRICT standard errors of its gradient.  Accelerated
   proximal steps work on the columns that the gradient calls for, and go on with further columns
   until none is called for (or ROUNDS are done), so the risk alone chooses among all columns.
2. The risk over the chosen columns alone, with a small quadratic penalty.

Only rows whose crc32 of doc_id leaves a remainder by 5 are ever learned from; labels, language,
source and doc_id are no features.  At most POSITIVES and UNLABELLED rows are fitted on.  The prior
is the share of toxic labels unless given: give it where the labels were not drawn as the corpus is.

Defined results: null or empty text: the score of the intercept alone.  Null doc_id: scored and
held out.  Repeated rows are scored alike; drop_toxic judges each row by its own text, whatever rows
share its doc_id.  Without positives every score is 0.0; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .hashed_text import Matrix, feature_rows, margins, restrict, sample, sigmoid

POSITIVES, UNLABELLED = 2000, 6000  # most rows to fit on
STRICT = 3.0  # standard errors
ROUNDS, STEPS, LAST_STEPS = 6, 60, 300
DECAY, LAST_DECAY = 1e-3, 5e-4  # quadratic penalties of the two steps
THRESHOLD = 0.5


@dataclass
class Model:
    vocabulary: np.ndarray
    weights: np.ndarray
    intercept: float


def pu_risk(gp: np.ndarray, gu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray, bool]:
    """The risk for the margins of positives and unlabelled rows, the gradient to follow (that of
    the risk, but with the bracket's sign turned where it is negative), and whether it is so."""
    n, m = max(1, len(gp)), max(1, len(gu))
    lose = prior * np.logaddexp(0, -gp).sum() / n
    bracket = np.logaddexp(0, gu).sum() / m - prior * np.logaddexp(0, gp).sum() / n
    up, uu = prior * sigmoid(gp) / n, sigmoid(gu) / m
    sign = 1 if bracket >= 0 else -1
    return lose + max(0.0, bracket), up - prior / n - sign * up, sign * uu, sign < 0


def _steps(p: Matrix, u: Matrix, prior: float, penalty: np.ndarray, decay: float, w: np.ndarray, b: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Accelerated proximal steps, each weight's length from a bound of the risk's curvature."""
    n, m = max(1, len(p.sizes)), max(1, len(u.sizes))
    bend = 0.25 * (u.back((u.sizes + 1) / m) + prior * p.back((p.sizes + 1) / n)) + decay + 1e-12
    bend_b = 0.25 * ((u.sizes + 1).sum() / m + prior * (p.sizes + 1).sum() / n)
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        _, gp, gu, _ = pu_risk(p.dot(ahead) + ahead_b, u.dot(ahead) + ahead_b, prior)
        free = ahead - (p.back(gp) + u.back(gu) + decay * ahead) / bend
        new, new_b = np.sign(free) * np.maximum(np.abs(free) - penalty / bend, 0), ahead_b - (gp.sum() + gu.sum()) / bend_b
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / later * (new - w), new_b + (t - 1) / later * (new_b - b)
        w, b, t = new, new_b, later
    return w, b


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    if not positive:
        return Model(np.zeros(0, np.int32), np.zeros(0), -np.inf)
    known = np.unique(np.concatenate([*positive, *unlabelled]))
    p, u = (Matrix(restrict(rows, known), len(known), False) for rows in (positive, unlabelled))
    n, share = len(positive), u.back(np.full(len(unlabelled), 1 / max(1, len(unlabelled))))
    penalty = STRICT * prior * np.sqrt((share + 1 / n) / n)
    w, b, active = np.zeros(len(known)), float(np.log(prior / (1 - prior))), np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        _, gp, gu, _ = pu_risk(p.dot(w) + b, u.dot(w) + b, prior)
        pull = np.abs(p.back(gp) + u.back(gu)) / penalty
        pull[active] = 0
        called = np.argsort(-pull, kind="stable")[: max(64, len(active))]
        called = called[pull[called] > 1]
        if not len(called):
            break
        active = np.union1d(active, called)
        w[active], b = _steps(p.only(active), u.only(active), prior, penalty[active], DECAY, w[active], b)
    chosen = np.flatnonzero(w)
    last, b = _steps(p.only(chosen), u.only(chosen), prior, np.zeros(len(chosen)), LAST_DECAY, w[chosen], b, LAST_STEPS)
    return Model(known[chosen], last, b)


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic).  prior: share of toxic texts; by default that
    of the labelled training rows."""
    common.small_batches(docs.sparkSession)
    own = labels.where(~common.held_out_flag(F.col("doc_id")) & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
    if prior is None:
        prior = own.agg(F.avg("toxic").alias("p")).first()["p"]
    prior = min(0.9, max(0.001, prior or 0.0))
    texts = docs.select("doc_id", "text").where(~common.held_out_flag(F.col("doc_id")))
    marked = sample(own.where("toxic = 1"), positives, "id").withColumn("label", F.lit(1))
    others = sample(texts.select(F.col("doc_id").alias("id")), unlabelled, "id").withColumn("label", F.lit(0))
    chosen = marked.unionByName(others)  # at most positives + unlabelled ids, so it can be broadcast
    rows = feature_rows(texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("id")), "label").toPandas()
    sets = [np.frombuffer(x, np.int32) for x in rows["features"]]
    return fit([s for s, y in zip(sets, rows["label"]) if y == 1], [s for s, y in zip(sets, rows["label"]) if y == 0], prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text)."""
    common.small_batches(docs.sparkSession)
    found = margins(docs, model.vocabulary, model.weights, False, "doc_id")
    p = 1 / (1 + F.exp(-(F.col("margin") + F.lit(model.intercept))))
    scored = found.select("doc_id", common.held_out_flag(F.col("doc_id")).alias("held_out"), p.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents predicted toxic, rows with a null doc_id among them."""
    model = train(docs, labels)
    return common.without(docs, lambda rows: score(rows, model).where("predicted = 1"), "toxic")
