"""Hashed text features and the numpy trainers of the classifiers (operators 4 and 9).

A text's features are its distinct words and the first 4, 5, 6 and last 3 bytes of its longer
words, hashed to 2 ** 30 columns.  A model has weights for columns that its trainer chose among all
columns of its bounded sample; other columns are ignored.  A text without words has no features
and scores by the intercept alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import WordHasher, column_bytes

BITS = 30
HEADS, TAILS = (4, 5, 6), (3,)


def features(hasher: WordHasher, column) -> Iterator[np.ndarray]:
    data, offs = column_bytes(column)
    words, starts, parts = hasher.words(data, offs[:-1], HEADS, TAILS)
    shift = np.uint64(64 - BITS)
    whole = (words >> shift).astype(np.int32)
    extra = np.where(parts != 0, (parts >> shift).astype(np.int32), -1)
    bound = np.searchsorted(starts, offs).tolist()
    for lo, hi in zip(bound[:-1], bound[1:]):
        found = np.unique(np.concatenate((whole[lo:hi], extra[:, lo:hi].ravel())))
        yield found[1:] if len(found) and found[0] < 0 else found


def feature_rows(rows: DataFrame, label: str) -> DataFrame:
    """(label, features as int32 bytes) of rows with text."""

    def run(batches):
        hasher = WordHasher()
        for batch in batches:
            found = [f.tobytes() for f in features(hasher, batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column(label), pa.array(found, pa.binary())], ["label", "features"])

    return rows.select(F.col(label).cast("int").alias(label), F.col("text").cast("string").alias("text")).mapInArrow(run, "label int, features binary")


def sample(rows: DataFrame, bound: int, column: str) -> DataFrame:
    """At most bound distinct values of a column, the same on each run: those of the smallest hash.

    Only values in a low range of the hash are shuffled; the range widens while it holds too few.
    """
    hashed = rows.select(column, F.xxhash64(column, F.lit(11)).alias("h"))
    share = 4 * bound / max(1, rows.count())
    while True:
        low = hashed if share >= 1 else hashed.where(F.col("h") < int((share * 2 - 1) * 2**63))
        found = low.distinct().orderBy("h", column).limit(bound)
        if share >= 1 or found.count() == bound:
            return found.select(column)
        share *= 16


def restrict(rows: list[np.ndarray], vocabulary: np.ndarray) -> list[np.ndarray]:
    """Positions in the ascending vocabulary of each row's known columns."""
    if not len(vocabulary):
        return [np.zeros(0, np.int64) for _ in rows]
    flat = np.concatenate([np.zeros(0, np.int32), *rows])
    at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
    known = vocabulary[at] == flat
    ends = np.cumsum([len(r) for r in rows])
    kept = np.concatenate(([0], np.cumsum(known)))[np.concatenate(([0], ends))]
    return np.split(at[known], kept[1:-1])


class Matrix:
    """Sparse rows of ones, or with shrink of 1 / sqrt(size)."""

    def __init__(self, rows: list[np.ndarray], width: int, shrink: bool):
        self.width, self.shrink = width, shrink
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.columns = np.concatenate([np.zeros(0, np.int64), *rows])
        self.ends = np.cumsum(self.sizes)
        self.scale = 1 / np.sqrt(np.maximum(self.sizes, 1)) if shrink else np.ones(len(rows))

    def part(self, chosen: np.ndarray) -> Matrix:
        return Matrix([self.columns[self.ends[i] - self.sizes[i] : self.ends[i]] for i in chosen], self.width, self.shrink)

    def only(self, kept: np.ndarray) -> Matrix:
        """The ascending columns kept of the matrix, numbered anew."""
        place = np.full(self.width, -1)
        place[kept] = np.arange(len(kept))
        at = place[self.columns]
        sums = np.concatenate(([0], np.cumsum(at >= 0)))
        bounds = sums[np.concatenate(([0], self.ends))]
        return Matrix(np.split(at[at >= 0], bounds[1:-1]) if len(self.sizes) else [], len(kept), self.shrink)

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(w[self.columns])))
        return (sums[self.ends] - sums[self.ends - self.sizes]) * self.scale

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, np.repeat(g * self.scale, self.sizes), self.width)


class Adam:
    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.001 * (g * g - self.v)
        return -self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def margins(docs: DataFrame, vocabulary: np.ndarray, weights: np.ndarray, shrink: bool, carry: str) -> DataFrame:
    """(carry, margin) of docs(carry, text); the model broadcast has no more columns than its sample."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def run(batches):
        hasher, (known, w) = WordHasher(), shared.value
        for batch in batches:
            rows = Matrix(restrict(list(features(hasher, batch.column("text"))), known), len(known), shrink)
            yield pa.RecordBatch.from_arrays([batch.column(carry), pa.array(rows.dot(w), pa.float64())], [carry, "margin"])

    rows = docs.select(F.col(carry).cast("long").alias(carry), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"{carry} long, margin double")
