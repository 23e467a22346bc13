"""Bounded samples of labelled documents, the held-out rule, and a small logistic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.session import materialise


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text is divisible by 5. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int, most_chars: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[tuple[int, str]], dict[int, int]]:
    """Learnable texts of each label in hash order of their ids, and the label counts.

    Of a label there are ``per_class`` texts at most, together of ``most_chars`` characters at most (one
    text at least), each of ``longest`` at most; so what the driver holds has a bound. Labels other than
    0 and 1, ids without a text and longer texts are passed over; of an id's texts the shortest counts.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).where("_label IN (0, 1) AND _id IS NOT NULL")
    own = own.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_label").alias("_label"))
    counts = {int(r["_label"]): int(r["count"]) for r in own.groupBy("_label").count().collect()}
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).where(F.length("_text").between(1, longest))
    # Twice as many ids as asked for: some have no text here. The ids are bounded, so they may be broadcast.
    drawn = None
    for value in (0, 1):
        part = own.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(2 * per_class)
        drawn = part if drawn is None else drawn.unionByName(part)
    least = F.min(F.struct(F.length("_text").alias("n"), "_text")).alias("x")
    found = materialise(texts.join(F.broadcast(drawn), "_id").groupBy("_id", "_label").agg(least).select("_id", "_label", F.xxhash64("_id").alias("_hash"), "x.n", "x._text"), "sample")
    chosen: list[tuple[int]] = []
    room = {0: [per_class, most_chars], 1: [per_class, most_chars]}
    for r in sorted(found.select("_label", "_hash", "_id", "n").collect()):
        left = room[r["_label"]]
        if left[0] and (r["n"] <= left[1] or left[0] == per_class):
            left[0], left[1] = left[0] - 1, left[1] - r["n"]
            chosen.append((r["_id"],))
        else:
            left[0] = 0
    rows = found.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "_id long")), "_id").select("_label", "_hash", "_id", "_text").collect()
    return [(r["_label"], r["_text"]) for r in sorted(rows)], counts


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression by damped Newton steps; for few columns."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, x.T @ (weight * (y - p)) - ridge * w)
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Design:
    """Rows of 0/1 terms, each row with its list of term numbers, beside a few dense columns.

    Every row also has the term numbered ``terms``, the offset, so no row is empty.
    """

    terms: int
    columns: np.ndarray
    lengths: np.ndarray
    dense: np.ndarray

    @classmethod
    def of(cls, rows: list[list[int]], terms: int) -> Design:
        lengths = np.array([len(r) + 1 for r in rows], np.int64)
        columns = np.array([c for r in rows for c in (*r, terms)], np.int64)
        return cls(terms, columns, lengths, np.empty((len(rows), 0)))

    def times(self, w: np.ndarray) -> np.ndarray:
        if not len(self.lengths):
            return np.empty(0)
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        return np.add.reduceat(w[self.columns], starts) + self.dense @ w[self.terms + 1 :]

    def back(self, gap: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.columns, np.repeat(gap, self.lengths), self.terms + 1)
        return np.concatenate([sparse, self.dense.T @ gap])

    def rows(self, chosen: np.ndarray) -> Design:
        return Design(self.terms, self.columns[np.repeat(chosen, self.lengths)], self.lengths[chosen], self.dense[chosen])

    def plus(self, column: np.ndarray) -> Design:
        return Design(self.terms, self.columns, self.lengths, np.column_stack([self.dense, column]))


def fit_linear(x: Design, y: np.ndarray, ridge: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic regression over many columns by accelerated gradient steps; the offset is a column."""
    n = max(1, len(y))
    rate = 4.0 / (float(x.lengths.mean()) + x.dense.shape[1])
    w = np.zeros(x.terms + 1 + x.dense.shape[1])
    before = w
    for k in range(rounds):
        v = w + (k / (k + 3)) * (w - before)
        before, w = w, v - rate * (x.back(sigmoid(x.times(v)) - y) / n + ridge * v)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
