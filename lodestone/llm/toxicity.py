"""Toxicity by a classifier chain.

The categories are predicted one after another by linear models over words and word beginnings; each
later model also gets the earlier categories' probabilities. While it is trained, these come from
models of the other folds, so that it learns from predictions as it will see them; terms, markers and
weights of such a model are chosen on those other folds alone.

Only one judgement, toxic or not, is labelled; the finer categories are derived from it on the
training rows. A *marker* is a word or beginning that the sample has almost only in toxic texts.
``explicit``: toxic with a marker; ``severe``: toxic with three markers or more; ``toxic``: as labelled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.labelled import Design, fit_linear, held_out, labelled_sample, sigmoid
from lodestone.llm.memo import claim

CATEGORIES = ("explicit", "severe", "toxic")
_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (4, 5, 6, 7)
FOLDS = 3


def features_of(text: str | None) -> set[str]:
    """Words in lower case, and ``^`` with the first letters of those that are longer."""
    words = set(_WORD.findall((text or "").lower()))
    found = set(words)
    for size in _BEGINNINGS:
        found.update(["^" + w[:size] for w in words if len(w) > size])
    return found


@dataclass
class ToxicityModel:
    terms: dict[str, int]
    weights: list[np.ndarray]
    threshold: float = 0.5
    n_terms: int = 0

    def design(self, found: list[set[str]]) -> Design:
        known = self.terms.keys()
        return Design.of([[self.terms[f] for f in known & features] for features in found], self.n_terms)

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each category, a column each."""
        x = self.design([features_of(t) for t in texts])
        for w in self.weights:
            x = x.plus(sigmoid(x.times(w)))
        return x.dense


def _hashes(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the text's features."""
    return np.sort(np.array([xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass")) for f in features_of(text)], np.uint64))


def _count(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate([np.empty(0, np.uint64), *rows]), return_counts=True)


def _select(toxic: list[np.ndarray], clean: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the terms of toxic texts that tell most, and which of them are markers."""
    found, often = _count(toxic)
    found, often = found[often >= 3], often[often >= 3]
    if not len(found):
        return found, np.empty(0, bool)
    other, counts = _count([row[np.isin(row, found, assume_unique=True)] for row in clean])
    rare = np.zeros(len(found))
    rare[np.searchsorted(found, other)] = counts
    gap = np.abs(np.log((often + 0.5) / (len(toxic) + 1)) - np.log((rare + 0.5) / (len(clean) + 1))) * np.sqrt(often)
    best = np.sort(np.lexsort((found, -gap))[: min(most, int((gap > 3).sum()))])
    marker = (often >= 5) & ((rare + 0.1) / max(1, len(clean)) <= 0.02 * often / max(1, len(toxic)))
    return found[best], marker[best]


class _View:
    """The sample as the terms and markers chosen on some of its rows show it."""

    def __init__(self, rows: list[np.ndarray], toxic: np.ndarray, chosen: np.ndarray, most: int):
        pick = lambda mask: [rows[k] for k in np.flatnonzero(mask)]
        self.terms, marker = _select(pick(chosen & toxic), pick(chosen & ~toxic), most)
        at = [np.flatnonzero(np.isin(self.terms, row, assume_unique=True)) for row in rows]
        hits = np.array([marker[k].sum() for k in at])
        self.design = Design.of([k.tolist() for k in at], len(self.terms))
        self.targets = {"explicit": toxic & (hits >= 1), "severe": toxic & (hits >= 3), "toxic": toxic}


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 3000, longest: int = 100_000, most_terms: int = 3000, false_share: float = 0.001) -> ToxicityModel:
    """A model from at most ``per_class`` learnable texts of each label, each of ``longest`` characters at most.

    The threshold is the least, from 0.2 on, that passes all but ``false_share`` of the clean texts, by
    models that have not seen them. Where a label has no text, the model finds nothing toxic.
    """
    sample, _ = labelled_sample(docs, labels, label, per_class, longest)
    toxic = np.array([v == 1 for v, _ in sample], bool)
    if not len(toxic) or toxic.all() or not toxic.any():
        return ToxicityModel({}, [np.array([-20.0] + [0.0] * k) for k in range(len(CATEGORIES))])
    rows = [_hashes(t) for _, t in sample]
    # Each label is dealt over all folds.
    fold = np.empty(len(rows), int)
    for value in (False, True):
        own = np.flatnonzero(toxic == value)
        fold[own] = np.arange(len(own)) % FOLDS
    every = np.ones(len(rows), bool)
    whole, parts = _View(rows, toxic, every, most_terms), [_View(rows, toxic, fold != k, most_terms) for k in range(FOLDS)]
    weights, fresh = [], np.empty(len(rows))
    for category in CATEGORIES:
        for k, view in enumerate(parts):
            y = view.targets[category].astype(float)
            fresh[fold == k] = sigmoid(view.design.rows(fold == k).times(fit_linear(view.design.rows(fold != k), y[fold != k])))
        weights.append(fit_linear(whole.design, whole.targets[category].astype(float)))
        for view in (whole, *parts):
            view.design = view.design.plus(fresh)
    number = {int(h): k for k, h in enumerate(whole.terms)}
    terms = {f: number[h] for _, t in sample for f in features_of(t) if (h := xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass"))) in number}
    # As low as the clean texts of the sample allow by predictions of the other folds.
    threshold = float(np.clip(np.quantile(fresh[~toxic], 1 - false_share), 0.2, 0.8))
    return ToxicityModel(terms, weights, threshold, len(number))


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, p_explicit, p_severe, p_toxic, toxic`` of every row, from its whole text.

    A null text is scored as the empty one. Ids may be null (never held out) or repeat. Only the text
    enters the score. Other columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(None)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                p = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, k]) for k in range(p.shape[1]))], ["doc_id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *names, (F.col("p_toxic") >= model.threshold).alias("toxic"))


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is not found toxic, all columns as they are."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(None)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield part.filter(pa.array(shared.value.predict(part.column(at).to_pylist())[:, -1] < shared.value.threshold))

    return docs.mapInArrow(run, docs.schema)
