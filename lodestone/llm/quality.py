"""Quality scores by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled texts. A text that
resembles one of them compresses better with it: the difference of its two compressed sizes per byte
is calibrated to a probability by a logistic regression on labelled texts that neither dictionary has
seen. That difference is the score's only input. A text is compressed in pieces, each on its own, so
that what it repeats can't stand in for the dictionaries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.labelled import fit_logistic, held_out, labelled_sample, sigmoid
from lodestone.llm.memo import claim

LEVEL = 3
#: Bytes that are compressed on their own.
PIECE = 256


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray
    raw: bool = False

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """How many bytes the good dictionary saves over the bad one, per ten bytes of each text."""
        kind = zstandard.DICT_TYPE_RAWCONTENT if self.raw else zstandard.DICT_TYPE_FULLDICT
        good, bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=kind), write_content_size=False).compress for d in (self.good, self.bad))
        out = np.zeros(len(texts))
        for k, text in enumerate(texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            pieces = [data[at : at + PIECE] for at in range(0, len(data), PIECE)]
            out[k] = 10 * (sum(map(len, map(bad, pieces))) - sum(map(len, map(good, pieces)))) / max(1, len(data))
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(_columns(self.differences(texts)) @ self.weights)


def _columns(differences: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(differences)), differences], 1)


def _dictionary(texts: list[str], size: int, raw: bool) -> bytes:
    parts = [data[at : at + 4096] for data in (t.encode("utf-8", "surrogatepass") for t in texts) for at in range(0, len(data), 4096)]
    if raw:
        return b"\n".join(parts)[-size:] or b"\n" * 8
    return zstandard.train_dictionary(size, parts).as_bytes()


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 4000, longest: int = 100_000, dictionary: int = 1_000_000) -> QualityModel:
    """A model from at most ``per_class`` learnable texts of each label, each of ``longest`` characters at most.

    Half of the sample builds the dictionaries, the other half calibrates, weighted by how often each
    label occurs. A dictionary has ``dictionary`` bytes at most, and a quarter of the smaller sample's
    characters; too few texts for a trained one make one of their plain content. Where a label has no
    text at all, every score is the share of label 1, or 0.5 without labels.
    """
    sample, counts = labelled_sample(docs, labels, label, per_class, longest)
    by = {value: [t for v, t in sample if v == value] for value in (0, 1)}
    if not (by[0] and by[1]):
        share = (counts.get(1, 0) + 1e-3) / (sum(counts.values()) + 2e-3)
        return QualityModel(b"\n" * 8, b"\n" * 8, np.array([np.log(share / (1 - share)), 0.0]), raw=True)
    seen = {v: texts[::2] for v, texts in by.items()}
    fresh = {v: texts[1::2] or texts for v, texts in by.items()}
    size = min(dictionary, min(sum(map(len, texts)) for texts in seen.values()) // 4)
    # A trained dictionary wants many times its own size in samples, and many samples.
    raw = size < 10_000
    model = QualityModel(*(_dictionary(seen[v], dictionary if raw else size, raw) for v in (1, 0)), np.zeros(2), raw)
    x = np.concatenate([_columns(model.differences(fresh[v])) for v in (0, 1)])
    y = np.concatenate([np.full(len(fresh[v]), float(v)) for v in (0, 1)])
    total = sum(counts.values())
    weight = np.concatenate([np.full(len(fresh[v]), counts[v] / total / len(fresh[v]) * len(x)) for v in (0, 1)])
    return QualityModel(model.good, model.bad, fit_logistic(x, y, weight), raw)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row: score from 0 to 1, predicted 1 from 0.3 on.

    A null text is scored as the empty one. Ids may be null (never held out) or repeat. Only the text
    enters the score. Other columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(None)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.score(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is predicted 1, all columns as they are."""
    shared, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(None)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                yield part.filter(pa.array(shared.value.score(part.column(at).to_pylist()) >= 0.3))

    return docs.mapInArrow(run, docs.schema)
