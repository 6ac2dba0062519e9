"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are presence flags of words, adjacent pairs, pairs one word apart, and word
stems (first bytes, so that inflected forms share one). Labelled rows are sampled by
hash up to a documented bound for training; every row is scored over its whole text.
L1 leaves some hundreds to thousands of weights, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.features import Ftrl, SparseWeights, mix, word_hashes
from lodestrata.llm.scratch import place, sampled, shielded, unshielded

#: Labelled documents that training takes at most, about (they are chosen by a hash of the id).
MAX_TRAINING = 8_000
#: Training leaves out hashes that fewer of its documents have; scoring looks at all.
LEAST_DOCS = 4
EPOCHS = 5
#: Weight of a row labelled 1, which are the rarer ones.
POSITIVE = 4.0
STEM = 4
ALPHA = 2.0
_PAIR, _SKIP, _STEM = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)


def text_features(text: str | None) -> np.ndarray:
    """Distinct feature hashes of a text; empty for null and empty texts."""
    raw = (text or "").lower().encode()
    w = word_hashes(raw)
    stems = word_hashes(raw, head=STEM)
    grams = [w, mix(stems ^ _STEM)]
    if w.size > 1:
        grams.append(mix(w[:-1] * _PAIR + w[1:]))
    if w.size > 2:
        grams.append(mix(w[:-2] * _SKIP + w[2:]))
    return np.unique(np.concatenate(grams))


@dataclass
class ToxicityModel:
    keys: np.ndarray
    values: np.ndarray
    bias: float

    def score(self, text: str | None, weights: SparseWeights) -> float:
        _, v = weights.find(text_features(text))
        return float(1.0 / (1.0 + np.exp(-np.clip(v.sum() + self.bias, -35, 35))))

    def weights(self) -> SparseWeights:
        return SparseWeights(self.keys, self.values, self.bias)


def train(rows: list[tuple[np.ndarray, float]], epochs: int = EPOCHS, least_docs: int = LEAST_DOCS, l1: float = 14.0) -> ToxicityModel:
    """A model from (feature hashes, label) rows, passed over in the order given."""
    if not rows:
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), 0.0)
    keys, counts = np.unique(np.concatenate([r[0] for r in rows]), return_counts=True)
    keys = keys[counts >= least_docs]
    del counts
    columns = []
    for hashes, _ in rows:
        at = np.searchsorted(keys, hashes)
        at = at[at < keys.size]
        columns.append(np.concatenate(([0], at[keys[at] == hashes[: at.size]] + 1)).astype(np.int32))
    learner = Ftrl(keys.size + 1, alpha=ALPHA, l1=l1, l2=1.0)
    for _ in range(epochs):
        for at, (_, y) in zip(columns, rows, strict=True):
            learner.step(at, np.ones(at.size), y, POSITIVE if y else 1.0)
    w = learner.weights()
    used = np.flatnonzero(w[1:])
    return ToxicityModel(keys[used], w[1:][used], float(w[0]))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([text_features(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["at", "y", "features"]
        )


def _learn(epochs: int, least_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [
            (np.frombuffer(f, dtype=np.uint64), y) for b in batches for y, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
        ]
        m = train(rows, epochs, least_docs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(m.keys, np.uint64(0)).view(np.int64)), pa.array(np.append(m.values, m.bias)), pa.array([*[False] * m.keys.size, True])],
            names=["key", "w", "is_bias"],
        )

    return run


def fit(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, epochs: int = EPOCHS, least_docs: int = LEAST_DOCS) -> ToxicityModel:
    """A model from labelled texts: ``docs(id, text)`` and ``labels(id, y)``; null ids and labels are left out.

    Only an expected ``max_training`` labelled rows are used, chosen by a hash of the id;
    a row that repeats an id and its text counts once.
    """
    known = labels.where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").cast("double").alias("y"))
    known = known.withColumn("at", F.xxhash64("id", F.lit("toxicity")))
    n = known.count()
    known = sampled(known, F.col("at"), n, max_training)
    rows = docs.join(known, "id").select("at", "y", "text").dropDuplicates().mapInArrow(_emit, "at bigint, y double, features binary")
    got = rows.repartition(1).sortWithinPartitions("at", "features").mapInArrow(_learn(epochs, least_docs), "key bigint, w double, is_bias boolean").collect()
    weights = [r for r in got if not r["is_bias"]]
    bias = next((r["w"] for r in got if r["is_bias"]), 0.0)
    keys = np.array([r["key"] for r in weights], dtype=np.int64).view(np.uint64)
    return ToxicityModel(keys, np.array([r["w"] for r in weights], dtype=np.float64), bias)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 over the whole text; null and empty texts get the bias alone."""
    rows = shielded(docs)
    names, at = rows.columns, rows.columns.index(place(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights()
        for b in batches:
            got = pa.array([model.score(t, weights) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*names, out])

    return unshielded(rows.mapInArrow(run, rows.withColumn(out, F.lit(0.0).cast("double")).schema), docs.columns, out)


def held_out(id_col: str) -> "F.Column":
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    Rows whose crc32 of the id leaves 1 modulo 3 are held out of training. A null id is
    not held out, nor trained on. Repeated rows are each scored. With no labels at all
    every score is one half. An empty table gives an empty table.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    model = fit(texts, known)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    scored = score(rows, model).select("doc_id", "held_out", "score")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
