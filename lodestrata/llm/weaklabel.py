"""Quality scores from weak labels.

Overlapping heuristic labellers vote on every document (bad, good, or nothing). The
corpus is counted by vote pattern, expectation-maximisation over those counts
estimates each labeller's accuracies on good documents and on each kind of bad ones,
with the shares of the kinds, and the posterior of a pattern is the soft label of its documents. A hashed linear scorer
trained on the posteriors of a bounded sample then scores every document. No gold
label is used.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.features import Ftrl, slices
from lodestrata.llm.scratch import place, sampled, shielded, unshielded

#: Documents that the scorer's training takes at most, about (chosen by a hash of id and text).
MAX_TRAINING = 12_000
DIMENSIONS = 1 << 16
EPOCHS = 4
ABSTAIN, BAD, GOOD = 0, 1, 2

# Frequent function words of the corpus languages.
FUNCTION_WORDS = "the and of to in is that for der die das und den zu von ein eine le la les de des et un une que el los en y con por"
_FUNCTION = frozenset(FUNCTION_WORDS.encode().split())
_SHARES = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7])
_MARKS, _UPPER = b"#$%&*@^~=<>{}\\", bytes(range(65, 91))
_NOT_LETTERS = bytes(b for b in range(192) if not (65 <= b < 91 or 97 <= b < 123))


def _without(raw: bytes, drop: bytes) -> int:
    return len(raw.translate(None, drop))


def measures(text: str | None) -> dict[str, float]:
    """Counts and shares that the labellers look at; zeros for an empty text."""
    raw = (text or "").encode()
    n = same = function = 0
    distinct: set[bytes] = set()
    last = None
    for piece in slices(raw):
        words = piece.split()
        n += len(words)
        distinct.update(words)
        same += sum(map(eq, words, words[1:])) + (bool(words) and words[0] == last)
        function += sum(map(_FUNCTION.__contains__, piece.lower().split()))
        last = words[-1] if words else last
    if not n:
        return dict.fromkeys(("n", "marks", "upper", "shouts", "bars", "echo", "distinct", "lines", "width", "function"), 0.0)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return {
        "n": float(n),
        "marks": (len(raw) - _without(raw, _MARKS)) / n,
        "upper": (len(raw) - _without(raw, _UPPER)) / max(1, _without(raw, _NOT_LETTERS)),
        "shouts": raw.count(b"!") / n,
        "bars": raw.count(b"|") / n,
        "echo": same / max(1, n - 1),
        "distinct": len(distinct) / n,
        "lines": 1.0 - len(set(lines)) / max(1, len(lines)),
        "width": len(text) / n,
        "function": function / n,
    }


def _above(value: float, bad: float, good: float) -> int:
    return BAD if value > bad else GOOD if value < good else ABSTAIN


#: (name, vote from the measures); each abstains where it has too little to go by.
LABELLERS = (
    ("marks", lambda m: _above(m["marks"], 0.6, 0.1) if m["n"] >= 5 else ABSTAIN),
    ("capitals", lambda m: _above(m["upper"], 0.35, 0.15) if m["n"] >= 8 else ABSTAIN),
    ("shouts", lambda m: _above(m["shouts"], 0.4, 0.1) if m["n"] >= 8 else ABSTAIN),
    ("bars", lambda m: _above(m["bars"], 0.15, 0.03) if m["n"] >= 8 else ABSTAIN),
    ("echo", lambda m: _above(m["echo"], 0.2, 0.08) if m["n"] >= 10 else ABSTAIN),
    ("variety", lambda m: _above(1 - m["distinct"], 0.8, 0.6) if m["n"] >= 20 else ABSTAIN),
    ("lines", lambda m: _above(m["lines"], 0.3, 0.1) if m["n"] >= 20 else ABSTAIN),
    ("width", lambda m: _above(m["width"], 11.0, 8.0) if m["n"] >= 8 else ABSTAIN),
    ("function", lambda m: (BAD if m["function"] == 0 else GOOD if m["function"] > 0.05 else ABSTAIN) if m["n"] >= 30 else ABSTAIN),
)


def votes(m: dict[str, float]) -> int:
    """All votes as one number in base 3."""
    pattern = 0
    for _, vote in reversed(LABELLERS):
        pattern = 3 * pattern + vote(m)
    return pattern


def unpack(patterns: np.ndarray) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(len(LABELLERS))) % 3


@dataclass
class LabelModel:
    """``bad[class, labeller]``: chance that a labeller that votes says bad; class 0 is good, class j + 1 the
    kind of bad document that labeller j was made for. ``share``: of each class in the corpus."""

    bad: np.ndarray
    share: np.ndarray

    def memberships(self, patterns: np.ndarray) -> np.ndarray:
        v = unpack(np.asarray(patterns, dtype=np.int64))
        log = (v == BAD) @ np.log(self.bad).T + (v == GOOD) @ np.log1p(-self.bad).T + np.log(self.share)
        p = np.exp(log - log.max(axis=1, keepdims=True, initial=-np.inf))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The chance that documents with these votes are good."""
        return self.memberships(patterns)[:, 0] if len(patterns) else np.empty(0)

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Per labeller: how often it says bad of bad documents, and good of good ones."""
        of_bad = self.share[1:] @ self.bad[1:] / self.share[1:].sum()
        return {name: (float(of_bad[j]), float(1 - self.bad[0, j])) for j, (name, _) in enumerate(LABELLERS)}


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and how many documents have each.

    Bad documents come in kinds that set off different labellers, so the bad side is a
    mixture with one class a labeller; a single bad class would take the rarer kinds for
    chance votes on good documents. Abstaining says nothing, so short texts keep the
    prior. Starts from labellers that are mostly right.
    """
    k = len(LABELLERS)
    bad = np.full((k + 1, k), 0.05)
    bad[0] = 0.005
    bad[np.arange(1, k + 1), np.arange(k)] = 0.9
    model = LabelModel(bad, np.array([0.8, *[0.2 / k] * k]))
    if not counts.sum():
        return model
    v = unpack(np.asarray(patterns, dtype=np.int64))
    weight = counts / counts.sum()
    for _ in range(rounds):
        q = model.memberships(patterns) * weight[:, None]
        said_bad, said_any = q.T @ (v == BAD), q.T @ (v != ABSTAIN)
        prior = 1e-4
        nxt = ((said_bad + prior * bad) / (said_any + prior)).clip(1e-6, 1 - 1e-6)
        share = (q.sum(axis=0) + 1e-6).clip(1e-6)
        moved = abs(nxt - model.bad).max()
        model = LabelModel(nxt, share / share.sum())
        if moved < 1e-7:
            break
    return model


_SHAPE = bytes(ord("A") if 65 <= b < 91 else ord("0") if 48 <= b < 58 else ord("a") if 97 <= b < 123 or b >= 128 else b for b in range(256))
_RUNS = tuple((c * 4, c * 2, c) for c in (b"a", b"A", b"0"))


def outline(piece: bytes) -> bytes:
    """The text as classes of characters, runs of letters and digits collapsed."""
    shape = piece.translate(_SHAPE)
    for four, two, one in _RUNS:
        while four in shape:
            shape = shape.replace(four, one)
        while two in shape:
            shape = shape.replace(two, one)
    return shape


def _column(*key: object) -> int:
    return 1 + zlib.crc32(repr(key).encode()) % (DIMENSIONS - 1)


def scorer_features(text: str | None, m: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed columns and values: word outlines and pairs of them by share, and binned measures."""
    kinds: Counter = Counter()
    last: list[bytes] = []
    for piece in slices((text or "").encode()):
        shapes = outline(piece).split()
        kinds.update(shapes)
        kinds.update(zip([*last, *shapes], shapes if last else shapes[1:], strict=False))
        last = shapes[-1:] or last
    value: dict[int, float] = {0: 1.0}
    for kind, n in kinds.items():
        c = _column(kind)
        value[c] = value.get(c, 0.0) + (n / m["n"]) ** 0.5
    bins = [int(np.searchsorted(_SHARES, min(m[k], 1.0), "right")) for k in ("marks", "upper", "shouts", "bars", "echo", "lines", "function")]
    bins += [int(10 * (1 - m["distinct"])) if m["n"] >= 20 else 11, min(int(m["width"]), 15), min(int(m["n"]).bit_length(), 6)]
    for j, b in enumerate(bins):
        c = _column(j, b)
        value[c] = value.get(c, 0.0) + 1.0
    return np.fromiter(value, dtype=np.int64), np.fromiter(value.values(), dtype=np.float64)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], epochs: int = EPOCHS) -> np.ndarray:
    learner = Ftrl(DIMENSIONS, alpha=0.2, l1=0.05, l2=0.5)
    for _ in range(epochs):
        for columns, values, y in rows:
            learner.step(columns, values, y)
    return learner.weights()


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([votes(measures(t)) for t in b.column(0).to_pylist()], pa.int64())], names=["pattern"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for t in b.column(1).to_pylist():
            m = measures(t)
            columns, values = scorer_features(t, m)
            rows.append((votes(m), columns.astype(np.int32).tobytes(), values.astype(np.float32).tobytes()))
        p, c, v = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.int64()), pa.array(c, pa.binary()), pa.array(v, pa.binary())], names=["at", "pattern", "columns", "values"])


def _learn(labels: LabelModel, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            soft = labels.posterior(b.column(1).to_numpy(zero_copy_only=False))
            for c, v, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), soft, strict=True):
                rows.append((np.frombuffer(c, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64), float(y)))
        yield pa.RecordBatch.from_arrays([pa.array([train(rows, epochs).tobytes()], pa.binary())], names=["weights"])

    return run


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray

    def score(self, text: str | None) -> float:
        columns, values = scorer_features(text, measures(text))
        return float(1 / (1 + np.exp(-np.clip(self.weights[columns] @ values, -35, 35))))


def fit(docs: DataFrame, text_col: str = "text", max_training: int = MAX_TRAINING, epochs: int = EPOCHS) -> QualityModel:
    """Label model from the votes on all rows; scorer from an expected ``max_training`` of them, chosen by a hash of the text."""
    text = docs.select(F.col(text_col).alias("text"))
    got = text.mapInArrow(_vote, "pattern bigint").groupBy("pattern").agg(F.count("*").alias("n")).collect()  # at most 3 ** labellers rows
    patterns, counts = np.array([r["pattern"] for r in got], dtype=np.int64), np.array([r["n"] for r in got], dtype=np.float64)
    order = np.argsort(patterns)
    labels = estimate(patterns[order], counts[order])
    n = counts.sum()
    at = F.xxhash64("text", F.lit("quality"))
    marked = text.select(at.alias("at"), "text")
    picked = marked.distinct() if n <= max_training else sampled(marked, F.col("at"), int(n), max_training).dropDuplicates(["at"])
    rows = picked.mapInArrow(_sampled, "at bigint, pattern bigint, columns binary, values binary")
    w = rows.repartition(1).sortWithinPartitions("at", "columns").mapInArrow(_learn(labels, epochs), "weights binary").first()
    return QualityModel(labels, np.frombuffer(w["weights"], dtype=np.float64) if w else np.zeros(DIMENSIONS))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """``docs`` with the scorer's probability that the whole text is good."""
    rows = shielded(docs)
    names, at = rows.columns, rows.columns.index(place(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([model.score(t) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*names, out])

    return unshielded(rows.mapInArrow(run, rows.withColumn(out, F.lit(0.0).cast("double")).schema), docs.columns, out)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, kept`` per row; kept where the score reaches the threshold.

    A null or empty text has no words and is judged by the bias and its empty bins, like
    any very short text: nothing speaks against it. Repeated rows score alike. An empty
    table gives an empty table. Columns of the input other than these two aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = score(rows, fit(rows)).select("doc_id", F.col("quality_score").alias("score"))
    return out.withColumn("kept", F.col("score") >= threshold)
