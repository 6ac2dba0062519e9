"""URL verdicts: longest-match rules, and gradient-boosted trees where no rule fits.

The trees see lexical features of the url only: lengths, depth, digit ratio, entropy,
parameter counts and smoothed block rates of its host's suffixes. They are trained on
a bounded sample of the urls that the rules label, by histogram splits on the logistic
loss, in one task; every url is judged.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.scratch import sampled

#: (verdict, host and path). A rule fits its host and all subdomains; the longest wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rule-labelled urls that training takes at most, about (chosen by a hash of the url).
MAX_TRAINING = 15_000
TREES, DEPTH, BINS, RATE = 40, 4, 32, 0.3
FEATURES = ("length", "host", "path", "depth", "digits", "entropy", "params", "query", "fragment", "labels", "dashes", "secure", "last_label", "last_two", "first_folder")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last to be laid on top is the longest
        name, slash, rest = text.partition("/")
        fits = (host == name) | F.endswith(host, F.lit("." + name))
        fits = fits & F.startswith(path, F.lit(slash + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _suffixes(host: str, path: str) -> tuple[str, str, str]:
    labels = host.rsplit(".", 2)
    return labels[-1], ".".join(labels[-2:]), path.split("/", 2)[1] if path.startswith("/") else ""


def lexical(url: str | None, host: str, path: str, rates: dict[tuple[int, str], float], base: float) -> list[float]:
    url = url or ""
    n = max(1, len(url))
    query = url.partition("#")[0].partition("?")[2]
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(url).values())
    return [
        len(url), len(host), len(path), path.count("/"), sum(c.isdigit() for c in url) / n, entropy,
        query.count("&") + bool(query), len(query), float("#" in url), host.count("."), url.count("-"), float(url.startswith("https")),
        *(rates.get((k, s), base) for k, s in enumerate(_suffixes(host, path))),
    ]


@dataclass
class Tree:
    """Heap order: node k has children 2k+1 and 2k+2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, binned: np.ndarray) -> np.ndarray:
        at = np.zeros(len(binned), dtype=np.int64)
        for _ in range(DEPTH):
            f = self.feature[at]
            inner = f >= 0
            right = binned[np.arange(len(binned)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return self.value[at]


@dataclass
class UrlModel:
    base: float
    rates: dict[tuple[int, str], float] = field(default_factory=dict)
    prior: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1)

    def score(self, urls: Sequence[tuple[str | None, str, str]]) -> np.ndarray:
        """The chance that each (url, host, path) is to be blocked."""
        margin = np.full(len(urls), self.prior)
        if self.trees and urls:
            binned = self._bin(np.array([lexical(*u, self.rates, self.base) for u in urls], dtype=np.float64))
            for t in self.trees:
                margin += RATE * t.predict(binned)
        return 1 / (1 + np.exp(-margin))


def _split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, l2: float, least: float) -> tuple[float, int, int]:
    best = (1e-9, -1, 0)
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for f in range(binned.shape[1]):
        b = binned[rows, f]
        gl = np.cumsum(np.bincount(b, weights=g[rows], minlength=BINS))[:-1]
        hl = np.cumsum(np.bincount(b, weights=h[rows], minlength=BINS))[:-1]
        gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - total_g**2 / (total_h + l2)
        gain[(hl < least) | (total_h - hl < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    return best


def train(rows: Sequence[tuple], trees: int = TREES, l2: float = 1.0, least: float = 2.0) -> UrlModel:
    """A model from (url, host, path, 1 for block) rows; a fifth element says how often a row occurs."""
    y = np.array([r[3] for r in rows], dtype=np.float64)
    times = np.array([r[4] if len(r) > 4 else 1 for r in rows], dtype=np.float64)
    if not len(y):
        return UrlModel(0.0, prior=-1.0)
    all_, bad = times.sum(), (times * y).sum()
    base = float(bad / all_)
    prior = math.log((bad + 0.5) / (all_ - bad + 0.5))
    seen, blocked = Counter(), Counter()
    for (_, host, path, block, *_), n in zip(rows, times.tolist(), strict=True):
        for key in enumerate(_suffixes(host, path)):
            seen[key] += n
            blocked[key] += n * block
    rates = {k: (blocked[k] + 20 * base) / (n + 20) for k, n in seen.items() if n >= 5}
    x = np.array([lexical(u, h, p, rates, base) for u, h, p, *_ in rows], dtype=np.float64)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS)[1:-1], method="lower")) for k in range(x.shape[1])]
    model = UrlModel(base, rates, prior, edges)
    binned, margin = model._bin(x), np.full(len(y), prior)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = times * (y - p), times * np.maximum(p * (1 - p), 1e-6)
        size = 2 ** (DEPTH + 1) - 1
        t = Tree(np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size))
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            node, at, depth = todo.pop()
            t.value[node] = g[at].sum() / (h[at].sum() + l2)
            gain, f, cut = _split(binned, g, h, at, l2, least) if depth < DEPTH else (0.0, -1, 0)
            if f >= 0:
                t.feature[node], t.cut[node] = f, cut
                right = binned[at, f] > cut
                todo += [(2 * node + 1, at[~right], depth + 1), (2 * node + 2, at[right], depth + 1)]
        if t.feature[0] < 0:
            break
        model.trees.append(t)
        margin += RATE * t.predict(binned)
    return model


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows))], pa.binary())], names=["model"])


def fit(judged: DataFrame, max_training: int = MAX_TRAINING) -> UrlModel:
    """From ``judged(url, host, path, verdict)``; rows without a rule's verdict are left out."""
    known = judged.where("verdict IS NOT NULL AND url IS NOT NULL")
    n = known.count()
    known = sampled(known, F.xxhash64("url", F.lit("url")), n, max_training)
    rows = known.select("url", "host", "path", (F.col("verdict") == "block").cast("int").alias("y"))
    rows = rows.groupBy("url", "host", "path", "y").agg(F.count("*").alias("times"))  # a url's repeats never meet in one task
    got = rows.repartition(1).sortWithinPartitions("url", "y").mapInArrow(_learn, "model binary").first()
    return pickle.loads(got["model"]) if got else train([])


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` per row.

    A null url, or one without ``://``, has an empty host and path; no rule fits it and the
    trees judge it. Repeated rows are judged alike. Without any rule-labelled url nothing
    is blocked by the trees. An empty table gives an empty table.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict)
    model = fit(rows.select("url", "host", "path", "verdict"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = model.score(list(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)))
            said = ["block" if s >= threshold else "allow" for s in got]
            own = [v or s for v, s in zip(b.column(5).to_pylist(), said, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 2, 3, 4)), pa.array(own, pa.string()), pa.array(got, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "score"])

    schema = rows.select("page_id", "host", "path", "rule", "verdict").withColumn("score", F.lit(0.0).cast("double")).schema
    return rows.mapInArrow(run, schema)
