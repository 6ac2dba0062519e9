"""Word hashes of whole texts in bulk numpy steps, and a sparse FTRL-proximal learner."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_MAX_POWER = 1 << 16
_POWERS = np.concatenate(([np.uint64(1)], np.cumprod(np.full(_MAX_POWER - 1, _P, dtype=np.uint64), dtype=np.uint64)))
_SLICE = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT = _SPACE.copy()
_PUNCT[[b for b in range(128) if not chr(b).isalnum()]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _runs(raw: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words between bytes that ``part`` marks."""
    word = ~part[raw]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2] - edge[::2]


def slices(text: bytes):
    """Pieces of about a megabyte that end at white space, so memory doesn't grow with a text."""
    at = 0
    while at < len(text):
        to = min(len(text), at + _SLICE)
        while to < len(text) and text[to] not in b" \t\n\r\v\f":
            to += 1
        yield text[at:to]
        at = to


def _hash(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not starts.size:
        return np.empty(0, dtype=np.uint64)
    inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    v = values[np.repeat(starts, lengths) + inside].astype(np.uint64) + np.uint64(1)
    v *= _POWERS[inside & (_MAX_POWER - 1)]
    return mix(np.add.reduceat(v, np.cumsum(lengths) - lengths))


def word_hashes(text: bytes, punctuation_parts: bool = True, head: int = 0) -> np.ndarray:
    """A hash per word in order; ``head``: of the first bytes of each word only."""
    out = []
    for piece in slices(text):
        raw = np.frombuffer(piece, dtype=np.uint8)
        starts, lengths = _runs(raw, _PUNCT if punctuation_parts else _SPACE)
        out.append(_hash(raw, starts, np.minimum(lengths, head) if head else lengths))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


class Ftrl:
    """FTRL-proximal logistic regression: per-coordinate rates, L1 and L2; column 0 is the bias."""

    def __init__(self, size: int, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = weight * (p - y) * x
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


class SparseWeights:
    """Nonzero weights by hash; a bitmap over the low bits turns most lookups away."""

    _BITS = np.uint64((1 << 20) - 1)

    def __init__(self, keys: np.ndarray, values: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.values, self.bias = keys[order], values[order], bias
        self.map = np.zeros(int(self._BITS) + 1, dtype=bool)
        self.map[(keys & self._BITS).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``h`` that have a weight, and the weights."""
        near = np.flatnonzero(self.map[(h & self._BITS).astype(np.int64)])
        if not near.size:
            return near, np.empty(0)
        at = np.searchsorted(self.keys, h[near])
        hit = (at < self.keys.size) & (self.keys[np.minimum(at, self.keys.size - 1)] == h[near])
        return near[hit], self.values[at[hit]]
