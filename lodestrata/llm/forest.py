"""Union-find over integer positions in bulk numpy steps, for use inside one task."""

from __future__ import annotations

import numpy as np


class Forest:
    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while True:
            up = self.parent[root]
            if np.array_equal(up, root):
                return root
            root = up

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each position that is not a root, with its root."""
        every = np.arange(self.parent.size, dtype=np.int64)
        root = self.find(every)
        low = root != every
        return every[low], root[low]
