"""Union-find within a task."""

from __future__ import annotations

import numpy as np


class Groups:
    """Union-find over positions, many pairs at a time."""

    def __init__(self, size: int):
        self.root = np.arange(size)

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        while True:
            a, b = self.root[p], self.root[q]
            apart = a != b
            if not apart.any():
                return
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]
