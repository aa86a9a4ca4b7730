"""A forest of random-projection trees over a bounded sample, and the shared priority queue that searches it. Numpy only."""

from __future__ import annotations

import heapq

import numpy as np


def direction(points: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """A unit vector along the line between two random points; zero if they are equal."""
    a, b = points[random.choice(len(points), 2, replace=False)]
    size = np.sqrt((a - b) @ (a - b))
    return (a - b) / size if size > 0 else a - b


class Forest:
    """`trees` perfect binary trees of `depth` levels. A node halves its sample along the line between two random points of it."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int):
        random = np.random.default_rng(seed)
        nodes = (1 << depth) - 1
        self.trees, self.depth = trees, depth
        self.normals = np.zeros((trees, nodes, sample.shape[1]), dtype=np.float64)
        self.offsets = np.zeros((trees, nodes), dtype=np.float64)
        for t in range(trees):
            parts = {0: np.arange(len(sample))}
            for node in range(nodes):
                rows = parts.pop(node)
                if len(rows) > 1:
                    normal = direction(sample[rows], random)
                    self.normals[t, node] = normal
                    self.offsets[t, node] = np.median(sample[rows] @ normal)
                along = sample[rows] @ self.normals[t, node] - self.offsets[t, node]
                left = along < 0
                parts[2 * node + 1], parts[2 * node + 2] = rows[left], rows[~left]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree: (rows, trees)."""
        out = np.zeros((len(x), self.trees), dtype=np.int32)
        for t in range(self.trees):
            along = x @ self.normals[t].T - self.offsets[t]
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (along[np.arange(len(x)), node] >= 0)
            out[:, t] = node - ((1 << self.depth) - 1)
        return out

    def probes(self, query: np.ndarray, count: int) -> list[tuple[int, int]]:
        """The (tree, leaf) pairs that one queue over all trees reaches first.

        A branch's priority is the least signed margin on its path: positive on the query's side of a hyperplane,
        negative beyond it. The branch with the highest goes first, whatever its tree.
        """
        margin = self.normals @ query - self.offsets
        first = (1 << self.depth) - 1
        queue = [(-np.inf, t, 0) for t in range(self.trees)]
        out = []
        while queue and len(out) < count:
            lost, t, node = heapq.heappop(queue)
            while node < first:
                m = margin[t, node]
                near, far = (2 * node + 2, 2 * node + 1) if m >= 0 else (2 * node + 1, 2 * node + 2)
                heapq.heappush(queue, (max(lost, abs(m)), t, far))
                lost, node = max(lost, -abs(m)), near
                if queue[0][0] < lost:
                    heapq.heappush(queue, (lost, t, node))
                    break
            else:
                out.append((t, node - first))
        return out
