"""DartMinHash signatures of weighted sets, one set at a time. Numpy only.

The weight axis of an element is cut into regions [0, 1), [1, 2), [2, 4), [4, 8), ... Darts hit a region at hashed
exponential ranks whose rate is the region's width, each at a hashed place in it; a dart counts for a set if its place lies
below the element's weight there. So two sets see the same darts where their weights agree, and the earliest dart of a
coordinate is the same in both with probability sum(min) / sum(max) of the weights. Only darts up to a rank of about
(k ln k + 2k) / total weight are looked at: enough for each of the k coordinates to have one, whatever the set's size.
If one has none, the limit is doubled.
"""

from __future__ import annotations

import math

import numpy as np

from larkspur.llm.wordhash import mix, unit

_U = np.uint64
STEP, PLACE, SPLIT = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)


def darts(elements: np.ndarray, weights: np.ndarray, limit: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinate, rank and id of every dart with a rank up to `limit`."""
    coordinates, ranks, ids = [], [], []
    low, high, region = 0.0, 1.0, 0
    while True:
        inside = weights > low
        if not inside.any():
            break
        base = mix(elements[inside] + np.multiply([_U(region)], SPLIT))
        top = weights[inside]
        width = high - low
        expected = limit * width
        m = math.ceil(expected + 3 * math.sqrt(expected)) + 1
        at, done = np.zeros(len(base)), 0
        while len(base):
            dart = mix(base[:, None] + (np.arange(done, done + m, dtype=np.uint64) + _U(1)) * STEP)
            waits = -np.log(unit(mix(dart ^ PLACE))) / width
            waits[:, 0] += at
            rank = np.cumsum(waits, axis=1)
            hit = rank <= limit
            if width > 1 or not (top >= high).all():
                hit &= low + width * unit(mix(dart + PLACE)) < top[:, None]
            row, col = np.nonzero(hit)
            ids.append(dart[row, col])
            ranks.append(rank[row, col])
            going = rank[:, -1] <= limit
            base, top, at, done = base[going], top[going], rank[going, -1], done + m
        low, high, region = high, high * 2, region + 1
    ids, ranks = np.concatenate(ids), np.concatenate(ranks)
    return (ids % _U(k)).astype(np.int64), ranks, ids


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """The id of the earliest dart of each of the k coordinates, as 32 bits. The set must not be empty."""
    total = float(weights.sum())
    limit = (k * math.log(k) + 2 * k) / total
    while True:
        coordinate, rank, ids = darts(elements, weights, limit, k)
        out = np.zeros(k, dtype=np.uint64)
        full = np.zeros(k, dtype=bool)
        order = np.argsort(-rank, kind="stable")
        out[coordinate[order]] = ids[order]
        full[coordinate] = True
        if full.all():
            return (out >> _U(32)).astype(np.uint32)
        limit *= 2


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min) / sum(max) of two weighted sets: (sorted different elements, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    whole = float(a[1].sum()) + float(b[1].sum()) - both
    return both / whole if whole else 1.0
