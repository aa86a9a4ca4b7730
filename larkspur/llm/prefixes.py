"""Pairs of weighted sets that may be alike, by what they have rarest: a join that never loses a pair.

All sets order their elements alike, the rarest first. Two sets of n and m elements (n <= m, an element of weight w counts as w elements) whose similarity is t at least share
t / (1 + t) * (n + m) of them, so the first one that they share is among the first n - ceil(2t / (1 + t) * n) + 1 of the smaller set and among the first m - ceil(t * m) + 1 of the larger
one, and from there on both have enough left. What many sets share, such as a passage that stands in all of them, is at the end of each, so sets that have only that in common do not meet.

How rare an element is is counted in BINS hashed bins, which is enough: any order that all sets share is right, a better one only joins fewer pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.store import cut, released
from larkspur.llm.wordhash import mix

BINS, SUMS = 1 << 16, 16
_U = np.uint64
OCCURRENCE = _U(0x9E3779B97F4A7C15)
EPS = 1e-9


def bin_of(elements: np.ndarray) -> np.ndarray:
    return (mix(elements) >> _U(48)).astype(np.int64)


def rarity(sets: DataFrame) -> np.ndarray:
    """In how many sets the elements of each bin are. sets: _e (elements as bytes). A task gives one packed row, SUMS tasks add those up, and the driver the rest."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BINS, dtype=np.int64)
        for b in batches:
            for e in b["_e"]:
                total += np.bincount(bin_of(np.frombuffer(e, np.uint64)), minlength=BINS)
        if total.any():
            yield packed(total)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BINS, dtype=np.int64)
        for b in batches:
            for at, n in zip(b["at"], b["n"], strict=True):
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.int64)
        if total.any():
            yield packed(total)

    def packed(total: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(total)
        return pd.DataFrame({"at": [at.astype(np.uint16).tobytes()], "n": [total[at].tobytes()]})

    out = np.zeros(BINS, dtype=np.int64)
    for r in sets.select("_e").mapInPandas(released(count), "at binary, n binary").repartition(SUMS).mapInPandas(add, "at binary, n binary").collect():
        out[np.frombuffer(r["at"], np.uint16)] += np.frombuffer(r["n"], np.int64)
    return out


def prefix(elements: np.ndarray, counts: np.ndarray, rare: np.ndarray, threshold: float) -> tuple[np.ndarray, int, int]:
    """The rarest elements of a set, as many as its larger prefix has, its size, and the length of the smaller prefix."""
    times = counts.astype(np.int64)
    n = int(times.sum())
    nth = np.arange(n) - np.repeat(np.cumsum(times) - times, times)
    tokens = mix(np.repeat(elements, times) + nth.astype(np.uint64) * OCCURRENCE)
    order = np.lexsort((tokens, np.repeat(rare[bin_of(elements)], times)))
    probe = n - int(np.ceil(threshold * n - EPS)) + 1
    index = n - int(np.ceil(2 * threshold / (1 + threshold) * n - EPS)) + 1
    return tokens[order[:probe]], n, index


def pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b of every two sets of different labels that may be alike, a < b. sets: _id, _label, _e, _c (counts as float32 bytes), read twice."""
    rare = rarity(sets)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, label, e, c in zip(b["_id"], b["_label"], b["_e"], b["_c"], strict=True):
                tokens, n, index = prefix(np.frombuffer(e, np.uint64), np.frombuffer(c, np.float32), rare, threshold)
                place = np.arange(len(tokens), dtype=np.int32)
                yield pd.DataFrame({"token": tokens.view(np.int64), "id": i, "label": label, "n": np.int32(n), "place": place, "index": place < index})

    rows = cut(sets.select("_id", "_label", "_e", "_c").mapInPandas(released(run), "token long, id long, label long, n int, place int, index boolean"))
    x, y = rows.where("index").alias("x"), rows.alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.id") < F.col("y.id")))
    left = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    enough = (left + EPS >= threshold / (1 + threshold) * (F.col("x.n") + F.col("y.n"))) & (F.col("x.n") + EPS >= threshold * F.col("y.n"))
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & smaller & enough & (F.col("x.label") != F.col("y.label")))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
