"""Pairwise correlations of many factors, day by day, from masked products of one packed matrix a day.

With a day's values X (0 where there is none) and their mask M, the sums that a pairwise correlation needs are products: M'M counts the rows that have both
factors, X'M and (X * X)'M sum one factor over the rows that have the other as well, X'X sums the products. Columns are centred first, so nothing cancels. Ranks
depend on the rows that count: factors with the same mask are ranked together once, and only pairs of unlike masks are ranked anew, on the rows of both.

A day is one group: a row a ticker. What leaves a day is one packed row, tasks add up theirs, and a split's sums meet once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.maths import clean
from larkspur.operators.panel import KEYS

METHODS = ("pearson", "spearman")
FLAT = 1e-9  # a variance below this share of the mean square is looked at value by value


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 down each column, ties at their mean. No NaN."""
    n = len(x)
    order = np.argsort(x, axis=0, kind="stable")
    ordered = np.take_along_axis(x, order, axis=0)
    place = np.arange(n)[:, None]
    opens = np.ones(x.shape, dtype=bool)
    opens[1:] = ordered[1:] != ordered[:-1]
    closes = np.ones(x.shape, dtype=bool)
    closes[:-1] = opens[1:]
    first = np.maximum.accumulate(np.where(opens, place, 0), axis=0)
    last = np.minimum.accumulate(np.where(closes, place, n)[::-1], axis=0)[::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2.0 + 1.0, axis=0)
    return out


def _one(a: np.ndarray, b: np.ndarray) -> float:
    """Correlation of two columns without NaN; NaN where one is constant."""
    if a.min() == a.max() or b.min() == b.max():
        return np.nan
    a, b = a - a.mean(), b - b.mean()
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def pearson(x: np.ndarray, least: int) -> np.ndarray:
    """Pairwise correlations of the columns of x (NaN: no value); NaN under `least` common rows or where a side is constant on them."""
    there = ~np.isnan(x)
    count = there.sum(axis=0)
    centre = np.where(there, x, 0.0).sum(axis=0) / np.maximum(count, 1)
    v, m = np.where(there, x - centre, 0.0), there.astype(float)
    n = m.T @ m
    with np.errstate(invalid="ignore", divide="ignore"):
        mean, square = (v.T @ m) / n, ((v * v).T @ m) / n
        spread = square - mean * mean
        out = ((v.T @ v) / n - mean * mean.T) / np.sqrt(spread * spread.T)
    out[n < least] = np.nan
    # Cancellation could pass for spread: such pairs are few and are computed from their values.
    scale = np.maximum(square, (centre * centre)[:, None])
    doubtful = (n >= least) & ((spread <= FLAT * scale) | (spread <= FLAT * scale).T)
    for a, b in zip(*np.nonzero(np.triu(doubtful, 1)), strict=True):
        both = there[:, a] & there[:, b]
        out[a, b] = out[b, a] = _one(x[both, a], x[both, b])
    return out


def spearman(x: np.ndarray, least: int) -> np.ndarray:
    """Pairwise correlations of the ranks among the rows that have both."""
    there = ~np.isnan(x)
    out = np.full((x.shape[1], x.shape[1]), np.nan)
    alike: dict[bytes, list[int]] = {}
    for j in range(x.shape[1]):
        alike.setdefault(there[:, j].tobytes(), []).append(j)
    groups = list(alike.values())
    for i, a in enumerate(groups):
        for b in groups[i:]:
            both = there[:, a[0]] & there[:, b[0]]
            n = int(both.sum())
            if n < least:
                continue
            ranks = [average_ranks(x[np.ix_(both, g)]) - (n + 1) / 2.0 for g in ((a, b) if a is not b else (a,))]
            left, right = ranks[0], ranks[-1]
            with np.errstate(invalid="ignore", divide="ignore"):
                c = (left.T @ right) / np.sqrt(np.outer((left * left).sum(axis=0), (right * right).sum(axis=0)))
            out[np.ix_(a, b)], out[np.ix_(b, a)] = c, c.T
    return out


KINDS = {"pearson": pearson, "spearman": spearman}


def pairwise(panel: DataFrame, factors: list[str], methods: tuple[str, ...] = METHODS, least: int = 10) -> DataFrame:
    """split, method, factor_a, factor_b (a before b in the list), corr: the mean over dates of the pairwise correlation, NULL where no date has one.

    A date counts if at least `least` of its rows have some factor; a pair has a row if some row of such a date has both. Rows outside of all splits do not count.
    """
    upper = np.triu_indices(len(factors), 1)
    size, kinds = len(upper[0]), len(methods)
    x = panel.where("split IS NOT NULL").select("split", KEYS[0], *[clean(f"`{f}`").alias(f"_x{i}") for i, f in enumerate(factors)])

    def day(rows: pa.Table) -> pa.Table:
        values = np.column_stack([rows.column(i).to_numpy().astype(float) for i in range(2, 2 + len(factors))])
        there = ~np.isnan(values)
        packed = []
        if there.any(axis=1).sum() >= least:
            m = there.astype(np.float32)
            seen = (m.T @ m)[upper] > 0
            corr = np.array([KINDS[k](values, least)[upper] for k in methods])
            packed = [np.concatenate([seen.astype(float), np.nan_to_num(corr).ravel(), (~np.isnan(corr)).astype(float).ravel()]).tobytes()]
        return pa.table({"split": rows.column(0)[: len(packed)], "sums": pa.array(packed, pa.binary())})

    def added(bodies: Iterable[bytes]) -> np.ndarray:
        total = np.zeros(size * (1 + 2 * kinds))
        for b in bodies:
            total += np.frombuffer(b)
        return total

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for split, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[split] = added([body.as_py()]) + held.get(split, 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["split", "sums"])

    def whole(rows: pa.Table) -> pa.Table:
        total = added(b.as_py() for b in rows.column(1))
        seen, sums, counts = total[:size] > 0, total[size : size * (1 + kinds)].reshape(kinds, size), total[size * (1 + kinds) :].reshape(kinds, size)
        at = np.flatnonzero(seen)
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = (sums / counts)[:, at]
        names = np.array(factors, dtype=object)
        return pa.table({
            "split": pa.array([rows.column(0)[0].as_py()] * (kinds * len(at)), pa.string()), "method": pa.array(np.repeat(np.array(methods, dtype=object), len(at)), pa.string()),
            "factor_a": pa.array(np.tile(names[upper[0][at]], kinds), pa.string()), "factor_b": pa.array(np.tile(names[upper[1][at]], kinds), pa.string()),
            "corr": pa.array(corr.ravel(), pa.float64(), from_pandas=True),
        })

    days = x.groupBy("split", KEYS[0]).applyInArrow(day, "split string, sums binary")
    return days.mapInArrow(task, "split string, sums binary").groupBy("split").applyInArrow(whole, "split string, method string, factor_a string, factor_b string, corr double")


def matrix(pairs: DataFrame, factors: list[str]) -> DataFrame:
    """factor and a column for each factor: the pairs both ways round, 1 on the diagonal."""
    both = pairs.select("factor_a", "factor_b", "corr").unionByName(pairs.select(F.col("factor_b").alias("factor_a"), F.col("factor_a").alias("factor_b"), "corr"))
    return both.groupBy(F.col("factor_a").alias("factor")).agg(*[F.max(F.when(F.col("factor_a") == f, F.lit(1.0)).when(F.col("factor_b") == f, F.col("corr"))).alias(f) for f in factors])
