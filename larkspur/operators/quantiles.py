"""Exact quantiles of a column in few passes and bounded memory."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.maths import clean

RANGES = 1024
HELD = 16_384  # values that a wanted range may have before it is collected


def _counted(values: DataFrame, edges: np.ndarray) -> np.ndarray:
    """How many values lie in each range from an edge (inclusive) to the next; every task sums its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(edges), dtype=np.int64)
        for b in batches:
            at = np.searchsorted(edges, b.column(0).to_numpy(zero_copy_only=False), side="right") - 1
            total += np.bincount(at[at >= 0], minlength=len(edges))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["at", "n"])

    out = np.zeros(len(edges), dtype=np.int64)
    for r in values.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def _between(low: float, high: float) -> Column:
    return (F.col("v") >= low) & (F.col("v") < high)


def _cut(low: float, high: float, ranges: int) -> list[float]:
    """Edges of about equal distance; the least value and the middle are always parted from the rest."""
    step = high / ranges - low / ranges
    return [low, *[x for x in [math.nextafter(low, math.inf), low / 2 + high / 2, *[low + i * step for i in range(1, ranges)]] if low < x < high]]


def exact_quantiles(df: DataFrame, column: str, probs: list[float], ranges: int = RANGES, held: int = HELD) -> dict[str, float | int | list[float] | None]:
    """n, mean, std (population) and the quantiles (linear between ranks, None without values) of a column's finite values.

    The first pass sketches where the values lie, and so picks ranges of about equal numbers. The second counts them exactly. The third collects the different values of
    those ranges, one or two for each quantile, that hold a wanted rank. A wanted range with more than `held` values is cut into `ranges` once more
    before that, and again if need be: a pass each time, which takes 16 million times as many rows.
    """
    values = df.select(clean(column).alias("v")).where("v IS NOT NULL")
    probes = [i / ranges for i in range(ranges + 1)]
    top = values.agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v", probes, 4 * ranges).alias("probes")).first()
    n = top["n"]
    out = {"n": n, "mean": top["mean"], "std": top["std"], "quantiles": [None] * len(probs)}
    if n == 0:
        return out
    places = [(n - 1) * p for p in probs]
    wanted = sorted({f(x) for x in places for f in (math.floor, math.ceil)})
    end = math.nextafter(top["high"], math.inf)
    # Ranges with a wanted rank: low, high (exclusive), how many values lie below, how many inside.
    todo: list[tuple[float, float, int, int | None]] = [(top["low"], end, 0, None)]
    cuts = {(top["low"], end): [top["low"], *top["probes"]]}
    ready: list[tuple[float, float, int]] = []
    while todo:
        edges = np.unique(np.array([e for low, high, *_ in todo for e in [*cuts[low, high], high]] + [end]))
        inside = values
        if todo[0][3] is not None:
            some = F.lit(False)
            for low, high, *_ in todo:
                some = some | _between(low, high)
            inside = values.where(some)
        counts = _counted(inside, edges)
        following = []
        for low, high, below, _ in todo:
            for i in range(int(np.searchsorted(edges, low)), int(np.searchsorted(edges, high))):
                a, b, many = float(edges[i]), float(edges[i + 1]), int(counts[i])
                if any(below <= k < below + many for k in wanted):
                    if many <= held or math.nextafter(a, math.inf) >= b:
                        ready.append((a, b, below))
                    else:
                        following.append((a, b, below, many))
                        cuts[a, b] = _cut(a, b, ranges)
                below += many
        todo = following
    some = F.lit(False)
    for low, high, _ in ready:
        some = some | _between(low, high)
    known = sorted((r["v"], r["n"]) for r in values.where(some).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect())
    found: dict[int, float] = {}
    for low, high, below in ready:
        for v, many in known:
            if low <= v < high:
                found.update({k: v for k in wanted if below <= k < below + many})
                below += many
    out["quantiles"] = [found[math.floor(x)] if x == math.floor(x) else (math.ceil(x) - x) * found[math.floor(x)] + (x - math.floor(x)) * found[math.ceil(x)] for x in places]
    return out
