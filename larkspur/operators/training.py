"""Rank-loss training of a factor network by data-parallel gradient descent.

Spark sums the gradient: each task works through whole dates and gives one packed row, and the driver adds those up and takes an AdamW step on a few thousand weights. The loss of
a batch of dates is made of means over its dates (correlation with the rank label, too small a spread) and rows (Huber), so their gradients add up, with the counts
they are divided by. After each epoch the network is judged by its mean daily rank correlation on the valid split.

Tables of dates are written once, split by batch, so a step reads the files of its batch. Dropout draws from a hash of seed, step and date, and a task's
rows are added up in order: two runs give equal weights.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import evaluation
from larkspur.operators.inference import erf
from larkspur.operators.panel import KEYS
from larkspur.operators.pipelines import batches_by_date, evaluate_predictions, rank_loss_panel

EPS = 1e-8
SUMS = 16  # tasks that add up other tasks' rows


@dataclass(frozen=True)
class Config:
    """The defaults of the baseline."""

    hidden: int = 64
    dropout: float = 0.1
    batch_dates: int = 16
    epochs: int = 100
    patience: int = 10
    rate: float = 1e-3
    decay: float = 1e-4
    weights: tuple[float, float, float] = (0.7, 0.2, 0.1)  # correlation, Huber, spread
    least_spread: float = 0.05
    seed: int = 42
    every: int = 20


Params = list[np.ndarray]


def initial(inputs: int, config: Config) -> Params:
    """Weights and biases of three layers, uniform within 1 / sqrt(inputs) of the layer."""
    rng = np.random.default_rng(config.seed)
    out = []
    for a, b in ((inputs, config.hidden), (config.hidden, config.hidden), (config.hidden, 1)):
        out += [rng.uniform(-1, 1, (b, a)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)]
    return out


def _gelu(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The activation and its slope."""
    below = 0.5 * (1.0 + erf(z / np.sqrt(2.0)))
    return z * below, below + z * np.exp(-0.5 * z * z) / np.sqrt(2.0 * np.pi)


def forward(params: Params, x: np.ndarray, masks: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple]:
    """Predictions of rows, and what their gradients need."""
    w1, b1, w2, b2, w3, b3 = params
    a1, s1 = _gelu(x @ w1.T + b1)
    m1, m2 = masks or (1.0, 1.0)
    a1 = a1 * m1
    a2, s2 = _gelu(a1 @ w2.T + b2)
    a2 = a2 * m2
    return (a2 @ w3.T + b3)[:, 0], (x, a1, s1 * m1, a2, s2 * m2)


def backward(params: Params, held: tuple, slope: np.ndarray) -> np.ndarray:
    """The gradient of a loss with the given slope in each prediction, as one vector."""
    _, _, w2, _, w3, _ = params
    x, a1, s1, a2, s2 = held
    g = slope[:, None]
    d2 = (g @ w3) * s2
    d1 = (d2 @ w2) * s1
    return np.concatenate([(d1.T @ x).ravel(), d1.sum(axis=0), (d2.T @ a1).ravel(), d2.sum(axis=0), (g.T @ a2).ravel(), g.sum(axis=0)])


def slopes(p: np.ndarray, rank: np.ndarray, z: np.ndarray, least_spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one date: the values of (correlation, Huber, spread), what they count as, and their slopes in the predictions (3 x rows)."""
    value, count, slope = np.zeros(3), np.zeros(3), np.zeros((3, len(p)))
    there = np.isfinite(rank)
    if there.sum() >= 3:
        n = there.sum()
        a, b = p[there] - p[there].mean(), rank[there] - rank[there].mean()
        sa, sb = np.sqrt((a * a).mean()), np.sqrt((b * b).mean())
        if sa > EPS and sb > EPS:
            cov, d = (a * b).mean(), sa * sb + EPS
            value[0], count[0] = cov / d, 1
            slope[0, there] = b / n / d - cov / d**2 * sb * a / (n * sa)
    n = len(p)
    a = p - p.mean()
    s = np.sqrt((a * a).mean())
    there = np.isfinite(z)
    gap = np.where(there, (a / (s + EPS) if s > EPS else 0.0 * a) - np.where(there, z, 0.0), 0.0)
    value[1], count[1] = np.where(np.abs(gap) <= 1.0, 0.5 * gap * gap, np.abs(gap) - 0.5).sum(), there.sum()
    if s > EPS:
        u = np.clip(gap, -1.0, 1.0)
        slope[1] = (u - u.mean()) / (s + EPS) - (u @ a) / (s + EPS) ** 2 * a / (n * s)
    if n >= 2:
        short = max(0.0, least_spread - s)
        value[2], count[2] = short * short, 1
        if short and s > 0:
            slope[2] = -2.0 * short * a / (n * s)
    return value, count, slope


def date_sums(params: Params, x: np.ndarray, rank: np.ndarray, z: np.ndarray, config: Config, step: int | None = None, day: int = 0) -> np.ndarray:
    """One date's part of a packed row: three values, three counts, three gradients. step: draws dropout; None: none."""
    masks = None
    if step is not None and config.dropout:
        rng = np.random.default_rng([config.seed, step, day])
        masks = tuple((rng.random((len(x), config.hidden)) >= config.dropout) / (1.0 - config.dropout) for _ in range(2))
    p, held = forward(params, x, masks)
    value, count, slope = slopes(p, rank, z, config.least_spread)
    return np.concatenate([value, count, *[backward(params, held, s) for s in slope]])


def combined(sums: np.ndarray, config: Config) -> tuple[np.ndarray, dict[str, float]]:
    """Gradient and losses of a batch from its summed row."""
    value, count = sums[:3], np.maximum(sums[3:6], 1.0)
    grads = sums[6:].reshape(3, -1) / count[:, None]
    ic, huber, spread = 1.0 - value[0] / count[0], value[1] / count[1], value[2] / count[2]
    a, b, c = config.weights
    return -a * grads[0] + b * grads[1] + c * grads[2], {"total_loss": a * ic + b * huber + c * spread, "ic_loss": ic, "huber_loss": huber, "variance_penalty": spread}


@dataclass
class AdamW:
    """Decoupled weight decay, moments of the usual rates."""

    config: Config
    steps: int = 0
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0

    def step(self, params: Params, grad: np.ndarray) -> Params:
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * grad
        self.second = 0.999 * self.second + 0.001 * grad * grad
        move = self.first / (1 - 0.9**self.steps) / (np.sqrt(self.second / (1 - 0.999**self.steps)) + EPS)
        flat = np.concatenate([p.ravel() for p in params])
        return unpacked(flat * (1.0 - self.config.rate * self.config.decay) - self.config.rate * move, params)


def unpacked(flat: np.ndarray, like: Params) -> Params:
    out, at = [], 0
    for p in like:
        out.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    return out


DAY = "day int, rows int, body binary"


def packed_days(panel: DataFrame, factors: list[str]) -> DataFrame:
    """batch, day, rows, body: every date of a panel with labels as one matrix of factors (missing ones 0), rank and z label. A date has a row a ticker."""
    x = panel.select("batch", F.unix_date("date").alias("day"), "ticker", *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(factors)], "y_rank", "y_z")

    def pack(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[("ticker", "ascending")])
        rows = rows.take(order)
        body = np.column_stack([rows.column(i).to_numpy().astype(float) for i in range(3, rows.num_columns)])
        return pa.table({"batch": rows.column(0)[:1], "day": rows.column(1)[:1], "rows": pa.array([rows.num_rows], pa.int32()), "body": pa.array([body.tobytes()])})

    return x.groupBy("batch", "day").applyInArrow(pack, f"batch int, {DAY}")


def batch_sums(days: DataFrame, params: Params, config: Config, step: int | None) -> np.ndarray:
    """The packed row of a batch: tasks add up their dates, SUMS tasks add up tasks, the driver the rest, each in order."""
    size = 6 + 3 * sum(p.size for p in params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros(size), None
        rows = sorted(((d, n, b.as_py()) for batch in batches for d, n, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)), key=lambda r: r[0])
        for day, n, body in rows:
            m = np.frombuffer(body).reshape(n, -1)
            total += date_sums(params, m[:, :-2], m[:, -2], m[:, -1], config, step, day)
            first = day if first is None else first
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()])], names=["first", "sums"])

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for _, b in sorted(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)):
            total += np.frombuffer(b)
        return pa.table({"first": pa.array([pc.min(rows.column(1)).as_py()], pa.int32()), "sums": pa.array([total.tobytes()])})

    parts = days.select("day", "rows", "body").mapInArrow(run, "first int, sums binary")
    whole = parts.select(F.pmod("first", F.lit(SUMS)).alias("_g"), "first", "sums").groupBy("_g").applyInArrow(added, "first int, sums binary")
    total = np.zeros(size)
    for r in sorted(whole.collect(), key=lambda r: r["first"]):
        total += np.frombuffer(r["sums"])
    return total


def predict(df: DataFrame, factors: list[str], params: Params, out: str = "pred") -> DataFrame:
    """df with the network's predictions; a missing factor counts as 0."""
    @F.pandas_udf("double")
    def score(x):
        import pandas as pd

        rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(factors)))
        return pd.Series(forward(params, rows)[0])

    return df.withColumn(out, score(F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in factors])))


@dataclass
class Trained:
    params: Params
    factors: list[str]
    best_epoch: int
    history: list[dict[str, Any]] = field(default_factory=list)


def valid_rank_ic(valid: DataFrame, factors: list[str], params: Params) -> tuple[float | None, float | None]:
    """Mean daily rank correlation and correlation on the valid split."""
    ic = evaluation.daily_ic(predict(valid, factors, params), "pred", "label")
    row = ic.agg(F.avg("RankIC").alias("r"), F.avg("IC").alias("i")).first()
    return row["r"], row["i"]


def train(panel: DataFrame, root: str, label: str, factors: list[str], config: Config = Config()) -> Trained:
    """Fit the network on the train split; the weights are those of the epoch with the best rank correlation on the valid split, which also ends training after `patience` epochs without a better one.

    panel: date, ticker, split, label and factors. The days are written under root, a folder that all executors reach.
    """
    spark = panel.sparkSession
    ready = rank_loss_panel(panel, label, factors).where("label IS NOT NULL AND y_rank IS NOT NULL AND y_z IS NOT NULL")
    where = f"{root.rstrip('/')}/days.parquet"
    packed_days(batches_by_date(ready.where("split = 'train'"), config.batch_dates, True, config.seed), factors).write.partitionBy("batch").mode("overwrite").parquet(where)
    ready.where("split = 'valid'").write.mode("overwrite").parquet(f"{root.rstrip('/')}/valid.parquet")
    days, valid = spark.read.schema(f"{DAY}, batch int").parquet(where), spark.read.parquet(f"{root.rstrip('/')}/valid.parquet")
    batches = sorted(r["batch"] for r in days.select("batch").distinct().collect())
    params, adam = initial(len(factors), config), AdamW(config)
    best = Trained(copy.deepcopy(params), list(factors), 0)
    top, idle = None, 0
    for epoch in range(1, config.epochs + 1):
        losses: list[dict[str, float]] = []
        for batch in np.random.default_rng([config.seed, epoch]).permutation(batches).tolist():
            grad, loss = combined(batch_sums(days.where(F.col("batch") == batch), params, config, adam.steps), config)
            params = adam.step(params, grad)
            losses.append(loss)
        rank_ic, ic = valid_rank_ic(valid, factors, params)
        improved = rank_ic is not None and (top is None or rank_ic > top + 1e-8)
        if improved:
            top, idle, best.params, best.best_epoch = rank_ic, 0, copy.deepcopy(params), epoch
        else:
            idle += 1
        best.history.append({"epoch": epoch} | {k: float(np.mean([x[k] for x in losses])) if losses else None for k in ("total_loss", "ic_loss", "huber_loss", "variance_penalty")} | {"valid_RankIC": rank_ic, "valid_IC": ic, "improved": improved})
        if idle >= config.patience:
            break
    return best


def evaluated(panel: DataFrame, label: str, model: Trained, every: int = 20) -> dict[str, DataFrame]:
    """Predictions of all rows of the splits (split, date, ticker, label, pred), and each split's fifteen measures."""
    scored = predict(rank_loss_panel(panel, label, model.factors), model.factors, model.params).select("split", *KEYS, "label", "pred").where("split IS NOT NULL")
    metrics = None
    for s in ("train", "valid", "test"):
        one = evaluate_predictions(scored.where(F.col("split") == s).drop("split"), every).withColumn("split", F.lit(s))
        metrics = one if metrics is None else metrics.unionByName(one)
    return {"predictions": scored, "metrics": metrics}
