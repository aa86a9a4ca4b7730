"""Closed-form models: ridge regressions from one pass of sums, branches, gates, and the factor built of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.maths import ratio, zscores
from larkspur.operators.diagnostics import linear
from larkspur.operators.panel import KEYS, first_by, keyed, unique_by
from larkspur.operators.quantiles import exact_quantiles

# The registry of baselines.
BASELINES = [
    ("B0", "factor-only ridge"), ("B1", "headline embedding"), ("B2", "mean chunk pooling"), ("B3", "stock-aware chunk attention"), ("B4", "end-to-end mixture"), ("B5", "decoupled gate"),
]
GATE_QUANTILES = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}

SUMS = 16


@dataclass(frozen=True)
class Linear:
    columns: list[str]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        return linear(self.columns, self.weights, self.intercept)


def gram(df: DataFrame, columns: list[str], label: str) -> np.ndarray:
    """Z'Z of Z = [1, columns, label], missing values as 0: each task sums one matrix into one row, SUMS tasks add those up, and the driver the rest."""
    k = len(columns) + 2

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for b in batches:
            z = np.column_stack([np.ones(len(b)), b.to_numpy(dtype=np.float64)])
            total += z.T @ z
        yield pd.DataFrame({"x": [total.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for b in batches:
            for x in b["x"]:
                total += np.frombuffer(x).reshape(k, k)
        yield pd.DataFrame({"x": [total.tobytes()]})

    rows = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate([*columns, label])])
    out = np.zeros((k, k))
    for r in rows.mapInPandas(run, "x binary").repartition(SUMS).mapInPandas(add, "x binary").collect():
        out += np.frombuffer(r["x"]).reshape(k, k)
    return out


def centred_ridge(df: DataFrame, columns: list[str], label: str, alpha: float = 1.0) -> Linear:
    """Ridge on centred columns over the rows with a label; the intercept is not penalised."""
    g = gram(df.where(F.col(label).isNotNull()), columns, label)
    n, k = g[0, 0], len(columns)
    if n == 0:
        raise ValueError("no row has a label")
    mean = g[0, 1:] / n
    c = g[1:, 1:] - n * np.outer(mean, mean)
    w = np.linalg.solve(c[:k, :k] + alpha * np.eye(k), c[:k, k])
    return Linear(columns, w.tolist(), float(mean[k] - mean[:k] @ w))


def bias_ridge(df: DataFrame, columns: list[str], label: str, l2: float = 1e-3) -> Linear:
    """Ridge with an unpenalised constant column, by pseudo-inverse; a missing label counts as 0."""
    g = gram(df, columns, label)
    k = len(columns) + 1
    penalty = l2 * np.eye(k)
    penalty[0, 0] = 0.0
    w = np.linalg.pinv(g[:k, :k] + penalty) @ g[:k, k]
    return Linear(columns, w[1:].tolist(), float(w[0]))


def scaled_ridge(df: DataFrame, columns: list[str], label: str, alpha: float = 1.0) -> Linear:
    """Ridge on columns filled with their mean and scaled by their spread (1 if there is none). The result applies to raw columns filled with 0."""
    there = df.where(F.col(label).isNotNull())
    stats = there.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop), ("c", F.count))], F.count(F.lit(1)).alias("n")).first()
    mean = [stats[f"m{i}"] or 0.0 for i in range(len(columns))]
    # Filling with the mean leaves the sum of squares, over more rows.
    spread = [(stats[f"s{i}"] or 0.0) * (stats[f"c{i}"] / stats["n"]) ** 0.5 or 1.0 for i in range(len(columns))]
    scaled = there.select(label, *[((F.coalesce(F.col(c).cast("double"), F.lit(m)) - m) / s).alias(f"x{i}") for i, (c, m, s) in enumerate(zip(columns, mean, spread, strict=True))])
    inner = centred_ridge(scaled, [f"x{i}" for i in range(len(columns))], label, alpha)
    weights = [w / s for w, s in zip(inner.weights, spread, strict=True)]
    return Linear(columns, weights, inner.intercept - float(np.dot(weights, mean)))


def filled(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """df with missing columns set to their mean in train, as scaled_ridge saw them."""
    stats = train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(stats[c] or 0.0)) for c in columns})


def predict(df: DataFrame, model: Linear, out: str) -> DataFrame:
    return df.withColumn(out, model.score())


def gate_target(factor: str, fusion: str, target: str, temperature: float = 1.0) -> Column:
    """How much the fusion branch's squared error earns against the factor branch's: a softmax of minus the errors."""
    e1, e2 = F.pow(F.col(factor) - F.col(target), F.lit(2.0)), F.pow(F.col(fusion) - F.col(target), F.lit(2.0))
    x = F.greatest(F.least((e2 - e1) / temperature, F.lit(700.0)), F.lit(-700.0))
    return 1.0 / (1.0 + F.exp(x))


def gate(train: DataFrame, columns: list[str], temperature: float = 1.0, l2: float = 1e-3, factor: str = "factor_only_pred", fusion: str = "fusion_pred", target: str = "target") -> Column:
    """The gate's probability: a ridge on the soft targets, then a logistic curve over its prediction."""
    model = bias_ridge(train.withColumn("_gate", gate_target(factor, fusion, target, temperature)), columns, "_gate", l2)
    return 1.0 / (1.0 + F.exp(-model.score()))


def mixed(factor: str, fusion: str, weight: Column | str) -> Column:
    w = F.col(weight) if isinstance(weight, str) else weight
    return (1.0 - w) * F.col(factor) + w * F.col(fusion)


def fixed_mixture(factor: str, fusion: str, weight: float) -> Column:
    return mixed(factor, fusion, F.lit(min(1.0, max(0.0, float(weight)))))


def masked(has_news: str, factor: str, fusion: str, gate_prob: str) -> dict[str, Column]:
    """What the branches say where there is news; without it the factor branch stands and the gate is shut."""
    news = F.col(has_news) > 0.5
    fused = F.when(news, F.col(fusion)).otherwise(F.col(factor))
    shut = F.when(news, F.col(gate_prob)).otherwise(0.0)
    return {"fusion_pred": fused, "gate_news_prob": shut, "mixed_pred": (1.0 - shut) * F.col(factor) + shut * fused}


def assemble(factor: DataFrame, fusion: DataFrame, gates: DataFrame) -> DataFrame:
    """Branch predictions and gate by key, and their mixture."""
    return factor.join(fusion, KEYS).join(gates, KEYS).withColumn("mixed_pred", mixed("factor_only_pred", "fusion_pred", "gate_news_prob"))


def text_alpha(predictions: DataFrame, coverage: DataFrame | None = None, attention: DataFrame | None = None, labels: DataFrame | None = None, label: str = "future_20d_market_adjusted_return") -> DataFrame:
    """The gated difference of the branches, its daily z-score, and what else is known of the stock-day. Of repeated rows the largest counts and the least entropy stand."""
    out = keyed(predictions).withColumn("text_alpha_raw", F.col("gate_news_prob") * (F.col("fusion_pred") - F.col("factor_only_pred")))
    if coverage is not None:
        own = first_by(keyed(coverage).select(*KEYS, "news_count", "chunk_count"), KEYS, F.col("news_count").desc(), F.col("chunk_count").desc())
        out = out.drop("news_count", "chunk_count").join(own, KEYS, "left")
    for c in ("news_count", "chunk_count"):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)) if c in out.columns else F.lit(0))
    if attention is not None:
        out = out.drop("attention_entropy").join(first_by(keyed(attention).select(*KEYS, "attention_entropy"), KEYS, "attention_entropy"), KEYS, "left")
    elif "attention_entropy" not in out.columns:
        out = out.withColumn("attention_entropy", F.lit(None).cast("double"))
    if labels is not None:
        if label not in labels.columns:
            raise KeyError(f"labels lack {label}")
        out = out.drop(label).join(unique_by(keyed(labels).select(*KEYS, label).distinct(), KEYS, "labels"), KEYS, "left")
    scored = zscores(out, {"text_alpha_raw": "text_alpha_zscore"}, "filled")
    first = [*KEYS, "text_alpha_raw", "text_alpha_zscore", "factor_only_pred", "fusion_pred", "gate_news_prob", "mixed_pred", "news_count", "chunk_count", "attention_entropy"]
    return scored.select(*[c for c in first if c in scored.columns], *([label] if labels is not None else []))


def gate_statistics(df: DataFrame, column: str) -> DataFrame:
    """Mean, population spread and five exact quantiles: one row."""
    found = exact_quantiles(df, column, list(GATE_QUANTILES.values()))
    row = (found["mean"], found["std"], *found["quantiles"])
    return df.sparkSession.createDataFrame([row], ", ".join(f"{c} double" for c in ("mean", "std", *GATE_QUANTILES)))


def split_sizes(df: DataFrame, label: str) -> DataFrame:
    """split, rows, rows with news, with a label, with both."""
    news, there = F.col("has_news") > 0, F.col(label).isNotNull()
    return df.where("split IS NOT NULL").groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_if(news).alias("news_rows"), F.count_if(there).alias("labelled_rows"), F.count_if(news & there).alias("labelled_news_rows"))


def rank_loss(df: DataFrame, pred: str, rank: str, z: str, weights: tuple[float, float, float] = (0.7, 0.2, 0.1), least_spread: float = 0.05) -> DataFrame:
    """One row: 1 less the mean daily correlation with the rank label, Huber loss between the date's z-score of the prediction and the z label, the mean square of what a date's spread lacks of `least_spread`, and their weighted sum.

    Correlations need three rows with both. A prediction without spread on its date has z-score 0.
    """
    eps = 1e-8
    by_day = Window.partitionBy("date")
    known = df.where(F.col(pred).isNotNull()).select("date", F.col(pred).cast("double").alias("_p"), F.col(rank).cast("double").alias("_r"), F.col(z).cast("double").alias("_z"))
    spread = known.withColumn("_s", F.stddev_pop("_p").over(by_day)).withColumn("_c", F.col("_p") - F.avg("_p").over(by_day))
    gap = F.abs(F.when(F.col("_s") > eps, F.col("_c") / (F.col("_s") + eps)).otherwise(0.0) - F.col("_z"))
    huber = F.when(gap <= 1.0, 0.5 * gap * gap).otherwise(gap - 0.5)
    p, r = F.when(F.col("_r").isNotNull(), F.col("_p")), F.when(F.col("_p").isNotNull(), F.col("_r"))
    corr = F.when((F.count(r) >= 3) & (F.stddev_pop(p) > eps) & (F.stddev_pop(r) > eps), F.covar_pop(p, r) / (F.stddev_pop(p) * F.stddev_pop(r) + eps))
    short = F.when(F.count("_p") >= 2, F.pow(F.greatest(least_spread - F.max("_s"), F.lit(0.0)), F.lit(2.0)))
    days = spread.groupBy("date").agg(corr.alias("c"), short.alias("s"), F.sum(huber).alias("h"), F.count(huber).alias("n"))
    out = days.agg((1.0 - F.coalesce(F.avg("c"), F.lit(0.0))).alias("ic_loss"), F.coalesce(ratio(F.sum("h"), F.sum("n")), F.lit(0.0)).alias("huber_loss"), F.coalesce(F.avg("s"), F.lit(0.0)).alias("variance_penalty"))
    return out.withColumn("loss", weights[0] * F.col("ic_loss") + weights[1] * F.col("huber_loss") + weights[2] * F.col("variance_penalty"))


def baselines(spark) -> DataFrame:
    return spark.createDataFrame(BASELINES, "name string, description string")
