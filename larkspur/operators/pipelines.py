"""Whole runs made of the other operators: representations, the ridge baseline by split, diagnostics, evaluation, encoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from larkspur.functions.maths import annual_ratio, by_entity, zscores
from larkspur.operators import correlations, diagnostics, evaluation, history, models, sequences, vectors
from larkspur.operators.news import not_yet
from larkspur.operators.panel import KEYS, SPLIT, keyed, long_form, percent_rank_label, require, safe_factor_columns, split_of
from larkspur.sources import tables

LABEL = "future_20d_market_adjusted_return"
# The names of the representation methods in the results.
PROJECTED, RAW = "mean_pool_projection", "mean_pool"


def news_labelled(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Rows with news and a label."""
    return df.where((F.col("has_news") == 1) & F.col(label).isNotNull())


def with_alphas(df: DataFrame, alphas: dict[str, tuple[str, float]] = diagnostics.ALPHAS) -> DataFrame:
    """df with those directional factors that it lacks; KeyError if a source is missing too."""
    missing = {a: x for a, x in alphas.items() if a not in df.columns}
    require(df, [s for s, _ in missing.values()], "panel")
    return df.withColumns({a: F.col(s).cast("double") * sign for a, (s, sign) in missing.items()})


def rank_loss_panel(panel: DataFrame, label: str = LABEL, factors: list[str] | None = None) -> DataFrame:
    """The panel with `label`, `y_rank` (average rank among the date's labels over their number) and `y_z` (their z-score, NULL without spread); the directional factors unless others are named."""
    out = require(keyed(panel if factors else with_alphas(panel)), [label, *(factors or [])], "panel").withColumn("label", F.col(label).cast("double"))
    return zscores(percent_rank_label(out, "label", "y_rank"), {"label": "y_z"}, "plain")


def evaluate_predictions(predictions: DataFrame, every: int = 20) -> DataFrame:
    """One row of fifteen measures of `pred` against `label`: coefficients over all dates, spreads over every N-th."""
    ic = evaluation.daily_ic(predictions, "pred", "label")
    summary = evaluation.summarize_ic(ic).select("IC", "ICIR", "RankIC", "RankICIR", "coverage")
    days = ic.agg(F.count(F.lit(1)).alias("days"), F.try_divide(F.count_if(F.col("RankIC") > evaluation.ZERO).cast("double"), F.count("RankIC").cast("double")).alias("positive_rankic_ratio"))
    own = predictions.agg(F.avg("pred").alias("pred_mean"), F.stddev_pop("pred").alias("pred_std"))
    daily = predictions.groupBy("date").agg(F.stddev_pop("pred").alias("_s")).agg(F.avg("_s").alias("daily_pred_std_mean"), F.min("_s").alias("daily_pred_std_min"))
    spread = evaluation.long_short(predictions, "pred", "label", every=every)
    mean = spread.agg(F.avg("long_short_return").alias("long_short_return_mean"))
    perf = evaluation.performance(spread, "long_short_return", 252.0 / max(1, every)).select(F.col("Sharpe").alias("long_short_sharpe"), "max_drawdown")
    out = summary.withColumn("_k", F.lit(1))
    for one in (days, own, daily, mean, perf):  # one row each
        out = out.join(one.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k").withColumn("rebalance_every", F.lit(every))


def factor_ic(df: DataFrame, factors: list[str], label: str, every: int = 1) -> DataFrame:
    """factor, metric (IC or RankIC), mean, ir, std, positive_ratio, days, avg_coverage: every factor in one pass."""
    ic = evaluation.daily_ic(long_form(df, [*KEYS, label], factors), "value", label, ("factor", "date"), every=every)
    long = ic.unpivot(["factor", "date", "coverage"], ["IC", "RankIC"], "metric", "_x")
    mean, std = F.avg("_x"), F.stddev_samp("_x")
    return long.groupBy("factor", "metric").agg(
        mean.alias("mean"), annual_ratio(mean, std).alias("ir"), std.alias("std"), F.try_divide(F.count_if(F.col("_x") > evaluation.ZERO).cast("double"), F.count("_x").cast("double")).alias("positive_ratio"),
        F.count("_x").alias("days"), F.avg("coverage").alias("avg_coverage"),
    )


def ridge_by_split(panel: DataFrame, label: str = LABEL, factors: list[str] | None = None, split: dict[str, tuple[str, str]] = SPLIT, alpha: float = 1.0, lookback: int = 0, every: int = 1) -> dict[str, DataFrame]:
    """The factor-only baseline: a scaled ridge fitted on the train part, its predictions by split, their coefficients, and those of single factors on the test part.

    predictions (split, date, ticker, factor_only_pred, label), metrics, single_factor, top. With a lookback, features are the factors of today and the days before.
    """
    frame = require(keyed(panel), [label], "panel")
    chosen = factors or safe_factor_columns(frame.columns)
    if not chosen:
        raise KeyError("no z-score factor in the panel")
    features = chosen
    if lookback:
        lagged = frame.select(*KEYS, label, *chosen, *[F.lag(c, i).over(by_entity()).cast("double").alias(f"{c}_lag{i}") for c in chosen for i in range(lookback)])
        frame, features = lagged, [f"{c}_lag{i}" for c in chosen for i in range(lookback)]
    parts = frame.withColumn("split", split_of("date", split)).where("split IS NOT NULL")
    train = parts.where("split = 'train'")
    labelled = train.where(F.col(label).isNotNull())
    model = models.scaled_ridge(train, features, label, alpha)
    scored = models.predict(models.filled(parts, labelled, features), model, "factor_only_pred")
    predictions = scored.select("split", *KEYS, "factor_only_pred", label)
    ic = evaluation.daily_ic(predictions, "factor_only_pred", label, ("split", "date"), every=every)
    metrics = evaluation.summarize_ic(ic, ("split",)).select("split", "IC", "ICIR", "RankIC", "RankICIR", "coverage", F.col("IC_count").alias("days"))
    single = factor_ic(parts.where("split = 'test'"), chosen, label, every)
    top = single.where("metric = 'RankIC'").orderBy(F.col("mean").desc_nulls_last(), "factor").limit(30)
    return {"predictions": predictions, "metrics": metrics, "single_factor": single, "top": top}


def representations(stored: DataFrame, panel: DataFrame, to: int = 64, width: int | None = None, method: str = "pca", seed: int = 42) -> dict[str, DataFrame]:
    """Mean-pooled stock-day vectors projected to `to` components, with coverage, and the panel that holds them (zeros without news): repr, panel, quality.

    stored: chunk_id, date, ticker, embedding, path, line. The first row of a repeated chunk counts; rows without a vector are only counted.
    """
    quality = vectors.manifest_quality(stored)
    once = vectors.first_of_each(stored.where("embedding IS NOT NULL"))
    width = width or (once.select(F.size("embedding").alias("n")).first() or {"n": to})["n"]
    pooled = vectors.numbered_mean(keyed(once), KEYS, "embedding", width=width)
    mean, matrix = vectors.projection(pooled, "vector", width, to, method, seed)
    projected = vectors.project(pooled, "vector", mean, matrix, to, "vector")
    named = vectors.with_coverage(projected, keyed(panel)).withColumns({"embedding_dim": F.lit(to), "repr_method": F.lit(PROJECTED)})
    out = named.select(*KEYS, *vectors.to_columns("vector", to, "news_repr_"), "news_count", "chunk_count", "embedding_dim", "repr_method")
    joined = vectors.into_panel(keyed(panel), projected, "vector", to)
    wide = joined.select(*panel.columns, *vectors.to_columns("vector", to, "news_repr_"), F.lit(to).alias("embedding_dim"), F.lit(PROJECTED).alias("repr_method"), "has_vector")
    return {"repr": out, "panel": wide, "quality": quality}


def raw_representations(stored: DataFrame, width: int) -> dict[str, DataFrame]:
    """Mean-pooled stock-day vectors of full width as columns, with has_news and the number of chunks: repr, quality."""
    once = vectors.first_of_each(stored.where("embedding IS NOT NULL"))
    pooled = vectors.numbered_mean(keyed(once), KEYS, "embedding", width=width)
    return {"repr": pooled.select(*KEYS, F.lit(1).alias("has_news"), "embedded_chunk_count", *vectors.to_columns("vector", width, "mean_emb_")), "quality": vectors.manifest_quality(stored)}


def diagnostic_parts(frame: DataFrame, factors: list[str], label: str, n: int = 10) -> dict[str, DataFrame]:
    """What all tables of a diagnostics run are made of: daily coefficients, the days' deciles and the pairs' correlations. frame has a split column."""
    long = diagnostics.long_factors(frame, factors, label)
    return {"ic": diagnostics.all_daily_ic(long), "deciles": diagnostics.decile_days(long, n), "pairs": correlations.pairwise(frame, factors, least=diagnostics.LEAST)}


def diagnostic_tables(parts: dict[str, DataFrame], factors: list[str], n: int = 10, window: int = 60, least: int = 15, threshold: float = 0.8) -> dict[str, DataFrame]:
    """The seven tables and six matrices of a diagnostics run from its parts, by the names of their files."""
    ic, days, pairs = parts["ic"], parts["deciles"], parts["pairs"]
    table = diagnostics.summary(ic, diagnostics.metrics_of_days(days, n))
    high = diagnostics.over_threshold(pairs, threshold)
    out = {
        "summary_by_factor_split": table, "raw_factor_daily_ic": ic, f"raw_factor_rolling{window}_rankic": evaluation.rolling_mean(ic, {window: least}, keys=("factor", "split")),
        "raw_factor_decile_returns": diagnostics.summary_of_days(days), "highly_correlated_pairs": high, "factor_stability_flags": diagnostics.stability(table), "recommended_factor_keep_drop": diagnostics.keep_drop(factors, table, high),
    }
    for m in correlations.METHODS:
        for s in ("train", "valid", "test"):
            out[f"factor_corr_{s}_{m}"] = correlations.matrix(pairs.where((F.col("split") == s) & (F.col("method") == m)), factors)
    return out


def run_diagnostics(panel: DataFrame, root: str, factors: list[str], label: str = LABEL, split: dict[str, tuple[str, str]] | None = SPLIT, n: int = 10, **options: Any) -> dict[str, Any]:
    """A diagnostics run written under a folder as CSV, with a JSON summary, which is returned. split None: the panel has a split column.

    The panel is read once for each of the three parts, which are written as tables under `parts`; all files are made of those, several at a time.
    """
    spark, root = panel.sparkSession, root.rstrip("/")
    frame = require(keyed(panel), [label, *factors], "panel")
    frame = frame.withColumn("split", split_of("date", split)) if split else frame
    parts = {name: f"{root}/parts/{name}.parquet" for name in ("ic", "deciles", "pairs")}
    made = diagnostic_parts(frame, factors, label, n)
    tables.write_together({path: made[name] for name, path in parts.items()}, spark)
    frames = diagnostic_tables({name: spark.read.parquet(path) for name, path in parts.items()}, factors, n, **options)
    counted = Observation("highly_correlated_pairs")
    written = frames | {"highly_correlated_pairs": frames["highly_correlated_pairs"].observe(counted, F.count(F.lit(1)).alias("rows"))}
    files = tables.write_fan_out(written, root)
    # A row a factor: few.
    flags, choice = frames["factor_stability_flags"].collect(), frames["recommended_factor_keep_drop"].collect()
    summary = {
        "panel_rows": panel.count(), "factor_cols": factors, "label_col": label, "split": split, "files": files, "unstable_factors": sorted(r["factor"] for r in flags if r["unstable_flag"]), "weak_test_factors": sorted(r["factor"] for r in flags if r["weak_flag"]),
        "highly_correlated_pair_count": counted.get["rows"], "recommended_keep": sorted(r["factor"] for r in choice if r["keep_or_drop"] == "keep"), "recommended_drop": sorted(r["factor"] for r in choice if r["keep_or_drop"] == "drop"),
    } | options
    tables.write_json(spark, summary, f"{root}/diagnostics_summary")
    return summary


def attention_columns(df: DataFrame, weights: str, most: int, keys: list[str] = KEYS) -> DataFrame:
    """keys and attention_weight_0, ...: a weight column for each chunk, in single precision."""
    return df.select(*keys, *[F.get(weights, F.lit(i)).cast("float").alias(f"attention_weight_{i}") for i in range(most)])


def attention_long(df: DataFrame, weights: str, keys: list[str] = KEYS) -> DataFrame:
    """keys, chunk, attention_weight: one row a chunk."""
    return df.select(*keys, F.posexplode(weights).alias("chunk", "attention_weight"))


def write_attention(df: DataFrame, weights: str, most: int, root: str, split: str) -> str:
    path = f"{root.rstrip('/')}/attention_weights_{split}.parquet"
    attention_columns(df, weights, most).write.mode("overwrite").parquet(path)
    return path


def encode_chunks(chunks: DataFrame, done: DataFrame | None, make: Callable[[], Callable[[list[str]], np.ndarray]], model_name: str, batch: int = 32, text: str = "chunk_text") -> DataFrame:
    """chunk_id, ticker, date, model_name, embedding of the chunks that `done` lacks. `make` builds an encoder once in a task: a list of texts in, (texts, width) out.

    The encoder is the caller's; a null text is an empty one.
    """
    todo = require(chunks, ["chunk_id", "ticker", "date", text], "chunks")
    todo = todo if done is None else not_yet(todo, done)
    types = dict(todo.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for b in batches:
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                found = np.asarray(encode(part["_text"].tolist()), dtype=np.float32)
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "ticker": part["ticker"], "date": part["date"], "model_name": model_name, "embedding": list(found)})

    rows = todo.select(F.col("chunk_id").cast("string").alias("chunk_id"), "ticker", "date", F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return rows.mapInPandas(run, f"chunk_id string, ticker string, date {types['date']}, model_name string, embedding array<float>")


def chunk_samples(panel: DataFrame, days: DataFrame, factors: list[str], width: int, most: int = 64, lookback: int = 30, keep: Column | None = None) -> DataFrame:
    """Samples over a history with each day's chunks: factor_seq, chunk_seq (a matrix a day, filled with zero rows to `most`), chunk_mask_seq, ticker_id (0 for a ticker without history).

    days: date, ticker, matrix (see history.day_matrices, blocks.read_blocks). Matrices are padded when a day becomes part of a sample.
    """
    out = history.cut_samples(panel, factors, lookback, keep, matrices=days, width=width, most=most)
    ids = sequences.ticker_ids(panel)
    return out.join(ids, "ticker", "left").withColumn("ticker_id", F.coalesce("ticker_id", F.lit(0)))


def batches_by_date(df: DataFrame, dates: int = 16, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """df with batch, date_id: whole dates, `dates` of them a batch, in order of time or in a seeded order. Only the distinct dates are numbered in one task."""
    from pyspark.sql import Window

    order = F.xxhash64("date", F.lit(seed)) if shuffle else F.col("date")
    days = df.select("date").distinct().withColumn("_n", F.row_number().over(Window.orderBy(order, "date")) - 1)
    numbered = days.select("date", F.floor(F.col("_n") / dates).cast("int").alias("batch"), (F.col("_n") % dates).cast("int").alias("date_id"))
    return df.join(numbered, "date")
