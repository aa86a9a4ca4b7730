"""Stored embeddings: pooling, checks, joins into a panel, projection and attention."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.panel import KEYS, first_by

SUMS = 16


def numbered_mean(df: DataFrame, keys: list[str], vector: str, out: str = "vector", width: int | None = None) -> DataFrame:
    """Component means of the vectors of each key, with their number; different lengths in a key fail.

    With the vectors' width, each component is an aggregate of its own, and a key costs one row a task. Without it components go out
    as rows and are summed before the shuffle: one row a component and task.
    """
    if width:
        sized = df.select(*keys, vector, F.size(vector).alias("_n"))
        means = [F.avg(F.get(vector, F.lit(i)).cast("double")).alias(f"_m{i}") for i in range(width)]
        whole = sized.groupBy(*keys).agg(*means, F.count(F.lit(1)).alias("embedded_chunk_count"), F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
        fits = whole.where(F.assert_true((F.col("_lo") == width) & (F.col("_hi") == width), "vectors of another length").isNull())
        return fits.select(*keys, F.array(*[f"_m{i}" for i in range(width)]).alias(out), "embedded_chunk_count")
    sizes = df.select(*keys, vector, F.size(vector).alias("_n"))
    parts = sizes.select(*keys, "_n", F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.count(F.lit(1)).alias("_c"), F.min("_n").alias("_lo"), F.max("_n").alias("_hi"))
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"), F.max("_c").alias("embedded_chunk_count"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    checked = whole.where(F.assert_true(F.col("_lo") == F.col("_hi"), "vectors of different length in one key").isNull())
    return checked.select(*keys, F.transform("_v", lambda s: s["_m"]).alias(out), "embedded_chunk_count")


def wide_mean(df: DataFrame, columns: list[str], prefix: str = "mean_") -> DataFrame:
    """Means of wide vector columns by stock-day."""
    return df.groupBy(*KEYS).agg(*[F.avg(c).alias(f"{prefix}{c}") for c in columns])


def to_columns(vector: str, width: int, prefix: str) -> list[Column]:
    """A vector as columns prefix0, prefix1, ..."""
    return [F.get(vector, F.lit(i)).alias(f"{prefix}{i}") for i in range(width)]


def to_vector(columns: list[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in columns])


def first_of_each(manifest: DataFrame, key: str = "chunk_id", order: tuple[str, ...] = ("path", "line")) -> DataFrame:
    """The first row of each id by place in the files."""
    return first_by(manifest, [key], *order)


def manifest_quality(manifest: DataFrame, key: str = "chunk_id") -> DataFrame:
    """rows, distinct ids, repeated rows, rows without a vector, least and greatest length."""
    return manifest.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_ids"), (F.count(F.lit(1)) - F.count_distinct(key)).alias("repeated_rows"),
        F.count_if(F.col("embedding").isNull()).alias("missing_vectors"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("greatest_dim"),
    )


def dimension_histogram(df: DataFrame, vector: str = "embedding") -> DataFrame:
    return df.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("dim")).agg(F.count(F.lit(1)).alias("rows"))


def with_coverage(pooled: DataFrame, panel: DataFrame) -> DataFrame:
    """pooled with the panel's counts; a chunk count that is missing is the number of vectors."""
    joined = pooled.join(panel.select(*KEYS, "news_count", "chunk_count"), KEYS, "left")
    return joined.withColumns({"chunk_count": F.coalesce("chunk_count", "embedded_chunk_count"), "news_count": F.coalesce("news_count", F.lit(0))})


def into_panel(panel: DataFrame, pooled: DataFrame, vector: str, width: int) -> DataFrame:
    """panel with its vector (zeros where there is none) and whether it has a component that is not zero."""
    joined = panel.join(pooled.select(*KEYS, vector), KEYS, "left").withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0.0), width)))
    return joined.withColumn("has_vector", F.exists(vector, lambda x: x != 0))


def compare(direct: DataFrame, cached: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """One row: keys on one side only, keys on both, and the largest difference of a component."""
    a, b = direct.select(*keys, F.col(vector).alias("_a")), cached.select(*keys, F.col(vector).alias("_b"))
    both = a.join(b, keys, "full")
    gap = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.abs(F.coalesce(x, F.lit(float("inf"))) - F.coalesce(y, F.lit(float("inf")))).cast("double")), F.lit(0.0), lambda m, d: F.greatest(m, d))
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_direct"), F.count_if(F.col("_a").isNull()).alias("only_cached"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.max(gap).alias("largest_difference"))


def attention_entropy(weights: Column | str, low: float = 1e-8) -> Column:
    """Entropy of weights clipped to [low, 1]."""
    w = F.col(weights) if isinstance(weights, str) else weights
    clipped = F.transform(w, lambda x: F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(low)))
    return -F.aggregate(F.transform(clipped, lambda x: x * F.ln(x)), F.lit(0.0), lambda a, x: a + x)


def moments(df: DataFrame, vector: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance sum of a vector column: each task sums one matrix into one row, SUMS tasks add those up, and the driver the rest."""
    size = width * (width + 1) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, np.zeros(width), np.zeros((width, width))
        for b in batches:
            if len(b):
                x = np.array(b["_v"].tolist(), dtype=np.float64)
                n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
        yield pd.DataFrame({"x": [np.concatenate(([n], s, g.ravel())).tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for b in batches:
            for x in b["x"]:
                total += np.frombuffer(x)
        yield pd.DataFrame({"x": [total.tobytes()]})

    rows = df.select(F.col(vector).cast("array<double>").alias("_v")).where("_v IS NOT NULL")
    x = np.zeros(size)
    for r in rows.mapInPandas(run, "x binary").repartition(SUMS).mapInPandas(add, "x binary").collect():
        x += np.frombuffer(r["x"])
    n = int(x[0])
    mean = x[1 : width + 1] / max(n, 1)
    return n, mean, x[width + 1 :].reshape(width, width) - n * np.outer(mean, mean)


def projection(df: DataFrame, vector: str, width: int, to: int, method: str = "pca", seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix) of a projection to at most `to` components: principal ones, or a seeded Gaussian.

    Each principal component's largest weight is positive, so it does not depend on the solver's signs.
    """
    if method == "gaussian":
        return np.zeros(width), np.random.default_rng(seed).normal(0.0, 1.0 / np.sqrt(to), (width, to))
    n, mean, scatter = moments(df, vector, width)
    values, vectors = np.linalg.eigh(scatter)
    best = vectors[:, np.argsort(-values)[: min(to, width, max(n, 1))]]
    return mean, best * np.sign(best[np.argmax(np.abs(best), axis=0), np.arange(best.shape[1])])


def project(df: DataFrame, vector: str, mean: np.ndarray, matrix: np.ndarray, to: int, out: str) -> DataFrame:
    """df with (vector - mean) times the matrix, filled with zeros to `to` components."""
    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        y = (np.array(x.tolist(), dtype=np.float64) - mean) @ matrix if len(x) else np.zeros((0, matrix.shape[1]))
        return pd.Series(list(np.pad(y, ((0, 0), (0, to - matrix.shape[1])))))

    return df.withColumn(out, run(F.col(vector).cast("array<double>")))
