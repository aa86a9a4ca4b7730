"""Per-ticker history as arrays: lag blocks, fixed-length samples with padded chunk tensors, and causal convolutions over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.maths import by_entity
from larkspur.operators.history import cut_samples
from larkspur.operators.panel import KEYS


def lag_block(df: DataFrame, columns: list[str], lookback: int = 30) -> DataFrame:
    """Keys and each column's values of today and the lookback - 1 rows before, as <column>_lag<i>; missing ones are 0."""
    return df.select(*KEYS, *[F.coalesce(F.lag(c, i).over(by_entity()).cast("double"), F.lit(0.0)).alias(f"{c}_lag{i}") for c in columns for i in range(lookback)])


def ticker_ids(df: DataFrame) -> DataFrame:
    """ticker, ticker_id: 1, 2, ... by name; 0 is for unknown ones."""
    return df.select("ticker").distinct().withColumn("ticker_id", F.row_number().over(Window.orderBy("ticker")))


def samples(df: DataFrame, columns: list[str], vector: str | None = None, lookback: int = 30, keep: Column | None = None) -> DataFrame:
    """One row for each stock-day with a full history: factor_seq, news_seq (if a vector is named) and date_seq, oldest first.

    History comes from the whole panel; `keep` picks the days that become samples. A few numbers a day are collected by a window; vectors go by ranges of time, so
    that a day's vector is not copied for each of its samples.
    """
    if vector:
        return cut_samples(df, columns, lookback, keep, vector)
    w = by_entity().rowsBetween(-(lookback - 1), 0)
    day = F.struct(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("f"), F.col("date").alias("d"))
    out = df.select("*", F.collect_list(day).over(w).alias("_h"))
    if keep is not None:
        out = out.where(keep)
    out = out.where(F.size("_h") == lookback)
    return out.withColumn("factor_seq", F.transform("_h", lambda s: s["f"])).withColumn("date_seq", F.transform("_h", lambda s: s["d"])).drop("_h")


def padded(matrix: Column | str, most: int, width: int) -> tuple[Column, Column]:
    """(matrix filled with zero rows to `most`, mask of its own rows)."""
    m = F.coalesce(F.col(matrix) if isinstance(matrix, str) else matrix, F.array().cast("array<array<double>>"))
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), width), most)
    rows = F.slice(F.concat(m, zero), 1, most)
    return rows, F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: i <= F.size(m))


def causal_convolution(series: Column | str, kernel: list[float], dilation: int = 1) -> Column:
    """At each place, the kernel over that place and earlier ones `dilation` apart (the last weight on the place itself), zeros before the start."""
    x = F.col(series) if isinstance(series, str) else series
    k = len(kernel)

    def at(i: Column) -> Column:
        out = F.lit(0.0)
        for j, w in enumerate(kernel):
            out = out + F.coalesce(F.get(x, i - (k - 1 - j) * dilation), F.lit(0.0)) * float(w)
        return out

    return F.transform(F.sequence(F.lit(0), F.size(x) - 1), at)


def attention_pool(matrix: Column | str, query: list[float]) -> tuple[Column, Column]:
    """(weights, pooled vector) of a dot-product attention over the rows of a matrix; no rows, no weights."""
    m = F.col(matrix) if isinstance(matrix, str) else matrix
    q = F.array(*[F.lit(float(x)) for x in query])

    def dot(row: Column) -> Column:
        return F.aggregate(F.zip_with(row, q, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    scores = F.transform(m, dot)
    raised = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    weights = F.transform(raised, lambda e: e / total)
    zero = F.array_repeat(F.lit(0.0), len(query))
    pooled = F.aggregate(F.zip_with(m, weights, lambda row, w: F.transform(row, lambda x: x * w)), zero, lambda s, row: F.zip_with(s, row, lambda a, b: a + b))
    return weights, pooled


def date_batches(df: DataFrame, batches: int, seed: int = 0) -> DataFrame:
    """df with `batch`: whole dates, dealt by a seeded hash, so a date's rows stay together."""
    return df.withColumn("batch", F.pmod(F.xxhash64("date", F.lit(seed)), F.lit(batches)).cast("int"))
