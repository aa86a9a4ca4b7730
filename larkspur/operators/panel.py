"""Panels keyed by entity and date: keys, roles, splits, joins and their checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.maths import average_rank, col
from larkspur.functions.text import panel_ticker

KEYS = ["date", "ticker"]
# The inclusive default split.
SPLIT = {"train": ("2018-01-01", "2020-12-31"), "valid": ("2021-01-01", "2021-12-31"), "test": ("2022-01-01", "2023-12-31")}


def require(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """df, or KeyError if it lacks a column."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"{what} lacks {missing}")
    return df


def keyed(df: DataFrame) -> DataFrame:
    """date as DATE, ticker in upper case without outer spaces."""
    return require(df, KEYS).withColumns({"date": F.to_date("date"), "ticker": panel_ticker("ticker")})


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row for each key: the first by `order`. An order that leaves no ties makes it the same row every time."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def unique_by(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df, failing at run time on a repeated key. The count is a window on the keys that a join by them needs anyway."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).where(F.assert_true(F.col("_n") == 1, f"{what}: a key occurs more than once").isNull()).drop("_n")


def factor_columns(columns: list[str]) -> list[str]:
    """z-score columns that are no label, in the table's order."""
    return [c for c in columns if c.endswith("_zscore") and not c.startswith("future_")]


def safe_factor_columns(columns: list[str]) -> list[str]:
    """z-score columns that are neither label nor embedding nor news control, sorted."""
    barred = ("future_", "mean_emb_", "news_count", "chunk_count", "has_news")
    return sorted(c for c in columns if c.endswith("_zscore") and not c.startswith(barred))


def embedding_columns(columns: list[str], prefix: str = "mean_emb_", required: bool = False) -> list[str]:
    """Columns prefix0, prefix1, ... by number."""
    found = sorted((c for c in columns if c.startswith(prefix) and c[len(prefix) :].isdigit()), key=lambda c: int(c[len(prefix) :]))
    if required and not found:
        raise KeyError(f"no column begins with {prefix}")
    return found


def split_of(date: Column | str, split: dict[str, tuple[str, str]] = SPLIT) -> Column:
    """The name of the part a date falls in, ends included; NULL outside of all."""
    out = F.lit(None).cast("string")
    for name, (a, b) in reversed(split.items()):
        out = F.when(col(date).between(F.lit(a).cast("date"), F.lit(b).cast("date")), name).otherwise(out)
    return out


def rebalance_dates(df: DataFrame, every: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows of every N-th distinct date, the first included; N of 1 or less keeps all."""
    if every <= 1:
        return df
    w = Window.partitionBy(*keys).orderBy("date") if keys else Window.orderBy("date")
    days = df.select(*keys, "date").distinct().withColumn("_k", F.row_number().over(w)).where((F.col("_k") - 1) % every == 0).drop("_k")
    return df.join(days, [*keys, "date"], "left_semi")


def coverage_counts(chunks: DataFrame) -> DataFrame:
    """Distinct news and chunks of each stock-day."""
    return chunks.groupBy(*KEYS).agg(F.count_distinct("source_news_id").alias("news_count"), F.count_distinct("chunk_id").alias("chunk_count"))


def stock_day_panel(factors: DataFrame, labels: DataFrame, chunks: DataFrame) -> DataFrame:
    """Factors with their labels (one row a key) and coverage; no news counts as 0."""
    counts = coverage_counts(keyed(chunks))
    joined = keyed(factors).join(unique_by(keyed(labels), KEYS, "labels"), KEYS, "left").join(counts, KEYS, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("news_count", "chunk_count")}).withColumn("has_news", (F.col("news_count") > 0).cast("int"))


def only_new(base: DataFrame, extra: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """base with those columns of extra that it lacks."""
    fresh = [c for c in extra.columns if c not in base.columns]
    return base.join(extra.select(*keys, *fresh), keys, "left") if fresh else base


def replace_factors(panel: DataFrame, factors: DataFrame) -> DataFrame:
    """panel with its factor columns replaced by those of `factors`."""
    gone = [c for c in panel.columns if c not in KEYS and (c in factors.columns or c.endswith("_zscore") and not c.startswith("future_"))]
    return panel.drop(*gone).join(factors, KEYS, "left")


def training_panel(panel: DataFrame, pooled: DataFrame, vector: str, width: int) -> DataFrame:
    """A panel with a vector for each row: zeros where a stock-day has none. Repeated keys keep their first row by all columns."""
    def once(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in KEYS]
        return first_by(df, KEYS, *[F.to_json(F.struct(c)) for c in rest] or KEYS)
    zeros = F.array_repeat(F.lit(0.0), width)
    return once(keyed(panel)).join(once(keyed(pooled)).select(*KEYS, vector), KEYS, "left").withColumn(vector, F.coalesce(F.col(vector), zeros))


def percent_rank_label(df: DataFrame, label: str, out: str = "label_rank") -> DataFrame:
    """Average rank of the label among its date's, over their number. Rows without a label get NULL."""
    there = df.where(F.col(label).isNotNull())
    ranked = there.withColumn(out, average_rank(label, "date") / F.count(F.lit(1)).over(Window.partitionBy("date")))
    return ranked.unionByName(df.where(F.col(label).isNull()).withColumn(out, F.lit(None).cast("double")))


def long_form(df: DataFrame, ids: list[str], columns: list[str], name: str = "factor", value: str = "value") -> DataFrame:
    """One row for each id and column."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ids, columns, name, value)


def quality(df: DataFrame) -> DataFrame:
    """One row: rows, distinct dates and tickers, first and last date, repeated keys, rows with news."""
    news = F.sum(F.when(F.col("news_count") > 0, 1).otherwise(0)) if "news_count" in df.columns else F.lit(None).cast("long")
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("date").alias("dates"), F.count_distinct("ticker").alias("tickers"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        (F.count(F.lit(1)) - F.count_distinct("date", "ticker")).alias("repeated_keys"), news.alias("rows_with_news"),
    )


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """factor, coverage: the share of rows with a value, from one pass."""
    one = df.agg(*[(F.count(c) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(c) for c in columns])
    return one.unpivot([], columns, "factor", "coverage")
