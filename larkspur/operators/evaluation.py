"""How well a factor orders returns: information coefficients, deciles, long-short returns, turnover and their summaries.

Every operator takes `keys`, the columns of one cross-section (a date, or a split, factor and date): many factors are
judged in one pass over the long form, not in a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.maths import annual_ratio, clean, correlation, decile_of_rank, ratio
from larkspur.operators.panel import rebalance_dates

DATE = ("date",)
ZERO = 1e-12  # a coefficient below this is rounding


def cross_ranked(df: DataFrame, factor: str, ret: str, keys: tuple[str, ...]) -> DataFrame:
    """keys, _f, _r (cleaned), _valid, _fr, _rr (average ranks among the rows with both)."""
    base = df.select(*keys, clean(factor).alias("_f"), clean(ret).alias("_r"), (F.col(factor).isNotNull() & ~F.isnan(F.col(factor).cast("double")) & F.col(ret).isNotNull() & ~F.isnan(F.col(ret).cast("double"))).alias("_there"))
    base = base.withColumn("_valid", F.col("_f").isNotNull() & F.col("_r").isNotNull())

    def rank(x: str) -> Column:
        tied = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_valid", x))
        return F.when(F.col("_valid"), F.rank().over(Window.partitionBy(*keys, "_valid").orderBy(x)) + (tied - 1) / 2.0)

    return base.select("*", rank("_f").alias("_fr"), rank("_r").alias("_rr"))


def daily_ic(df: DataFrame, factor: str, ret: str, keys: tuple[str, ...] = DATE, least: int = 2, every: int = 1) -> DataFrame:
    """keys, IC, RankIC, coverage (rows with both, infinities included), valid_count, total_rows, distinct values and spreads of both sides."""
    groups = tuple(k for k in keys if k != "date")
    ranked = cross_ranked(rebalance_dates(df, every, groups), factor, ret, keys)
    f, r = F.when(F.col("_valid"), F.col("_f")), F.when(F.col("_valid"), F.col("_r"))
    return ranked.groupBy(*keys).agg(
        correlation(f, r, least).alias("IC"), correlation("_fr", "_rr", least).alias("RankIC"),
        F.sum(F.col("_there").cast("long")).alias("coverage"), F.sum(F.col("_valid").cast("long")).alias("valid_count"), F.count(F.lit(1)).alias("total_rows"),
        F.count_distinct(f).alias("factor_nunique"), F.count_distinct(r).alias("return_nunique"),
        F.when(F.min(f) == F.max(f), 0.0).otherwise(F.stddev_pop(f)).alias("factor_std"), F.when(F.min(r) == F.max(r), 0.0).otherwise(F.stddev_pop(r)).alias("return_std"),
    )


def summarize_ic(ic: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means, yearly information ratios, counts and missing counts of both coefficients."""
    out = []
    for c in ("IC", "RankIC"):
        out += [F.avg(c).alias(c), annual_ratio(F.avg(c), F.stddev_samp(c)).alias(f"{c}IR"), F.count(c).alias(f"{c}_count"), (F.count(F.lit(1)) - F.count(c)).alias(f"{c}_nan_count")]
    return ic.groupBy(*keys).agg(*out, F.count_if(F.abs("RankIC") < ZERO).alias("RankIC_zero_count"), F.avg("coverage").alias("coverage"))


def factor_health(df: DataFrame, factor: str, ret: str, every: int = 1) -> DataFrame:
    """One row about a factor table and its daily inputs."""
    daily = daily_ic(df, factor, ret, every=every)

    def there(c: str) -> Column:
        return F.count(F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), 1)) / F.count(F.lit(1))

    table = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct("date").alias("date_count"), there(factor).alias("factor_non_null_ratio"), there(ret).alias("return_non_null_ratio"))
    days = daily.agg(
        F.sum("total_rows").alias("rows_after_rebalance"), F.count(F.lit(1)).alias("date_count_after_rebalance"),
        F.avg("valid_count").alias("avg_daily_valid_count"), F.min("valid_count").alias("min_daily_valid_count"), F.max("valid_count").alias("max_daily_valid_count"),
        F.avg("factor_std").alias("daily_factor_std_mean"), F.min("factor_std").alias("daily_factor_std_min"), F.count_if(F.col("factor_std") == 0).alias("daily_factor_std_zero_count"),
        F.avg("return_std").alias("daily_return_std_mean"), F.min("return_std").alias("daily_return_std_min"), F.count_if(F.col("return_std") == 0).alias("daily_return_std_zero_count"),
        (F.count(F.lit(1)) - F.count("RankIC")).alias("rankic_nan_count"), F.count_if(F.abs("RankIC") < ZERO).alias("rankic_zero_count"), F.count("RankIC").alias("rankic_non_null_count"),
    )
    # Both sides are one row.
    return table.withColumn("_k", F.lit(1)).join(days.withColumn("_k", F.lit(1)), "_k").drop("_k")


def rolling_mean(ic: DataFrame, windows: dict[int, int], column: str = "RankIC", keys: tuple[str, ...] = ()) -> DataFrame:
    """ic with the mean over the last n rows by date for each n, given at least the named number of values. ic has one row a date and key."""
    out = []
    for n, least in windows.items():
        w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(n - 1), 0)
        out.append(F.when(F.count(column).over(w) >= least, F.avg(column).over(w)).alias(f"rolling_{n}d_{column}"))
    return ic.select("*", *out)


def deciles(df: DataFrame, factor: str, keys: tuple[str, ...] = DATE, n: int = 10, distinct: bool = False, out: str = "decile") -> DataFrame:
    """df with the decile of the factor in its cross-section, ties by ticker. `distinct`: only where it has n different values."""
    there = F.col(factor).isNotNull()
    part = Window.partitionBy(*keys, "_there")
    ranked = df.withColumn("_there", there).select("*", F.row_number().over(part.orderBy(factor, "ticker")).alias("_rn"), F.count(F.lit(1)).over(part).alias("_n"))
    enough = F.lit(True)
    if distinct:
        ranked = ranked.withColumn("_first", (F.lag(factor).over(part.orderBy(factor, "ticker")).eqNullSafe(F.col(factor))).cast("int"))
        ranked = ranked.withColumn("_d", F.col("_n") - F.sum("_first").over(part))
        enough = F.col("_d") >= n
    return ranked.withColumn(out, F.when(F.col("_there") & enough, decile_of_rank(F.col("_rn"), F.col("_n"), n))).drop("_there", "_rn", "_n", "_first", "_d")


def decile_returns(df: DataFrame, factor: str, ret: str, keys: tuple[str, ...] = DATE, n: int = 10, every: int = 1) -> DataFrame:
    """keys, decile, return: deciles over all rows with a factor, means over those of them with a return."""
    kept = rebalance_dates(df, every, tuple(k for k in keys if k != "date"))
    marked = deciles(kept.withColumn(factor, F.when(~F.isnan(F.col(factor).cast("double")), F.col(factor))), factor, keys, n)
    return marked.where(F.col("decile").isNotNull() & F.col(ret).isNotNull()).groupBy(*keys, "decile").agg(F.avg(ret).alias("return"))


def long_short(df: DataFrame, factor: str, ret: str, n: int = 10, every: int = 1) -> DataFrame:
    """date, long_return (top decile), short_return (bottom), long_short_return, cumulative_return."""
    by_day = decile_returns(df, factor, ret, n=n, every=every).groupBy("date").agg(F.max(F.when(F.col("decile") == n, F.col("return"))).alias("long_return"), F.max(F.when(F.col("decile") == 1, F.col("return"))).alias("short_return"))
    spread = by_day.withColumn("long_short_return", F.col("long_return") - F.col("short_return"))
    # One row a date: the running product is the one place where all rows meet.
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return spread.withColumn("cumulative_return", F.product(1.0 + F.coalesce("long_short_return", F.lit(0.0))).over(w) - 1.0)


def performance(returns: DataFrame, ret: str, periods_per_year: float = 252.0) -> DataFrame:
    """annualized_return, Sharpe, max_drawdown of a series by date; NULL where not defined."""
    kept = returns.select("date", clean(ret).alias("_x")).where("_x IS NOT NULL")
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = kept.withColumn("_c", F.product(1.0 + F.col("_x")).over(w))
    fallen = grown.withColumn("_d", ratio("_c", F.max("_c").over(w)) - 1.0)
    last = F.max_by("_c", "date")
    n = F.count(F.lit(1))
    return fallen.agg(
        F.when(last >= 0, F.pow(last, F.try_divide(F.lit(float(periods_per_year)), n)) - 1.0).alias("annualized_return"),
        (ratio(F.avg("_x"), F.stddev_samp("_x")) * F.sqrt(F.lit(float(periods_per_year)))).alias("Sharpe"),
        F.min("_d").alias("max_drawdown"),
    )


def extremes(df: DataFrame, factor: str, quantile: float = 0.1) -> DataFrame:
    """date, side (top or bottom), ticker: max(1, floor(n * quantile)) members at each end; a lone stock is in both."""
    there = df.where(F.col(factor).isNotNull())
    w = Window.partitionBy("date")
    n = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * quantile))
    ranked = there.select("date", "ticker", F.row_number().over(w.orderBy(factor, "ticker")).alias("_up"), F.row_number().over(w.orderBy(F.col(factor).desc(), F.col("ticker").desc())).alias("_down"), n.alias("_n"))
    sides = F.filter(F.array(F.when(F.col("_down") <= F.col("_n"), "top"), F.when(F.col("_up") <= F.col("_n"), "bottom")), lambda s: s.isNotNull())
    return ranked.select("date", "ticker", F.explode(sides).alias("side"))


def turnover(members: DataFrame) -> DataFrame:
    """date, side, turnover: the share of the members that were not in the date before; 0 on the first date."""
    held = members.groupBy("side", "date").agg(F.collect_set("ticker").alias("_now"))
    before = held.withColumn("_then", F.lag("_now").over(Window.partitionBy("side").orderBy("date")))
    same = F.size(F.array_intersect("_now", "_then"))
    return before.select("date", "side", F.when(F.col("_then").isNull(), 0.0).otherwise(1.0 - same / F.greatest(F.size("_now"), F.lit(1))).alias("turnover"))


def decay(df: DataFrame, factor: str, horizons: dict[int, str], every: int = 1) -> DataFrame:
    """horizon and its summary, for those return columns that exist, in one pass."""
    kept = {h: c for h, c in horizons.items() if c in df.columns}
    long = df.select("date", factor, *kept.values()).unpivot(["date", factor], list(kept.values()), "_name", "_ret")
    number = F.create_map(*[F.lit(x) for h, c in kept.items() for x in (c, h)])
    named = long.withColumn("horizon", F.element_at(number, F.col("_name")))
    return summarize_ic(daily_ic(named, factor, "_ret", ("horizon", "date"), every=every), ("horizon",))


def mean_by_date(df: DataFrame, columns: list[str], keys: tuple[str, ...] = DATE) -> DataFrame:
    """keys and the mean of each column over the date's rows that have it; NULL for a date without a value."""
    return df.groupBy(*keys).agg(*[F.avg(clean(c)).alias(c) for c in columns])


def decile_bar(deciles: DataFrame) -> DataFrame:
    """decile, return, days: the mean of the dates' returns of each decile."""
    return deciles.groupBy("decile").agg(F.avg("return").alias("return"), F.count("return").alias("days"))


def coverage_by_date(df: DataFrame, factor: str, ret: str, as_ratio: bool = True) -> DataFrame:
    both = F.count_if(clean(factor).isNotNull() & clean(ret).isNotNull())
    return df.groupBy("date").agg((both / F.count(F.lit(1)) if as_ratio else both).alias("coverage"))


def gate_by_decile(df: DataFrame, factor: str, gate: str) -> DataFrame:
    """decile, mean gate and rows, pooled over dates."""
    return deciles(df, factor).where("decile IS NOT NULL").groupBy("decile").agg(F.avg(gate).alias("mean_gate"), F.count(F.lit(1)).alias("rows"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (from 1), rows, of equal width from the smallest value to the largest, which is in the last bin."""
    x = df.select(clean(column).alias("_x")).where("_x IS NOT NULL")
    ends = x.agg(F.min("_x").alias("_a"), F.max("_x").alias("_b")).withColumn("_k", F.lit(1))
    placed = x.withColumn("_k", F.lit(1)).join(F.broadcast(ends), "_k")
    b = F.when(F.col("_a") == F.col("_b"), 1).otherwise(F.least(F.lit(bins), F.floor((F.col("_x") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins).cast("int") + 1))
    return placed.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("rows"))


def spread_by(df: DataFrame, factor: str, ret: str, keys: tuple[str, ...], n: int = 10, every: int = 1) -> DataFrame:
    """keys without date: mean and t of top less bottom decile, on rows with both, at n different values a date at least."""
    groups = tuple(k for k in keys if k != "date")
    return spread_of(diagnostic_deciles(rebalance_dates(df, every, groups), factor, ret, keys, n), keys, n)


def spread_of(by_day: DataFrame, keys: tuple[str, ...], n: int = 10) -> DataFrame:
    """spread_by from the days' deciles."""
    groups = tuple(k for k in keys if k != "date")
    ends = by_day.groupBy(*keys).agg(F.max(F.when(F.col("decile") == n, F.col("mean_return"))).alias("_top"), F.max(F.when(F.col("decile") == 1, F.col("mean_return"))).alias("_bottom"))
    diff = F.col("_top") - F.col("_bottom")
    return ends.groupBy(*groups).agg(
        F.avg(diff).alias("top_bottom_return"), (ratio(F.avg(diff), F.stddev_samp(diff)) * F.sqrt(F.count(diff))).alias("top_bottom_tstat"),
        F.avg("_top").alias("top_decile_return"), F.avg("_bottom").alias("bottom_decile_return"),
    )


def diagnostic_deciles(df: DataFrame, factor: str, ret: str, keys: tuple[str, ...], n: int = 10) -> DataFrame:
    """keys, decile, mean_return, count: deciles among the rows with both values, on dates with n different factor values."""
    both = df.select(*keys, "ticker", clean(factor).alias("_f"), clean(ret).alias("_r")).where("_f IS NOT NULL AND _r IS NOT NULL")
    return deciles(both, "_f", keys, n, distinct=True).where("decile IS NOT NULL").groupBy(*keys, "decile").agg(F.avg("_r").alias("mean_return"), F.count(F.lit(1)).alias("count"))
