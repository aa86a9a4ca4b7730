"""Price, style and fundamental factors and forward labels.

Every window by ticker of a stage sits in one projection, so a stage costs one shuffle and one sort; what is a window over a
window is a stage of its own. Factors of a day use closes up to the day before, but for the overnight gap, which uses the
day's open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.maths import by_entity, change, positive_log, ratio, rolling, rolling_beta, with_rolling_drawdown, zscores
from larkspur.operators.asof import asof, available
from larkspur.operators.panel import KEYS, keyed, require

# The names of the factors, by style.
PRICE_FACTORS = ["momentum_5d", "momentum_20d", "momentum_60d", "reversal_5d", "volatility_20d", "volume_zscore_20d", "max_drawdown_60d", "rsi_14", "overnight_gap", "beta_60d"]
STYLES = {
    "valuation": ["book_to_price", "earnings_yield", "sales_to_price", "cash_flow_yield", "free_cash_flow_yield", "ebitda_ev", "dividend_yield", "shareholder_yield"],
    "momentum_reversal": ["reversal_1m", "momentum_3m", "momentum_6m", "momentum_12m_skip_1m", "industry_relative_momentum", "momentum_acceleration", "high_52w_proximity", "reversal_5d", "max_daily_return_1m"],
    "quality_profitability": ["roe", "roa", "roic", "gross_margin", "operating_margin", "net_margin", "asset_turnover", "accruals", "cfo_assets"],
    "growth_investment": ["revenue_growth_yoy", "eps_growth_yoy", "ebitda_growth_yoy", "gross_profit_growth_yoy", "cfo_growth_yoy", "asset_growth_yoy", "capex_assets"],
    "risk_volatility": ["market_beta_1y", "volatility_1m", "volatility_3m", "idiosyncratic_volatility", "downside_volatility", "max_drawdown_1y", "leverage", "interest_coverage"],
    "size_liquidity_volume": ["log_market_cap", "turnover_1m", "dollar_volume_1m", "amihud_illiquidity", "volume_surge"],
    "revision": ["fy1_eps_revision_1m", "fy2_eps_revision_3m", "target_price_revision_1m", "recommendation_change"],
}
STYLE_FACTORS = [f for names in STYLES.values() for f in names]
# What a fact may be called, in order of preference.
FACTS = {
    "assets": ["assets", "Assets"],
    "assets_current": ["assets_current", "AssetsCurrent"],
    "liabilities": ["liabilities", "Liabilities"],
    "liabilities_current": ["liabilities_current", "LiabilitiesCurrent"],
    "book_equity": ["book_equity", "stockholders_equity", "StockholdersEquity", "CommonStocksIncludingAdditionalPaidInCapital"],
    "revenue_ttm": ["revenue_ttm", "revenues_ttm", "Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "SalesRevenueNet"],
    "gross_profit_ttm": ["gross_profit_ttm", "GrossProfit"],
    "operating_income_ttm": ["operating_income_ttm", "OperatingIncomeLoss"],
    "net_income_ttm": ["net_income_ttm", "NetIncomeLoss"],
    "eps_ttm": ["eps_ttm", "EarningsPerShareDiluted", "EarningsPerShareBasic"],
    "cfo_ttm": ["cfo_ttm", "NetCashProvidedByUsedInOperatingActivities"],
    "capex_ttm": ["capex_ttm", "PaymentsToAcquirePropertyPlantAndEquipment"],
    "depreciation_ttm": ["depreciation_ttm", "DepreciationDepletionAndAmortization"],
    "interest_expense_ttm": ["interest_expense_ttm", "InterestExpenseNonOperating", "InterestExpense"],
    "short_term_debt": ["short_term_debt", "LongTermDebtCurrent", "DebtCurrent"],
    "long_term_debt": ["long_term_debt", "LongTermDebtNoncurrent"],
    "cash_and_equivalents": ["cash_and_equivalents", "CashAndCashEquivalentsAtCarryingValue"],
    "dividends_ttm": ["dividends_ttm", "PaymentsOfDividends"],
    "buybacks_ttm": ["buybacks_ttm", "PaymentsForRepurchaseOfCommonStock"],
    "shares_outstanding": ["shares_outstanding", "CommonStocksOutstanding", "EntityCommonStockSharesOutstanding", "WeightedAverageNumberOfDilutedSharesOutstanding"],
}
ESTIMATES = ["fy1_eps_estimate", "fy2_eps_estimate", "target_price", "recommendation_score"]
TAX_KEPT = 0.79  # fixed value: the share of operating income left after tax


def lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(c, n).over(by_entity())


def daily_return(pad: bool = True) -> Column:
    """Close over the last close there is, or over the row before alone without `pad`."""
    if not pad:
        return change(F.col("close"), lag("close"))
    past = by_entity().rowsBetween(Window.unboundedPreceding, -1)
    upto = by_entity().rowsBetween(Window.unboundedPreceding, 0)
    return change(F.last("close", True).over(upto), F.last("close", True).over(past))


def returns(prices: DataFrame, pad: bool = True) -> DataFrame:
    """prices with ret_1d and the day-before columns."""
    out = keyed(require(prices, ["date", "ticker", "close", "volume"], "prices"))
    lags = {f"{c}_lag1": lag(c) for c in ("close", "volume", "high") if c in out.columns}
    return out.select("*", daily_return(pad).alias("ret_1d"), *[e.alias(n) for n, e in lags.items()])


def with_market(df: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """df with market_ret_1d: the date's mean return, or a given series (date, market_ret_1d)."""
    if market is None:
        return df.withColumn("market_ret_1d", F.avg("ret_1d").over(Window.partitionBy("date")))
    return df.join(market.select(F.to_date("date").alias("date"), "market_ret_1d"), "date", "left")


def price_volume_factors(prices: DataFrame, market: DataFrame | None = None, standardize: bool = True) -> DataFrame:
    """The ten price and volume factors, with z-scores (0 for a whole date without spread)."""
    base = with_market(returns(require(prices, ["open", "high", "low"], "prices")), market)
    base = base.select("*", lag("ret_1d").alias("ret_lag1"), lag("market_ret_1d").alias("market_ret_lag1"))
    base = with_rolling_drawdown(base, "close_lag1", {"max_drawdown_60d": (60, 60)})
    gain, loss = F.when(F.col("ret_lag1").isNotNull(), F.greatest("ret_lag1", F.lit(0.0))), F.when(F.col("ret_lag1").isNotNull(), F.greatest(-F.col("ret_lag1"), F.lit(0.0)))
    strength = ratio(rolling(F.avg, gain, 14), rolling(F.avg, loss, 14))
    out = base.select(
        *KEYS,
        *[change(lag("close"), lag("close", n + 1)).alias(f"momentum_{n}d") for n in (5, 20, 60)],
        (-change(lag("close"), lag("close", 6))).alias("reversal_5d"),
        rolling(F.stddev_samp, "ret_lag1", 20).alias("volatility_20d"),
        ratio(F.col("volume_lag1") - rolling(F.avg, "volume_lag1", 20), rolling(F.stddev_samp, "volume_lag1", 20)).alias("volume_zscore_20d"),
        "max_drawdown_60d",
        (100.0 - F.try_divide(F.lit(100.0), 1.0 + strength)).alias("rsi_14"),
        change(F.col("open"), F.col("close_lag1")).alias("overnight_gap"),
        rolling_beta("ret_lag1", "market_ret_lag1", 60).alias("beta_60d"),
    )
    return zscores(out, {f: f"{f}_zscore" for f in PRICE_FACTORS}, "filled") if standardize else out


def forward_returns(prices: DataFrame, horizons: tuple[int, ...] = (5, 20), market_ticker: str | None = None) -> DataFrame:
    """Returns over the next h rows, and the same less the market's: a ticker's, or the date's mean."""
    out = keyed(prices).select(*KEYS, *[change(F.lead("close", h).over(by_entity()), F.col("close")).alias(f"future_{h}d_return") for h in horizons])
    names = [f"future_{h}d_return" for h in horizons]
    if market_ticker is None:
        adjusted = [(F.col(n) - F.avg(n).over(Window.partitionBy("date"))).alias(n.replace("_return", "_market_adjusted_return")) for n in names]
        return out.select("*", *adjusted)
    bench = out.where(F.col("ticker") == market_ticker.strip().upper()).select("date", *[F.col(n).alias(f"_b_{n}") for n in names])
    joined = out.join(bench, "date", "left")
    return joined.select(*KEYS, *names, *[(F.col(n) - F.col(f"_b_{n}")).alias(n.replace("_return", "_market_adjusted_return")) for n in names])


def neutralize(df: DataFrame, value: str, group: str, out: str) -> DataFrame:
    """value less its mean in (date, group); NULL without a group."""
    mean = F.avg(value).over(Window.partitionBy("date", group))
    return df.withColumn(out, F.when(F.col(group).isNotNull(), F.col(value) - mean))


def style_price_factors(prices: DataFrame) -> DataFrame:
    """The price block of the style library, and what the fundamental block needs of it."""
    base = with_market(returns(prices))
    base = base.select("*", lag("ret_1d").alias("ret_lag1"), lag("market_ret_1d").alias("market_ret_lag1"))
    base = with_rolling_drawdown(base, "close_lag1", {"max_drawdown_1y": (252, 63)})
    top = "high_lag1" if "high" in prices.columns else "close_lag1"
    traded = F.col("close_lag1") * F.col("volume_lag1")
    beta = rolling_beta("ret_lag1", "market_ret_lag1", 252, 63)
    cap = lag("market_cap") if "market_cap" in prices.columns else F.lit(None).cast("double")
    first = base.select(
        *KEYS, "close_lag1", "volume_lag1", "ret_lag1", "market_ret_lag1",
        (-change(lag("close"), lag("close", 22))).alias("reversal_1m"),
        change(lag("close"), lag("close", 64)).alias("momentum_3m"),
        change(lag("close"), lag("close", 127)).alias("momentum_6m"),
        change(lag("close", 21), lag("close", 253)).alias("momentum_12m_skip_1m"),
        ratio("close_lag1", rolling(F.max, top, 252, 63)).alias("high_52w_proximity"),
        (-change(lag("close"), lag("close", 6))).alias("reversal_5d"),
        rolling(F.max, "ret_lag1", 21, 5).alias("max_daily_return_1m"),
        beta.alias("market_beta_1y"),
        rolling(F.avg, "ret_lag1", 252, 63).alias("_mean"),
        rolling(F.avg, "market_ret_lag1", 252, 63).alias("_market_mean"),
        rolling(F.stddev_samp, "ret_lag1", 21, 5).alias("volatility_1m"),
        rolling(F.stddev_samp, "ret_lag1", 63, 21).alias("volatility_3m"),
        rolling(F.stddev_samp, F.when(F.col("ret_lag1") < 0, F.col("ret_lag1")), 63, 10).alias("downside_volatility"),
        "max_drawdown_1y",
        rolling(F.avg, traded, 21, 5).alias("dollar_volume_1m"),
        rolling(F.avg, ratio(F.abs("ret_lag1"), traded), 21, 5).alias("amihud_illiquidity"),
        ratio("volume_lag1", rolling(F.avg, "volume_lag1", 21, 5)).alias("volume_surge"),
        rolling(F.avg, "volume_lag1", 21, 5).alias("_volume_1m"),
        cap.alias("_price_cap"),
    )
    alpha = F.col("_mean") - F.col("market_beta_1y") * F.col("_market_mean")
    second = first.withColumn("_residual", F.col("ret_lag1") - alpha - F.col("market_beta_1y") * F.col("market_ret_lag1"))
    return second.select(
        "*", (F.col("momentum_3m") - F.col("momentum_6m")).alias("momentum_acceleration"), rolling(F.stddev_samp, "_residual", 252, 63).alias("idiosyncratic_volatility")
    ).drop("_residual", "_mean", "_market_mean", "ret_lag1", "market_ret_lag1")


def industry_relative(df: DataFrame, industry: DataFrame | None) -> DataFrame:
    """momentum_6m less its mean over the date's industry."""
    if industry is None:
        return df.withColumn("industry_relative_momentum", F.lit(None).cast("double"))
    named = industry.select(F.upper(F.trim("ticker")).alias("ticker"), F.col("industry" if "industry" in industry.columns else next(c for c in industry.columns if c != "ticker")).alias("_industry"))
    return neutralize(df.join(named, "ticker", "left"), "momentum_6m", "_industry", "industry_relative_momentum").drop("_industry")


def first_existing(df: DataFrame, aliases: list[str], prefix: str = "") -> Column:
    """The first of the names that is a column, as a double; it is not replaced by a later one where it is NULL."""
    name = next((a for a in aliases if prefix + a in df.columns), None)
    return F.lit(None).cast("double") if name is None else F.col(f"`{prefix}{name}`").try_cast("double")


def fundamental_factors(df: DataFrame, facts: DataFrame | None, lag_days: int = 1) -> DataFrame:
    """Valuation, quality, growth, leverage and size from the latest filing each day could know."""
    if facts is None:
        empty = ["source_filed_date", "latest_filing_date"]
        return df.select("*", *[F.lit(None).cast("date").alias(c) for c in empty])
    known = available(facts.withColumn("ticker", F.upper(F.trim("ticker"))), lag_days)
    source = next(c for c in ("available_date", "filed_date", "source_filed_date", "latest_filing_date", "date") if c in facts.columns)
    for c in ("source_filed_date", "latest_filing_date"):
        if c not in facts.columns:
            known = known.withColumn(c, F.to_date(source))
    known = known.drop("date")
    tie = [c for c in known.columns if c not in ("ticker", "available_date")]
    at = asof(df, known, ["ticker"], "date", "available_date", tie, prefix="_f_")
    own = [c for c in df.columns if c not in KEYS]
    at = at.select(*KEYS, *own, *[F.to_date(f"_f_{c}").alias(c) for c in ("source_filed_date", "latest_filing_date")], *[first_existing(at, a, "_f_").alias(n) for n, a in FACTS.items()])

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    debt = zero("short_term_debt") + zero("long_term_debt")
    cap = F.coalesce("_price_cap", F.col("shares_outstanding") * F.col("close_lag1"))
    at = at.select("*", debt.alias("_debt"), (F.col("operating_income_ttm") + zero("depreciation_ttm")).alias("_ebitda"), cap.alias("market_cap"))
    invested = F.col("book_equity") + F.col("_debt") - zero("cash_and_equivalents")
    value = F.col("market_cap") + F.col("_debt") - F.col("cash_and_equivalents")
    over_cap = {"book_to_price": "book_equity", "earnings_yield": "net_income_ttm", "sales_to_price": "revenue_ttm", "cash_flow_yield": "cfo_ttm", "dividend_yield": "dividends_ttm"}
    over_assets = {"roa": "net_income_ttm", "asset_turnover": "revenue_ttm", "cfo_assets": "cfo_ttm", "capex_assets": "capex_ttm"}
    over_revenue = {"gross_margin": "gross_profit_ttm", "operating_margin": "operating_income_ttm", "net_margin": "net_income_ttm"}
    yearly = {"asset_growth_yoy": "assets", "revenue_growth_yoy": "revenue_ttm", "eps_growth_yoy": "eps_ttm", "ebitda_growth_yoy": "_ebitda", "gross_profit_growth_yoy": "gross_profit_ttm", "cfo_growth_yoy": "cfo_ttm"}
    made = {n: ratio(c, "market_cap") for n, c in over_cap.items()} | {n: ratio(c, "assets") for n, c in over_assets.items()} | {n: ratio(c, "revenue_ttm") for n, c in over_revenue.items()}
    made |= {n: change(F.col(c), lag(c, 252)) for n, c in yearly.items()}
    made |= {
        "free_cash_flow_yield": ratio(F.col("cfo_ttm") - F.col("capex_ttm"), "market_cap"),
        "ebitda_ev": ratio("_ebitda", value),
        "shareholder_yield": ratio(zero("dividends_ttm") + zero("buybacks_ttm"), "market_cap"),
        "roe": ratio("net_income_ttm", "book_equity"),
        "roic": ratio(F.col("operating_income_ttm") * TAX_KEPT, invested),
        "accruals": ratio(F.col("net_income_ttm") - F.col("cfo_ttm"), "assets"),
        "leverage": ratio("_debt", "assets"),
        "interest_coverage": ratio("operating_income_ttm", "interest_expense_ttm"),
        "log_market_cap": positive_log("market_cap"),
        "turnover_1m": ratio("_volume_1m", "shares_outstanding"),
    }
    return at.select(*KEYS, *own, "source_filed_date", "latest_filing_date", *[e.alias(n) for n, e in made.items()])


def analyst_factors(df: DataFrame, analyst: DataFrame | None, lag_days: int = 1) -> DataFrame:
    """Changes of estimates over rows of the panel, as known each day."""
    if analyst is None:
        return df
    source = analyst.withColumnRenamed("as_of_date", "date") if "as_of_date" in analyst.columns and "date" not in analyst.columns else analyst
    known = available(keyed(source), lag_days).drop("date")
    at = asof(df, known, ["ticker"], "date", "available_date", [c for c in known.columns if c not in ("ticker", "available_date")], prefix="_a_")
    at = at.select(*[c for c in df.columns], *[first_existing(at, [c], "_a_").alias(f"_e_{c}") for c in ESTIMATES])
    made = {"fy1_eps_revision_1m": ("fy1_eps_estimate", 21), "fy2_eps_revision_3m": ("fy2_eps_estimate", 63), "target_price_revision_1m": ("target_price", 21)}
    score = F.col("_e_recommendation_score")
    return at.select(*df.columns, *[change(F.col(f"_e_{c}"), lag(f"_e_{c}", n)).alias(name) for name, (c, n) in made.items()], (score - lag("_e_recommendation_score", 21)).alias("recommendation_change"))


def style_factors(prices: DataFrame, facts: DataFrame | None = None, analyst: DataFrame | None = None, industry: DataFrame | None = None, standardize: bool = True) -> DataFrame:
    """The fifty style factors; those without an input are NULL. z-scores are 0 where a date has a value but no spread."""
    out = industry_relative(style_price_factors(prices), industry)
    out = analyst_factors(fundamental_factors(out, facts), analyst)
    raw = [F.col(c).alias(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in STYLE_FACTORS]
    out = out.select(*KEYS, "source_filed_date", "latest_filing_date", *raw)
    return zscores(out, {f: f"{f}_zscore" for f in STYLE_FACTORS}, "kept") if standardize else out


def coverage_by_style(coverage: DataFrame) -> DataFrame:
    """style, coverage: the mean of its factors' coverage (factor, coverage)."""
    style = F.create_map(*[F.lit(x) for s, names in STYLES.items() for f in names for x in (f, s)])
    return coverage.withColumn("style", F.element_at(style, F.col("factor"))).where("style IS NOT NULL").groupBy("style").agg(F.avg("coverage").alias("coverage"))
