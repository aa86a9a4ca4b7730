"""Queries on price, style and fundamental factors, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import maths as M
from larkspur.operators import asof as A
from larkspur.operators import factors as X
from larkspur.operators import panel as P
from larkspur.plans.adapters import load, oracle

W = "(PARTITION BY ticker ORDER BY date)"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {frame(n)} >= {least or n} THEN {f}({x}) {frame(n)} END"


def beta(a: str, b: str, n: int, least: int | None = None) -> str:
    both = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END"
    cov = f"CASE WHEN count({both}) {frame(n)} >= {least or n} THEN covar_samp({a}, {b}) {frame(n)} END"
    return f"({cov}) / nullif({roll('var_samp', b, n, least)}, 0)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; a negative zero becomes zero."""
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0 AS {name}"


RETURNS = f"""{oracle('bars')},
ret AS (SELECT *, close / lag(close) OVER {W} - 1 AS ret_1d, lag(close) OVER {W} AS close_lag1, lag(volume) OVER {W} AS volume_lag1, lag(high) OVER {W} AS high_lag1 FROM bars),
mkt AS (SELECT *, avg(ret_1d) OVER (PARTITION BY date) AS market_ret_1d FROM ret),
base AS (SELECT *, lag(ret_1d) OVER {W} AS ret_lag1, lag(market_ret_1d) OVER {W} AS market_ret_lag1 FROM mkt)"""

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return keep


def lagged(n: int, m: int) -> str:
    return f"lag(close, {n}) OVER {W} / lag(close, {m}) OVER {W} - 1"


GAIN, LOSS = "CASE WHEN ret_lag1 IS NOT NULL THEN greatest(ret_lag1, 0) END", "CASE WHEN ret_lag1 IS NOT NULL THEN greatest(-ret_lag1, 0) END"


@query(f"""WITH {RETURNS} SELECT date, ticker, {r(lagged(1, 6), 'momentum_5d')}, {r(lagged(1, 21), 'momentum_20d')}, {r(lagged(1, 61), 'momentum_60d')}, {r('-(' + lagged(1, 6) + ')', 'reversal_5d')},
    {r(roll('stddev_samp', 'ret_lag1', 20), 'volatility_20d')}, {r(f"(volume_lag1 - ({roll('avg', 'volume_lag1', 20)})) / nullif({roll('stddev_samp', 'volume_lag1', 20)}, 0)", 'volume_zscore_20d')},
    {r(f"100 - 100 / (1 + ({roll('avg', GAIN, 14)}) / nullif({roll('avg', LOSS, 14)}, 0))", 'rsi_14', 5)}, {r('open / close_lag1 - 1', 'overnight_gap')}, {r(beta('ret_lag1', 'market_ret_lag1', 60), 'beta_60d', 5)} FROM base""")
def price_volume_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.price_volume_factors(load(spark, sf_dir, "bars"), standardize=False)
    five = rounded(out.select("date", "ticker", "rsi_14", "beta_60d"), 5)
    return rounded(out.drop("rsi_14", "beta_60d", "max_drawdown_60d")).join(five, ["date", "ticker"])


GIVEN = RETURNS.replace("mkt AS (SELECT *, avg(ret_1d) OVER (PARTITION BY date) AS market_ret_1d FROM ret)", "mkt AS (SELECT ret.*, m.ret_1d AS market_ret_1d FROM ret LEFT JOIN (SELECT date, ret_1d FROM ret WHERE ticker = 'BRAND#11') m ON ret.date = m.date)")


@query(f"WITH {GIVEN} SELECT date, ticker, {r(beta('ret_lag1', 'market_ret_lag1', 60), 'beta_60d', 5)} FROM base")
def beta_to_a_given_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplied market series, here the returns of one ticker, in place of the dates' means."""
    bars = load(spark, sf_dir, "bars")
    market = X.returns(bars).where("ticker = 'BRAND#11'").select("date", F.col("ret_1d").alias("market_ret_1d"))
    return rounded(X.price_volume_factors(bars, market, standardize=False).select("date", "ticker", "beta_60d"), 5)


@query(f"""WITH {RETURNS},
frames AS (SELECT a.date, a.ticker, b.date AS d, b.close_lag1 AS c, max(b.close_lag1) OVER (PARTITION BY a.ticker, a.date ORDER BY b.date) AS top, count(*) OVER (PARTITION BY a.ticker, a.date) AS n
  FROM (SELECT *, row_number() OVER {W} AS k FROM base) a JOIN (SELECT *, row_number() OVER {W} AS k FROM base) b ON a.ticker = b.ticker AND b.k BETWEEN a.k - 59 AND a.k WHERE b.close_lag1 IS NOT NULL)
SELECT date, ticker, {r('min(c / top - 1)', 'max_drawdown_60d')} FROM frames WHERE n >= 60 GROUP BY date, ticker""")
def rolling_max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.with_rolling_drawdown(X.returns(load(spark, sf_dir, "bars")), "close_lag1", {"max_drawdown_60d": (60, 60)}).select("date", "ticker", "max_drawdown_60d")
    return rounded(out.where("max_drawdown_60d IS NOT NULL"))


def z_sql(source: str, x: str, how: str) -> str:
    """Winsorised or plain z-scores of x, as the three rules differ where there is no spread."""
    if how == "plain":
        score = f"CASE WHEN max({x}) OVER d > min({x}) OVER d THEN ({x} - avg({x}) OVER d) / nullif(stddev_pop({x}) OVER d, 0) END"
        return f"SELECT date, ticker, {r(score, 'z')} FROM {source} WINDOW d AS (PARTITION BY date)"
    inner = f"SELECT date, ticker, {x} AS x, quantile_cont({x}, 0.01) OVER (PARTITION BY date) AS a, quantile_cont({x}, 0.99) OVER (PARTITION BY date) AS b FROM {source}"
    clip = f"SELECT date, ticker, x, CASE WHEN x IS NOT NULL THEN greatest(least(x, b), a) END AS c FROM ({inner}) AS q"
    flat = "max(c) OVER d IS NULL OR max(c) OVER d = min(c) OVER d"
    rest = f"(c - avg(c) OVER d) / nullif(stddev_pop(c) OVER d, 0)"
    score = f"CASE WHEN {flat} THEN 0 ELSE {rest} END" if how == "filled" else f"CASE WHEN c IS NULL THEN NULL WHEN {flat} THEN 0 ELSE {rest} END"
    return f"SELECT date, ticker, {r(score, 'z')} FROM ({clip}) AS t WINDOW d AS (PARTITION BY date)"


def _z(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    return rounded(M.zscores(load(spark, sf_dir, "signals"), {"momentum_20": "z"}, how).select("date", "ticker", "z"))


@query(f"WITH {oracle('signals')} {z_sql('signals', 'momentum_20', 'filled')}")
def zscore_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(spark, sf_dir, "filled")


@query(f"WITH {oracle('signals')} {z_sql('signals', 'momentum_20', 'kept')}")
def zscore_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(spark, sf_dir, "kept")


@query(f"WITH {oracle('signals')} {z_sql('signals', 'momentum_20', 'plain')}")
def zscore_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _z(spark, sf_dir, "plain")


@query(f"""WITH {oracle('bars')}, f AS (SELECT date, ticker, lead(close, 5) OVER {W} / close - 1 AS a, lead(close, 20) OVER {W} / close - 1 AS b FROM bars)
SELECT date, ticker, {r('a', 'future_5d_return')}, {r('b', 'future_20d_return')}, {r('a - avg(a) OVER d', 'future_5d_market_adjusted_return')}, {r('b - avg(b) OVER d', 'future_20d_market_adjusted_return')} FROM f WINDOW d AS (PARTITION BY date)""")
def forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.forward_returns(load(spark, sf_dir, "bars")))


@query(f"""WITH {oracle('bars')}, f AS (SELECT date, ticker, lead(close, 5) OVER {W} / close - 1 AS a FROM bars), m AS (SELECT date, a AS b FROM f WHERE ticker = 'BRAND#7')
SELECT f.date, ticker, {r('a', 'future_5d_return')}, {r('a - b', 'future_5d_market_adjusted_return')} FROM f LEFT JOIN m ON f.date = m.date""")
def forward_returns_against_a_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.forward_returns(load(spark, sf_dir, "bars"), (5,), market_ticker="brand#7"))


GROUP = "CASE WHEN ticker IN ('BRAND#1', 'BRAND#2', 'BRAND#3') THEN NULL WHEN length(ticker) = 7 THEN 'short' ELSE 'long' END"


@query(f"""WITH {oracle('signals')}, g AS (SELECT *, {GROUP} AS grp FROM signals) SELECT date, ticker, {r('CASE WHEN grp IS NOT NULL THEN momentum - avg(momentum) OVER (PARTITION BY date, grp) END', 'neutral', 12)} FROM g""")
def neutralized_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = load(spark, sf_dir, "signals").withColumn("grp", F.expr(GROUP))
    return rounded(X.neutralize(out, "momentum", "grp", "neutral").select("date", "ticker", "neutral"), 12)


STYLE = {
    "reversal_1m": f"-({lagged(1, 22)})", "momentum_3m": lagged(1, 64), "momentum_6m": lagged(1, 127), "momentum_12m_skip_1m": lagged(21, 253), "reversal_5d": f"-({lagged(1, 6)})",
    "high_52w_proximity": f"close_lag1 / nullif({roll('max', 'high_lag1', 252, 63)}, 0)", "max_daily_return_1m": roll("max", "ret_lag1", 21, 5),
    "momentum_acceleration": f"({lagged(1, 64)}) - ({lagged(1, 127)})",
}


@query(f"WITH {RETURNS} SELECT date, ticker, {', '.join(r(e, n) for n, e in STYLE.items())} FROM base")
def style_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.style_price_factors(load(spark, sf_dir, "bars")).select("date", "ticker", *STYLE))


RISK = {
    "market_beta_1y": beta("ret_lag1", "market_ret_lag1", 252, 63), "volatility_1m": roll("stddev_samp", "ret_lag1", 21, 5), "volatility_3m": roll("stddev_samp", "ret_lag1", 63, 21),
    "downside_volatility": roll("stddev_samp", "(CASE WHEN ret_lag1 < 0 THEN ret_lag1 END)", 63, 10), "volume_surge": f"volume_lag1 / nullif({roll('avg', 'volume_lag1', 21, 5)}, 0)",
}
TRADED = "(close_lag1 * volume_lag1)"
LIQUID = {"dollar_volume_1m": roll("avg", TRADED, 21, 5), "amihud_illiquidity": f"1000000 * ({roll('avg', f'(abs(ret_lag1) / nullif({TRADED}, 0))', 21, 5)})"}


@query(f"""WITH {RETURNS}, b AS (SELECT *, {RISK['market_beta_1y']} AS beta, {roll('avg', 'ret_lag1', 252, 63)} AS m, {roll('avg', 'market_ret_lag1', 252, 63)} AS mm FROM base),
res AS (SELECT *, ret_lag1 - (m - beta * mm) - beta * market_ret_lag1 AS e FROM b)
SELECT date, ticker, {', '.join(r(e, n, 5) for n, e in RISK.items())}, {r(roll('stddev_samp', 'e', 252, 63), 'idiosyncratic_volatility', 5)} FROM res""")
def style_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.style_price_factors(load(spark, sf_dir, "bars")).select("date", "ticker", *RISK, "idiosyncratic_volatility"), 5)


@query(f"WITH {RETURNS} SELECT date, ticker, {', '.join(r(e, n, 4) for n, e in LIQUID.items())} FROM base")
def style_liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.style_price_factors(load(spark, sf_dir, "bars")).select("date", "ticker", "dollar_volume_1m", (F.col("amihud_illiquidity") * 1_000_000).alias("amihud_illiquidity"))
    return rounded(out, 4)


@query(f"""WITH {RETURNS}, m AS (SELECT date, ticker, {lagged(1, 127)} AS x, {GROUP} AS grp FROM base)
SELECT date, ticker, {r('CASE WHEN grp IS NOT NULL THEN x - avg(x) OVER (PARTITION BY date, grp) END', 'industry_relative_momentum')} FROM m""")
def industry_relative_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = load(spark, sf_dir, "bars")
    industry = bars.select("ticker").distinct().withColumn("industry", F.expr(GROUP))
    return rounded(X.industry_relative(X.style_price_factors(bars), industry).select("date", "ticker", "industry_relative_momentum"))


KNOWN = f"""{oracle('bars')}, {oracle('filings')}, known AS (SELECT *, filed_date + INTERVAL 1 DAY AS available_date FROM filings)"""


@query(f"""WITH {KNOWN} SELECT b.date, b.ticker, k.filing AS f_filing, k.filed_date AS f_filed_date, {r('k.assets', 'f_assets', 2)} FROM bars b ASOF LEFT JOIN known k ON b.ticker = k.ticker AND b.date >= k.available_date""")
def asof_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = A.available(load(spark, sf_dir, "filings"), 1)
    out = A.asof(load(spark, sf_dir, "bars").select("date", "ticker"), facts, ["ticker"], "date", "available_date", ["filing"], prefix="f_")
    return rounded(out.select("date", "ticker", "f_filing", "f_filed_date", "f_assets"), 2)


@query(f"""WITH {KNOWN}, pit AS (SELECT b.date, b.ticker, lag(b.close) OVER (PARTITION BY b.ticker ORDER BY b.date) AS close_lag1, k.assets, k.book_equity, k.revenue_ttm, k.filed_date FROM bars b ASOF LEFT JOIN known k ON b.ticker = k.ticker AND b.date >= k.available_date)
SELECT date, ticker, filed_date AS source_filed_date, {r('book_equity / nullif(1000 * close_lag1, 0)', 'book_to_price')}, {r('revenue_ttm / nullif(1000 * close_lag1, 0)', 'sales_to_price')}, {r('revenue_ttm / nullif(assets, 0)', 'asset_turnover')},
  {r('assets / nullif(lag(assets, 252) OVER ' + W + ', 0) - 1', 'asset_growth_yoy')}, {r('revenue_ttm / nullif(lag(revenue_ttm, 252) OVER ' + W + ', 0) - 1', 'revenue_growth_yoy')}, {r('CASE WHEN close_lag1 > 0 AND assets IS NOT NULL THEN ln(1000 * close_lag1) END', 'log_market_cap')} FROM pit""")
def fundamental_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = load(spark, sf_dir, "filings").withColumn("shares_outstanding", F.lit(1000.0))
    out = X.fundamental_factors(X.style_price_factors(load(spark, sf_dir, "bars")), facts)
    return rounded(out.select("date", "ticker", "source_filed_date", "book_to_price", "sales_to_price", "asset_turnover", "asset_growth_yoy", "revenue_growth_yoy", "log_market_cap"))


@query(f"""WITH {KNOWN}, pit AS (SELECT b.date, b.ticker, k.assets AS e, k.book_equity AS s FROM bars b ASOF LEFT JOIN known k ON b.ticker = k.ticker AND b.date >= k.available_date)
SELECT date, ticker, {r('e / nullif(lag(e, 21) OVER ' + W + ', 0) - 1', 'fy1_eps_revision_1m')}, {r('e / nullif(lag(e, 63) OVER ' + W + ', 0) - 1', 'fy2_eps_revision_3m')}, {r('s - lag(s, 21) OVER ' + W, 'recommendation_change', 3)} FROM pit""")
def analyst_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    estimates = load(spark, sf_dir, "filings").select("ticker", "filed_date", F.col("assets").alias("fy1_eps_estimate"), F.col("assets").alias("fy2_eps_estimate"), F.col("book_equity").alias("recommendation_score"), F.col("filed_date").alias("date"))
    out = X.analyst_factors(load(spark, sf_dir, "bars").select("date", "ticker"), estimates)
    three = rounded(out.select("date", "ticker", "recommendation_change"), 3)
    return rounded(out.select("date", "ticker", "fy1_eps_revision_1m", "fy2_eps_revision_3m")).join(three, ["date", "ticker"])


# Of the fifty factors those for which prices and the three facts of the filings suffice; the others are NULL.
PRICED = STYLE | RISK | {"dollar_volume_1m": LIQUID["dollar_volume_1m"], "amihud_illiquidity": roll("avg", f"(abs(ret_lag1) / nullif({TRADED}, 0))", 21, 5)}
FILED = {
    "asset_turnover": "revenue_ttm / nullif(assets, 0)", "leverage": "0 / nullif(assets, 0)", "asset_growth_yoy": f"assets / nullif(lag(assets, 252) OVER {W}, 0) - 1",
    "revenue_growth_yoy": f"revenue_ttm / nullif(lag(revenue_ttm, 252) OVER {W}, 0) - 1",
}
LIBRARY = f"""WITH {RETURNS}, {KNOWN[KNOWN.index('filings AS'):]}, pit AS (SELECT b.date, b.ticker, k.assets, k.revenue_ttm, k.filed_date FROM bars b ASOF LEFT JOIN known k ON b.ticker = k.ticker AND b.date >= k.available_date),
numbered AS (SELECT date, ticker, close_lag1, row_number() OVER {W} AS k FROM base),
falls AS (SELECT date, ticker, min(c / top - 1) AS max_drawdown_1y FROM (SELECT a.date, a.ticker, b.close_lag1 AS c, max(b.close_lag1) OVER (PARTITION BY a.ticker, a.date ORDER BY b.date) AS top, count(*) OVER (PARTITION BY a.ticker, a.date) AS n
  FROM numbered a JOIN numbered b ON a.ticker = b.ticker AND b.k BETWEEN a.k - 251 AND a.k WHERE b.close_lag1 IS NOT NULL) WHERE n >= 63 GROUP BY date, ticker),
b AS (SELECT *, {RISK['market_beta_1y']} AS beta, {roll('avg', 'ret_lag1', 252, 63)} AS m, {roll('avg', 'market_ret_lag1', 252, 63)} AS mm FROM base),
res AS (SELECT *, ret_lag1 - (m - beta * mm) - beta * market_ret_lag1 AS e FROM b),
priced AS (SELECT date, ticker, {', '.join(f'{e} AS {n}' for n, e in PRICED.items())}, {roll('stddev_samp', 'e', 252, 63)} AS idiosyncratic_volatility FROM res),
filed AS (SELECT date, ticker, filed_date, {', '.join(f'{e} AS {n}' for n, e in FILED.items())} FROM pit),
raw AS (SELECT date, ticker, filed_date, max_drawdown_1y, idiosyncratic_volatility, {', '.join([*PRICED, *FILED])} FROM priced JOIN filed USING (date, ticker) LEFT JOIN falls USING (date, ticker))"""
MADE = [*PRICED, *FILED, "max_drawdown_1y", "idiosyncratic_volatility"]
KEPT = {
    f: f"CASE WHEN c_{f} IS NOT NULL THEN CASE WHEN max(c_{f}) OVER d = min(c_{f}) OVER d THEN 0 ELSE (c_{f} - avg(c_{f}) OVER d) / nullif(stddev_pop(c_{f}) OVER d, 0) END END" for f in MADE
}


@query(f"""{LIBRARY}, edged AS (SELECT *, {', '.join(f'quantile_cont({f}, [0.01, 0.99]) OVER (PARTITION BY date) AS q_{f}' for f in MADE)} FROM raw),
clipped AS (SELECT *, {', '.join(f'CASE WHEN {f} IS NOT NULL THEN greatest(least({f}, q_{f}[2]), q_{f}[1]) END AS c_{f}' for f in MADE)} FROM edged)
SELECT date, ticker, filed_date AS source_filed_date, filed_date AS latest_filing_date, {', '.join(r(f, f, 7) if f in MADE else f'NULL::DOUBLE AS {f}' for f in X.STYLE_FACTORS)},
{', '.join(r(KEPT[f], f'{f}_zscore', 3) if f in MADE else f'NULL::DOUBLE AS {f}_zscore' for f in X.STYLE_FACTORS)} FROM clipped WINDOW d AS (PARTITION BY date)""")
def style_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifty factors and their z-scores."""
    out = X.style_factors(load(spark, sf_dir, "bars"), load(spark, sf_dir, "filings"))
    return out.select(*[(F.round(c, 3 if c.endswith("_zscore") else 7) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(f"""WITH {RETURNS}, s AS (SELECT {lagged(1, 64)} AS a, {lagged(21, 253)} AS b FROM base) SELECT 'momentum_3m' AS factor, {r('count(a) / count(*)', 'coverage')} FROM s UNION ALL SELECT 'momentum_12m_skip_1m', {r('count(b) / count(*)', 'coverage')} FROM s""")
def factor_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.coverage(X.style_price_factors(load(spark, sf_dir, "bars")), ["momentum_3m", "momentum_12m_skip_1m"]))


@query(f"""{LIBRARY}, c AS (SELECT unnest({X.STYLE_FACTORS}) AS factor, unnest([{', '.join(f'count({f}) / count(*)' if f in MADE and f not in FILED else '0.0' for f in X.STYLE_FACTORS)}]) AS coverage FROM raw),
s AS (SELECT unnest({[s for s, names in X.STYLES.items() for _ in names]}) AS style, unnest({X.STYLE_FACTORS}) AS factor) SELECT style, {r('avg(coverage)', 'coverage')} FROM c JOIN s USING (factor) GROUP BY style""")
def coverage_by_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(X.coverage_by_style(P.coverage(X.style_factors(load(spark, sf_dir, "bars"), standardize=False), X.STYLE_FACTORS)))
