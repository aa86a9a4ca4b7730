"""Queries on how factors order returns, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators import diagnostics as D
from larkspur.operators import evaluation as V
from larkspur.operators import panel as P
from larkspur.plans.adapters import load, oracle
from larkspur.plans.factor_queries import r, rounded

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return keep


FACTORS = ["momentum", "momentum_20", "surge", "distance"]


def guarded(x: str, y: str, least: int = 2) -> str:
    return f"CASE WHEN count(*) >= {least} AND min({x}) < max({x}) AND min({y}) < max({y}) THEN corr({x}, {y}) END"


def avg_rank(x: str, keys: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0"


def ic_sql(source: str, f: str, y: str, keys: str = "date", least: int = 2) -> str:
    """Daily coefficients of a source with columns f and y."""
    using = f"USING ({keys})"
    return f"""SELECT {keys}, IC, RankIC, coalesce(c, 0) AS coverage, total_rows, coalesce(fd, 0) AS factor_nunique, coalesce(yd, 0) AS return_nunique, fs AS factor_std, ys AS return_std
      FROM (SELECT {keys}, count(*) AS total_rows FROM {source} GROUP BY ALL) AS t LEFT JOIN
      (SELECT {keys}, count(*) AS c, {guarded(f, y, least)} AS IC, {guarded('fr', 'yr', least)} AS RankIC, count(DISTINCT {f}) AS fd, count(DISTINCT {y}) AS yd, CASE WHEN min({f}) = max({f}) THEN 0 ELSE stddev_pop({f}) END AS fs, CASE WHEN min({y}) = max({y}) THEN 0 ELSE stddev_pop({y}) END AS ys
       FROM (SELECT *, {avg_rank(f, keys)} AS fr, {avg_rank(y, keys)} AS yr FROM {source} WHERE {f} IS NOT NULL AND {y} IS NOT NULL) AS v GROUP BY {keys}) AS g {using}"""


SIGNALS = f"WITH {oracle('signals')}"
IC = f"{SIGNALS}, ic AS ({ic_sql('signals', 'momentum', 'fwd5')})"


@query(f"{IC} SELECT date, {r('IC', 'IC')}, {r('RankIC', 'RankIC')}, coverage, total_rows, factor_nunique, return_nunique, {r('factor_std', 'factor_std')}, {r('return_std', 'return_std')} FROM ic")
def daily_information_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.daily_ic(load(spark, sf_dir, "signals"), "momentum", "fwd5").drop("valid_count"))


SUMMARY = ", ".join(f"{r(f'avg({c})', c)}, {r(f'avg({c}) / nullif(stddev_samp({c}), 0) * sqrt(252)', c + 'IR', 5)}, count({c}) AS {c}_count, count(*) - count({c}) AS {c}_nan_count" for c in ("IC", "RankIC"))


def five(df: DataFrame, names: list[str], digits: int = 5) -> DataFrame:
    """rounded(), the named columns to fewer digits."""
    return df.select(*[(F.round(c, digits if c in names else 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"{IC} SELECT {SUMMARY}, count(CASE WHEN abs(RankIC) < 1e-12 THEN 1 END) AS RankIC_zero_count, {r('avg(coverage)', 'coverage')} FROM ic")
def information_coefficient_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five(V.summarize_ic(V.daily_ic(load(spark, sf_dir, "signals"), "momentum", "fwd5")), ["ICIR", "RankICIR"])


REBALANCED = f"days AS (SELECT date, row_number() OVER (ORDER BY date) AS k FROM (SELECT DISTINCT date FROM signals) AS d), kept AS (SELECT s.* FROM signals s JOIN days USING (date) WHERE (k - 1) % 20 = 0)"


@query(f"""{SIGNALS}, {REBALANCED}, ic AS ({ic_sql('kept', 'momentum', 'fwd20')}) SELECT a.*, b.* FROM
(SELECT count(*) AS total_rows, count(DISTINCT date) AS date_count, {r('count(momentum) / count(*)', 'factor_non_null_ratio')}, {r('count(fwd20) / count(*)', 'return_non_null_ratio')} FROM signals) a,
(SELECT sum(total_rows)::BIGINT AS rows_after_rebalance, count(*) AS date_count_after_rebalance, {r('avg(coverage)', 'avg_daily_valid_count')}, min(coverage) AS min_daily_valid_count, max(coverage) AS max_daily_valid_count,
 {r('avg(factor_std)', 'daily_factor_std_mean')}, {r('min(factor_std)', 'daily_factor_std_min')}, count(CASE WHEN factor_std = 0 THEN 1 END) AS daily_factor_std_zero_count, {r('avg(return_std)', 'daily_return_std_mean')}, {r('min(return_std)', 'daily_return_std_min')},
 count(CASE WHEN return_std = 0 THEN 1 END) AS daily_return_std_zero_count, count(*) - count(RankIC) AS rankic_nan_count, count(CASE WHEN abs(RankIC) < 1e-12 THEN 1 END) AS rankic_zero_count, count(RankIC) AS rankic_non_null_count FROM ic) b""")
def factor_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.factor_health(load(spark, sf_dir, "signals"), "momentum", "fwd20", every=20))


@query(f"{SIGNALS}, {REBALANCED} SELECT date, ticker FROM kept")
def rebalance_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rebalance_dates(load(spark, sf_dir, "signals"), 20).select("date", "ticker")


def rolling_sql(n: int, least: int, part: str = "") -> str:
    w = f"OVER ({part} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return r(f"CASE WHEN count(RankIC) {w} >= {least} THEN avg(RankIC) {w} END", f"rolling_{n}d_RankIC")


@query(f"{IC} SELECT date, {rolling_sql(20, 5)}, {rolling_sql(60, 15)}, {rolling_sql(120, 30)} FROM ic")
def rolling_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ic = V.daily_ic(load(spark, sf_dir, "signals"), "momentum", "fwd5")
    return rounded(V.rolling_mean(ic, {20: 5, 60: 15, 120: 30}).select("date", *[f"rolling_{n}d_RankIC" for n in (20, 60, 120)]))


EDGES = " + ".join(f"CASE WHEN rn - 1 > (n - 1) * {k / 10}::DOUBLE THEN 1 ELSE 0 END" for k in range(1, 10))


def decile_sql(source: str, f: str, keys: str = "date") -> str:
    """source's rows with a factor, and their decile."""
    return f"SELECT *, CASE WHEN n >= 10 THEN 1 + {EDGES} END AS decile FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {f}, ticker) AS rn, count(*) OVER (PARTITION BY {keys}) AS n FROM {source} WHERE {f} IS NOT NULL) AS k"


DECILES = f"{SIGNALS}, marked AS ({decile_sql('signals', 'momentum')}), dr AS (SELECT date, decile, avg(fwd5) AS ret FROM marked WHERE decile IS NOT NULL AND fwd5 IS NOT NULL GROUP BY date, decile)"


@query(f"{DECILES} SELECT date, decile, {r('ret', 'return', 8)} FROM dr")
def decile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.decile_returns(load(spark, sf_dir, "signals"), "momentum", "fwd5"), 8)


LONG_SHORT = f"{DECILES}, ls AS (SELECT date, max(CASE WHEN decile = 10 THEN ret END) AS a, max(CASE WHEN decile = 1 THEN ret END) AS b FROM dr GROUP BY date), sp AS (SELECT *, a - b AS x FROM ls)"


@query(f"{LONG_SHORT} SELECT date, {r('a', 'long_return', 8)}, {r('b', 'short_return', 8)}, {r('x', 'long_short_return', 8)}, {r('ln(product(1 + coalesce(x / 100, 0)) OVER (ORDER BY date))', 'log_growth', 8)} FROM sp")
def long_short_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running product is of hundredths, and shown as a logarithm: weekly spreads of these bars compound beyond any rounding."""
    out = V.long_short(load(spark, sf_dir, "signals"), "momentum", "fwd5").drop("cumulative_return")
    from pyspark.sql import Window
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(out.withColumn("log_growth", F.ln(F.product(1 + F.coalesce(F.col("long_short_return") / 100, F.lit(0.0))).over(w))), 8)


@query(f"""{LONG_SHORT}, c AS (SELECT date, x / 100 AS x, product(1 + x / 100) OVER (ORDER BY date) AS c FROM sp WHERE x IS NOT NULL), d AS (SELECT *, c / max(c) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS d FROM c)
SELECT {r('max_by(c, date) ** (52.0 / count(*)) - 1', 'annualized_return')}, {r('avg(x) / stddev_samp(x) * sqrt(52)', 'Sharpe')}, {r('min(d)', 'max_drawdown')} FROM d""")
def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.long_short(load(spark, sf_dir, "signals"), "momentum", "fwd5").withColumn("x", F.col("long_short_return") / 100)
    return rounded(V.performance(out, "x", 52))


ENDS = f"""{SIGNALS}, e AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY momentum, ticker) AS up, row_number() OVER (PARTITION BY date ORDER BY momentum DESC, ticker DESC) AS down, greatest(1, floor(count(*) OVER (PARTITION BY date) * 0.2::DOUBLE)) AS n FROM signals WHERE momentum IS NOT NULL),
m AS (SELECT date, ticker, 'top' AS side FROM e WHERE down <= n UNION ALL SELECT date, ticker, 'bottom' FROM e WHERE up <= n)"""


@query(f"{ENDS} SELECT date, ticker, side FROM m")
def extreme_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.extremes(load(spark, sf_dir, "signals"), "momentum", 0.2)


@query(f"""{ENDS}, h AS (SELECT side, date, list(DISTINCT ticker) AS now FROM m GROUP BY side, date), p AS (SELECT *, lag(now) OVER (PARTITION BY side ORDER BY date) AS was FROM h)
SELECT date, side, {r('CASE WHEN was IS NULL THEN 0 ELSE 1 - len(list_intersect(now, was)) / greatest(len(now), 1) END', 'turnover')} FROM p""")
def portfolio_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.turnover(V.extremes(load(spark, sf_dir, "signals"), "momentum", 0.2)))


@query(f"""{SIGNALS}, long AS (SELECT date, momentum, unnest([5, 10, 20]) AS horizon, unnest([fwd5, fwd10, fwd20]) AS y FROM signals), ic AS ({ic_sql('long', 'momentum', 'y', 'horizon, date')})
SELECT horizon, {SUMMARY}, count(CASE WHEN abs(RankIC) < 1e-12 THEN 1 END) AS RankIC_zero_count, {r('avg(coverage)', 'coverage')} FROM ic GROUP BY horizon""")
def factor_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return five(V.decay(load(spark, sf_dir, "signals"), "momentum", {5: "fwd5", 10: "fwd10", 20: "fwd20", 60: "fwd60"}), ["ICIR", "RankICIR"])


@query(f"{SIGNALS} SELECT date, {', '.join(r(f'avg({c})', c, 9) for c in [*FACTORS, 'fwd5'])} FROM signals GROUP BY date")
def series_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.mean_by_date(load(spark, sf_dir, "signals"), [*FACTORS, "fwd5"]), 9)


@query(f"{SIGNALS}, marked AS ({decile_sql('signals', 'momentum')}), d AS (SELECT date, decile, avg(fwd5) AS x FROM marked WHERE decile IS NOT NULL AND fwd5 IS NOT NULL GROUP BY ALL) SELECT decile, {r('avg(x)', 'return')}, count(x) AS days FROM d GROUP BY decile")
def average_decile_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.decile_bar(V.decile_returns(load(spark, sf_dir, "signals"), "momentum", "fwd5")))


@query(f"{SIGNALS} SELECT date, {r('count(CASE WHEN momentum IS NOT NULL AND fwd5 IS NOT NULL THEN 1 END) / count(*)', 'coverage')} FROM signals GROUP BY date")
def factor_coverage_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.coverage_by_date(load(spark, sf_dir, "signals"), "momentum", "fwd5"))


@query(f"WITH {oracle('preds')}, marked AS ({decile_sql('preds', 'momentum')}) SELECT decile, {r('avg(gate_news_prob)', 'mean_gate')}, count(*) AS rows FROM marked WHERE decile IS NOT NULL GROUP BY decile")
def gate_by_decile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.gate_by_decile(load(spark, sf_dir, "preds"), "momentum", "gate_news_prob"))


@query(f"""WITH {oracle('preds')}, e AS (SELECT min(gate_news_prob) AS a, max(gate_news_prob) AS b FROM preds) SELECT least(30, floor((gate_news_prob - a) / (b - a) * 30)::INT + 1)::INT AS bin, count(*) AS rows FROM preds, e GROUP BY 1""")
def gate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.histogram(load(spark, sf_dir, "preds"), "gate_news_prob")


LONG = f"{SIGNALS}, long AS (SELECT split, date, ticker, fwd5 AS label, unnest({FACTORS}) AS factor, unnest([{', '.join(FACTORS)}]) AS value FROM signals)"
ALL_IC = f"{LONG}, ic AS ({ic_sql('long', 'value', 'label', 'split, factor, date', 10)})"


def long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.long_factors(load(spark, sf_dir, "signals"), FACTORS, "fwd5")


@query(f"{ALL_IC} SELECT split, factor, date, {r('IC', 'IC')}, {r('RankIC', 'RankIC')}, coverage, total_rows FROM ic")
def all_factor_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.all_daily_ic(long(spark, sf_dir)))


@query(f"{ALL_IC} SELECT split, factor, date, {rolling_sql(60, 15, 'PARTITION BY factor, split')} FROM ic")
def rolling_rank_ic_by_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.rolling_mean(D.all_daily_ic(long(spark, sf_dir)), {60: 15}, keys=("factor", "split")).select("split", "factor", "date", "rolling_60d_RankIC"))


TABLE = f"""SELECT factor, split, avg(IC) AS IC, avg(IC) / nullif(stddev_samp(IC), 0) * sqrt(252) AS ICIR, avg(RankIC) AS RankIC, avg(RankIC) / nullif(stddev_samp(RankIC), 0) * sqrt(252) AS RankICIR, stddev_samp(IC) AS IC_std, stddev_samp(RankIC) AS RankIC_std,
 count(CASE WHEN IC > 1e-12 THEN 1 END) / nullif(count(IC), 0) AS positive_IC_ratio, count(CASE WHEN RankIC > 1e-12 THEN 1 END) / nullif(count(RankIC), 0) AS positive_RankIC_ratio, count(*) AS days, avg(coverage) AS avg_coverage, min(coverage) AS min_coverage, max(coverage) AS max_coverage, sum(coverage) / sum(total_rows) AS coverage_ratio FROM ic GROUP BY factor, split"""
MEASURES = ["IC", "ICIR", "RankIC", "RankICIR", "IC_std", "RankIC_std", "positive_IC_ratio", "positive_RankIC_ratio", "avg_coverage", "coverage_ratio"]


@query(f"{ALL_IC}, s AS ({TABLE}) SELECT factor, split, days, min_coverage, max_coverage, {', '.join(r(c, c, 5) for c in MEASURES)} FROM s")
def factor_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.summary(D.all_daily_ic(long(spark, sf_dir))), 5)


DIAG = f"""{LONG}, v AS (SELECT * FROM long WHERE value IS NOT NULL AND label IS NOT NULL), okd AS (SELECT split, factor, date FROM v GROUP BY ALL HAVING count(DISTINCT value) >= 10), vv AS (SELECT v.* FROM v JOIN okd USING (split, factor, date)),
marked AS ({decile_sql('vv', 'value', 'split, factor, date')}), day AS (SELECT split, factor, date, decile, avg(label) AS m, count(*) AS c FROM marked GROUP BY ALL), agg AS (SELECT split, factor, decile, avg(m) AS mean_return, count(*) AS days, avg(c) AS avg_count FROM day GROUP BY ALL)"""


@query(f"{DIAG} SELECT split, factor, decile, {r('mean_return', 'mean_return')}, days, {r('avg_count', 'avg_count')} FROM agg")
def diagnostic_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.decile_summary(long(spark, sf_dir)))


@query(f"""{DIAG}, ends AS (SELECT split, factor, date, max(CASE WHEN decile = 10 THEN m END) - max(CASE WHEN decile = 1 THEN m END) AS x FROM day GROUP BY ALL), t AS (SELECT split, factor, avg(x) AS top_bottom_return, avg(x) / stddev_samp(x) * sqrt(count(x)) AS top_bottom_tstat FROM ends GROUP BY ALL),
rk AS (SELECT *, {avg_rank('mean_return', 'split, factor')} AS k FROM agg), s AS (SELECT split, factor, corr(decile, k) AS decile_monotonic_score, max(CASE WHEN decile = 10 THEN mean_return END) AS top_decile_return, max(CASE WHEN decile = 1 THEN mean_return END) AS bottom_decile_return FROM rk GROUP BY ALL)
SELECT split, factor, {', '.join(r(c, c, 5) for c in ('decile_monotonic_score', 'top_decile_return', 'bottom_decile_return', 'top_bottom_return', 'top_bottom_tstat'))} FROM s JOIN t USING (split, factor)""")
def decile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.decile_metrics(long(spark, sf_dir)), 5)


def corr_sql(method: str) -> str:
    pairs = [(a, b) for i, a in enumerate(FACTORS) for b in FACTORS[i + 1 :]]
    rows = " UNION ALL ".join(f"SELECT split, date, '{a}' AS factor_a, '{b}' AS factor_b, {a} AS x, {b} AS y FROM ok WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in pairs)
    some = " OR ".join(f"{f} IS NOT NULL" for f in FACTORS)
    keys = "split, date, factor_a, factor_b"
    ranked = f"SELECT {keys}, {avg_rank('x', keys)} AS x, {avg_rank('y', keys)} AS y FROM p" if method == "spearman" else "SELECT * FROM p"
    return f"""{SIGNALS}, ok AS (SELECT * FROM (SELECT *, count(CASE WHEN {some} THEN 1 END) OVER (PARTITION BY split, date) AS c FROM signals) AS q WHERE c >= 10), p AS ({rows}), rk AS ({ranked}),
d AS (SELECT {keys}, {guarded('x', 'y', 10)} AS c FROM rk GROUP BY ALL) SELECT split, factor_a, factor_b, {r('avg(c)', 'corr')} FROM d GROUP BY ALL"""


@query(corr_sql("pearson"))
def factor_correlation_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.factor_correlations(load(spark, sf_dir, "signals"), FACTORS, "pearson"))


@query(corr_sql("spearman"))
def factor_correlation_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.factor_correlations(load(spark, sf_dir, "signals"), FACTORS, "spearman"))


WIDE = f"{ALL_IC}, s AS ({TABLE}), w AS (SELECT factor, max(CASE WHEN split = 'train' THEN RankIC END) AS a, max(CASE WHEN split = 'valid' THEN RankIC END) AS b, max(CASE WHEN split = 'test' THEN RankIC END) AS c FROM s GROUP BY factor)"
AGREE = "coalesce((a > 0 AND b > 0 AND c > 0) OR (a < 0 AND b < 0 AND c < 0), false)"


@query(f"""{WIDE} SELECT factor, {r('a', 'train_RankIC')}, {r('b', 'valid_RankIC')}, {r('c', 'test_RankIC')}, {AGREE} AS direction_consistent, coalesce(a * c < 0, false) OR coalesce(b * c < 0, false) AS unstable_flag,
 coalesce(abs(c) < 0.005, true) AS weak_flag, coalesce(sign(list_median([x FOR x IN [a, b, c] IF x IS NOT NULL]))::INT, 0) AS selected_direction FROM w""")
def stability_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.stability(D.summary(D.all_daily_ic(long(spark, sf_dir)))))


@query(f"{WIDE}, j AS (SELECT s.factor, s.split, s.RankIC, w.a, w.b, w.c FROM s JOIN w USING (factor)) SELECT factor, split, {r('RankIC', 'RankIC')}, coalesce(c < 0, false) AS direction_failed_test, NOT {AGREE} AS unstable_direction FROM j")
def direction_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.direction_flags(D.summary(D.all_daily_ic(long(spark, sf_dir)))).select("factor", "split", "RankIC", "direction_failed_test", "unstable_direction"))


HIGH = " UNION ALL ".join(f"SELECT *, '{m}' AS method FROM ({corr_sql(m)}) AS {m}" for m in ("pearson", "spearman"))
# One factor of each connected group of correlated ones; w, s as in WIDE.
KEEP = f"""names AS (SELECT unnest({FACTORS}) AS factor, unnest(range({len(FACTORS)})) AS i), edge AS (SELECT factor_a AS a, factor_b AS b FROM ({HIGH}) AS h WHERE abs(corr) >= 0.2), both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(n, label) AS (SELECT factor, i FROM names UNION SELECT both_ways.b, reach.label FROM reach JOIN both_ways ON both_ways.a = reach.n), grp AS (SELECT n AS factor, min(label) AS g FROM reach GROUP BY n),
sc AS (SELECT factor, i, g, c, {AGREE} AS direction_consistent, CASE WHEN t.split IS NOT NULL THEN coalesce(abs(c) * 100, 0) + coalesce(t.positive_RankIC_ratio, 0) + ({AGREE})::INT + coalesce(1 / (1 + t.RankIC_std), 0) END AS stability_score
  FROM names JOIN grp USING (factor) LEFT JOIN w USING (factor) LEFT JOIN (SELECT * FROM s WHERE split = 'test') t USING (factor)),
chosen AS (SELECT *, row_number() OVER o AS k, first_value(factor) OVER o AS kept, (SELECT coalesce(string_agg(x.factor, ';' ORDER BY x.i), '') FROM sc x WHERE x.g = sc.g AND x.factor <> sc.factor) AS correlated_with FROM sc WINDOW o AS (PARTITION BY g ORDER BY stability_score DESC NULLS LAST, c DESC NULLS LAST, i)),
choice AS (SELECT factor, CASE WHEN k = 1 THEN 'keep' ELSE 'drop' END AS keep_or_drop, CASE WHEN k > 1 THEN 'drop in favor of ' || kept WHEN correlated_with <> '' THEN 'best stability score among correlated factors' ELSE 'no abs(corr) >= threshold pair' END AS reason, correlated_with, c AS test_RankIC, direction_consistent, stability_score FROM chosen)"""
RECURSIVE_WIDE = WIDE.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{RECURSIVE_WIDE}, {KEEP} SELECT factor, keep_or_drop, reason, correlated_with, {r('test_RankIC', 'test_RankIC')}, direction_consistent, {r('stability_score', 'stability_score', 5)} FROM choice")
def keep_or_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = load(spark, sf_dir, "signals")
    table = D.summary(D.all_daily_ic(long(spark, sf_dir)))
    return five(D.keep_drop(FACTORS, table, D.high_pairs(signals, FACTORS, 0.2)), ["stability_score"])


@query(f"SELECT split, factor_a, factor_b, corr, abs(corr) AS abs_corr, method FROM ({HIGH}) AS h WHERE abs(corr) >= 0.2")
def high_correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.high_pairs(load(spark, sf_dir, "signals"), FACTORS, 0.2))


@query(f"""{WIDE}, k AS (SELECT factor, a, coalesce(greatest(a, 0), 0) AS raw FROM w) SELECT factor, {r('a', 'train_RankIC')}, {r('raw', 'raw_weight')}, {r('CASE WHEN sum(raw) OVER () > 0 THEN raw / sum(raw) OVER () ELSE 0.25 END', 'normalized_weight')}, CASE WHEN sum(raw) OVER () > 0 THEN raw > 0 ELSE true END AS used FROM k""")
def ic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.ic_weights(D.summary(D.all_daily_ic(long(spark, sf_dir))), FACTORS))


MEAN = "(coalesce(momentum, 0) + coalesce(momentum_20, 0)) / nullif((momentum IS NOT NULL)::INT + (momentum_20 IS NOT NULL)::INT, 0)"


@query(f"{SIGNALS} SELECT date, ticker, {r(MEAN, 'equal_weight', 8)}, {r('0.25 + coalesce(momentum, 0) * 0.5 - coalesce(surge, 0) * 0.125', 'linear', 8)} FROM signals")
def combined_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = load(spark, sf_dir, "signals")
    return rounded(out.select("date", "ticker", D.equal_weight(["momentum", "momentum_20"]).alias("equal_weight"), D.linear(["momentum", "surge"], [0.5, -0.125], 0.25).alias("linear")), 8)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = D.evaluate_scores(load(spark, sf_dir, "signals").withColumn("label", F.col("fwd5")), FACTORS, 20)
    return table


SCORED = f"""{DIAG}, ic AS ({ic_sql('long', 'value', 'label', 'split, factor, date')}),
rd AS (SELECT split, date, row_number() OVER (PARTITION BY split ORDER BY date) AS k FROM (SELECT DISTINCT split, date FROM signals) AS q), ends AS (SELECT split, factor, date, max(CASE WHEN decile = 10 THEN m END) AS hi, max(CASE WHEN decile = 1 THEN m END) AS lo FROM day JOIN rd USING (split, date) WHERE (k - 1) % 20 = 0 GROUP BY ALL),
t AS (SELECT split, factor, avg(hi - lo) AS ls, avg(hi - lo) / nullif(stddev_samp(hi - lo), 0) * sqrt(count(hi - lo)) AS tt, avg(hi) AS hi, avg(lo) AS lo FROM ends GROUP BY ALL),
g AS (SELECT split, factor, avg(IC) AS IC, avg(IC) / nullif(stddev_samp(IC), 0) * sqrt(252) AS ICIR, avg(RankIC) AS RankIC, avg(RankIC) / nullif(stddev_samp(RankIC), 0) * sqrt(252) AS RankICIR, avg(coverage) AS coverage FROM ic GROUP BY ALL), e AS (SELECT * FROM g LEFT JOIN t USING (split, factor))"""


@query(f"""{SCORED} SELECT factor AS model, split, {', '.join(r(c, c, 5) for c in ('IC', 'ICIR', 'RankIC', 'RankICIR', 'coverage'))}, {r('ls', 'long_short_return', 5)}, {r('tt', 'long_short_tstat', 5)}, {r('hi', 'top_decile_return', 5)}, {r('lo', 'bottom_decile_return', 5)}, {r('ls', 'top_bottom_return', 5)} FROM e""")
def score_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir), 5)


def of(split: str, c: str) -> str:
    return f"max(CASE WHEN split = '{split}' THEN {c} END)"


@query(f"""{SCORED}, m AS (SELECT factor AS model, {', '.join(f"{of(s, c)} AS {s}_{c}" for c in ('IC', 'RankIC') for s in ('train', 'valid', 'test'))}, {of('test', 'ICIR')} AS test_ICIR, {of('test', 'RankICIR')} AS test_RankICIR, {of('test', 'ls')} AS test_long_short_return, {of('test', 'tt')} AS test_long_short_tstat FROM e GROUP BY factor),
f AS (SELECT *, row_number() OVER (ORDER BY test_RankIC DESC NULLS LAST, model) AS k, coalesce((train_RankIC > 0 AND valid_RankIC > 0 AND test_RankIC > 0) OR (train_RankIC < 0 AND valid_RankIC < 0 AND test_RankIC < 0), false) AS agree FROM m)
SELECT model, {', '.join(r(f'{s}_{c}', f'{s}_{c}', 5) for c in ('IC', 'RankIC') for s in ('train', 'valid', 'test'))}, {', '.join(r(f'test_{c}', f'test_{c}', 5) for c in ('ICIR', 'RankICIR', 'long_short_return', 'long_short_tstat'))}, CASE WHEN k = 1 AND test_RankIC > 0 THEN 'best' WHEN test_RankIC > 0 AND agree THEN 'positive' WHEN test_RankIC > 0 THEN 'unstable' ELSE 'fail' END AS conclusion FROM f""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.compare_models(scored(spark, sf_dir)), 5)


@query(f"""{SIGNALS}, long AS (SELECT date, fwd5 AS y, unnest({FACTORS}) AS factor, unnest([{', '.join(FACTORS)}]) AS value FROM signals), ic AS ({ic_sql('long', 'value', 'y', 'factor, date')}), s AS (SELECT factor, avg(RankIC) AS RankIC FROM ic GROUP BY factor) SELECT factor, {r('RankIC', 'RankIC')} FROM s ORDER BY RankIC DESC NULLS LAST, factor LIMIT 3""")
def top_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(D.top_factors(load(spark, sf_dir, "signals"), FACTORS, "fwd5", 3).select("factor", "RankIC"))


@query(f"{SIGNALS}, v AS (SELECT date, ticker, ({avg_rank('fwd5', 'date')}) / count(*) OVER (PARTITION BY date) AS k FROM signals WHERE fwd5 IS NOT NULL) SELECT s.date, s.ticker, {r('k', 'label_rank')} FROM signals s LEFT JOIN v ON s.date = v.date AND s.ticker = v.ticker")
def percent_rank_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.percent_rank_label(load(spark, sf_dir, "signals"), "fwd5").select("date", "ticker", "label_rank"))


@query(f"""{SIGNALS}, z AS (SELECT date, ticker, momentum, CASE WHEN max(fwd5) OVER d > min(fwd5) OVER d THEN (fwd5 - avg(fwd5) OVER d) / nullif(stddev_pop(fwd5) OVER d, 0) END AS z FROM signals WINDOW d AS (PARTITION BY date)) SELECT date, ticker, {r('-momentum', 'momentum_alpha')}, {r('z', 'label_zscore')} FROM z""")
def directional_alphas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.alpha_panel(load(spark, sf_dir, "signals"), "fwd5", {"momentum_alpha": ("momentum", -1.0)})
    return rounded(out.select("date", "ticker", "momentum_alpha", "label_zscore"))


@query(f"{SIGNALS} SELECT count(*) AS rows, count(DISTINCT date) AS dates, count(DISTINCT ticker) AS tickers, min(date) AS first_date, max(date) AS last_date, 0::BIGINT AS repeated_keys, NULL::BIGINT AS rows_with_news FROM signals")
def panel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.quality(load(spark, sf_dir, "signals"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.daily_ic(load(spark, sf_dir, "signals"), "momentum", "fwd5"))


