"""Coefficients, deciles and their summaries on fixtures with known answers."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions import maths as M
from larkspur.operators import diagnostics as D
from larkspur.operators import evaluation as V
from larkspur.operators import panel as P

DAY = dt.date(2022, 1, 3)


def frame(spark, dates=3, n=20, f=lambda d, i: float(i), y=lambda d, i: i / 100.0):
    rows = [(DAY + dt.timedelta(d), f"T{i:02d}", f(d, i), y(d, i)) for d in range(dates) for i in range(n)]
    return spark.createDataFrame(rows, "date date, ticker string, factor double, ret double")


def test_monotone_factor_has_coefficient_one(spark):
    out = V.daily_ic(frame(spark), "factor", "ret").collect()
    assert all(abs(r["IC"] - 1) < 1e-12 and abs(r["RankIC"] - 1) < 1e-12 and r["coverage"] == 20 for r in out)
    ls = V.long_short(frame(spark), "factor", "ret").collect()
    assert all(r["long_short_return"] > 0 for r in ls)


def test_degenerate_dates_have_no_coefficient(spark):
    rows = [(DAY, f"T{i}", 1.0, i * 0.1) for i in range(5)] + [(DAY + dt.timedelta(1), f"T{i}", float(i) if i < 2 else None, 0.1 * i if i < 4 else None) for i in range(5)] + [(DAY + dt.timedelta(2), "T0", float("inf"), 1.0), (DAY + dt.timedelta(2), "T1", 1.0, 1.0)]
    out = {r["date"]: r for r in V.daily_ic(spark.createDataFrame(rows, "date date, ticker string, factor double, ret double"), "factor", "ret").collect()}
    assert out[DAY]["RankIC"] is None and out[DAY]["factor_std"] == 0.0 and out[DAY]["factor_nunique"] == 1
    second = out[DAY + dt.timedelta(1)]
    assert second["valid_count"] == 2 and abs(second["IC"] - 1) < 1e-12 and second["total_rows"] == 5
    third = out[DAY + dt.timedelta(2)]
    assert third["coverage"] == 2 and third["valid_count"] == 1 and third["IC"] is None


def test_rebalance_keeps_every_nth_date(spark):
    df = frame(spark, 40, 2)
    kept = sorted(r["date"] for r in P.rebalance_dates(df, 20).select("date").distinct().collect())
    assert kept == [DAY, DAY + dt.timedelta(20)] and P.rebalance_dates(df, 1) is df


@pytest.mark.parametrize("lo,hi", [(10, 120), (120, 400)])
def test_decile_edges_equal_interpolated_quantiles(spark, lo, hi):
    pairs = spark.range(lo, hi).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(1), F.col("id"))).alias("r"))
    got = pairs.select("n", "r", M.decile_of_rank(F.col("r"), F.col("n")).alias("d")).collect()
    want = {}
    for n in range(lo, hi):
        edges = np.quantile(np.arange(1, n + 1, dtype=float), np.arange(1, 10) / 10)
        want[n] = 1 + np.searchsorted(edges, np.arange(1, n + 1, dtype=float), side="left")
    assert all(x["d"] == want[x["n"]][x["r"] - 1] for x in got)
    assert pairs.sparkSession.range(1).select(M.decile_of_rank(F.lit(1), F.lit(9))).first()[0] is None


def test_average_ranks_and_percent_ranks(spark):
    df = spark.createDataFrame([(DAY, t, x) for t, x in zip("abcd", (2.0, 1.0, 2.0, None), strict=True)], "date date, ticker string, x double")
    out = {r["ticker"]: r["k"] for r in P.percent_rank_label(df, "x", "k").collect()}
    assert out["d"] is None and abs(out["a"] - 2.5 / 3) < 1e-12 and abs(out["b"] - 1 / 3) < 1e-12


def test_turnover_of_member_sets(spark):
    df = frame(spark, 2, 10, f=lambda d, i: float(i if d == 0 else -i))
    members = V.extremes(df, "factor", 0.2)
    out = {(r["date"], r["side"]): r["turnover"] for r in V.turnover(members).collect()}
    assert out[DAY, "top"] == 0.0 and out[DAY + dt.timedelta(1), "top"] == 1.0
    lone = V.extremes(frame(spark, 1, 1), "factor").collect()
    assert sorted(r["side"] for r in lone) == ["bottom", "top"]


def test_performance_of_a_known_series(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(i), x) for i, x in enumerate((0.1, -0.5, 0.2, None))], "date date, x double")
    r = V.performance(df, "x", 3).first()
    assert abs(r["annualized_return"] - (1.1 * 0.5 * 1.2 - 1)) < 1e-12 and abs(r["max_drawdown"] + 0.5) < 1e-12
    empty = V.performance(df.where("x > 9"), "x").first()
    assert empty["annualized_return"] is None and empty["Sharpe"] is None


def panel(spark):
    def rows():
        for d in range(12):
            for i in range(20):
                yield DAY + dt.timedelta(d), f"T{i:02d}", ("train", "valid", "test")[d // 4], float(i), float(-i), float((i * 7 + d * 3) % 20), i / 100.0
    return spark.createDataFrame(list(rows()), "date date, ticker string, split string, good double, bad double, noise double, label double")


def test_diagnostics_of_good_and_bad_factors(spark):
    p = panel(spark)
    long = D.long_factors(p, ["good", "bad", "noise"], "label")
    table = D.summary(D.all_daily_ic(long), D.decile_metrics(long))
    rows = {(r["factor"], r["split"]): r for r in table.collect()}
    assert abs(rows["good", "test"]["RankIC"] - 1) < 1e-9 and abs(rows["bad", "test"]["RankIC"] + 1) < 1e-9
    assert rows["good", "train"]["decile_monotonic_score"] > 0.999 and rows["good", "train"]["top_bottom_return"] > 0
    pairs = D.high_pairs(p, ["good", "bad", "noise"], 0.9)
    assert all(abs(r["corr"] + 1) < 1e-9 and (r["factor_a"], r["factor_b"]) == ("good", "bad") for r in pairs.collect()) and pairs.count() == 6
    flags = {r["factor"]: r for r in D.stability(table).collect()}
    assert flags["good"]["direction_consistent"] and flags["good"]["selected_direction"] == 1 and flags["bad"]["selected_direction"] == -1 and not flags["good"]["weak_flag"]
    keep = {r["factor"]: r for r in D.keep_drop(["good", "bad", "noise"], table, pairs).collect()}
    assert keep["good"]["keep_or_drop"] == "keep" and keep["bad"]["reason"] == "drop in favor of good" and keep["noise"]["correlated_with"] == ""


def test_flags_on_missing_splits(spark):
    table = spark.createDataFrame([("a", "train", 0.1), ("a", "test", -0.2), ("b", "train", 0.1), ("b", "valid", 0.2), ("b", "test", 0.001)], "factor string, split string, RankIC double")
    f = {r["factor"]: r for r in D.stability(table).collect()}
    assert f["a"]["unstable_flag"] and not f["a"]["direction_consistent"] and f["a"]["selected_direction"] == -1
    assert f["b"]["weak_flag"] and f["b"]["direction_consistent"] and not f["b"]["unstable_flag"]


def test_weights_and_scores(spark):
    table = spark.createDataFrame([("a", "train", 0.3), ("b", "train", 0.1), ("c", "train", -0.2)], "factor string, split string, RankIC double")
    w = {r["factor"]: r for r in D.ic_weights(table, ["a", "b", "c", "d"]).collect()}
    assert abs(w["a"]["normalized_weight"] - 0.75) < 1e-12 and not w["c"]["used"] and w["d"]["raw_weight"] == 0.0
    none = D.ic_weights(table.where("factor = 'c'"), ["c", "d"]).collect()
    assert all(r["normalized_weight"] == 0.5 and r["used"] for r in none)
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 3.0)], "x double, y double")
    assert [r[0] for r in df.select(D.equal_weight(["x", "y"])).collect()] == [1.0, None, 2.0]
    assert [r[0] for r in df.select(D.linear(["x", "y"], [2.0, 1.0], 0.5)).collect()] == [2.5, 0.5, 5.5]


def test_alpha_signs(spark):
    cols = [s for s, _ in D.ALPHAS.values()]
    rows = [(DAY, f"t{i}", *[float(i)] * 6, float(i)) for i in range(4)]
    df = spark.createDataFrame(rows, f"date date, ticker string, {', '.join(f'{c} double' for c in cols)}, future_20d_market_adjusted_return double")
    out = D.alpha_panel(df, "future_20d_market_adjusted_return").where("ticker = 'T3'").first()
    assert out["RSI_alpha"] == -3.0 and out["beta_60d_alpha"] == 3.0 and out["label_zscore"] > 1
    with pytest.raises(KeyError):
        D.alpha_panel(df.drop("RSI_zscore"), "future_20d_market_adjusted_return")


def test_model_comparison_names_the_best(spark):
    p = panel(spark).select("*")
    scores = D.evaluate_scores(p, ["good", "bad"], 2)
    out = {r["model"]: r["conclusion"] for r in D.compare_models(scores).collect()}
    assert out == {"good": "best", "bad": "fail"}
    with pytest.raises(KeyError):
        P.require(p, ["nothing"])


def test_histogram_and_coverage(spark):
    df = spark.createDataFrame([(float(i),) for i in range(31)], "x double")
    out = {r["bin"]: r["rows"] for r in V.histogram(df, "x", 30).collect()}
    assert out[30] == 2 and sum(out.values()) == 31
    same = V.histogram(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").collect()
    assert [(r["bin"], r["rows"]) for r in same] == [(1, 2)]
    cov = V.coverage_by_date(spark.createDataFrame([(DAY, 1.0, 1.0), (DAY, None, 1.0)], "date date, f double, r double"), "f", "r").first()
    assert cov["coverage"] == 0.5
