"""Price, style and fundamental factors: no look-ahead, and the rules on hand-made rows."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from larkspur.functions import maths as M
from larkspur.operators import asof as A
from larkspur.operators import factors as X
from larkspur.operators import panel as P
from larkspur.operators.quantiles import exact_quantiles


def days(n, start=dt.date(2020, 1, 1)):
    return [d for d in (start + dt.timedelta(i) for i in range(2 * n + 10)) if d.weekday() < 5][:n]


def bars(spark, n=90, tickers=("A", "B", "C", "D"), shock=None):
    rows = []
    for k, t in enumerate(tickers):
        for i, d in enumerate(days(n)):
            c = 100.0 + i * (k + 1) * 0.1 + math.sin(i * (k + 2)) * 2
            up = 1.5 if shock == (t, i) else 1.0
            rows.append((d, t, c * 0.99 * up, c * 1.02 * up, c * 0.97 * up, c * up, 1000.0 * up + i * (k + 1)))
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume double")


def by_key(df):
    return {(r["date"], r["ticker"]): r.asDict() for r in df.collect()}


def same(a, b):
    return a is None and b is None or a is not None and b is not None and abs(a - b) < 1e-9


@pytest.mark.parametrize("build,allowed", [(lambda s, x: X.price_volume_factors(bars(s, shock=x), standardize=False), {"overnight_gap"}), (lambda s, x: X.style_price_factors(bars(s, shock=x)), set())])
def test_a_days_prices_do_not_touch_that_days_factors(spark, build, allowed):
    at = 80
    day, after = days(90)[at], days(90)[at + 1]
    plain, shocked = by_key(build(spark, None)), by_key(build(spark, ("B", at)))
    for t in "ABCD":
        for name, v in plain[day, t].items():
            if isinstance(v, (float, type(None))) and name not in allowed:
                assert same(v, shocked[day, t][name]), name
    assert any(not same(v, shocked[after, "B"][n]) for n, v in plain[after, "B"].items() if isinstance(v, float))


def test_momentum_uses_the_close_before(spark):
    rows = [(d, "A", 1.0, 1.0, 1.0, 100.0 + i, 10) for i, d in enumerate(days(70))]
    out = by_key(X.price_volume_factors(spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume long"), standardize=False))
    last = out[days(70)[-1], "A"]
    assert abs(last["momentum_5d"] - (168 / 163 - 1)) < 1e-12 and abs(last["momentum_60d"] - (168 / 108 - 1)) < 1e-12
    assert last["rsi_14"] is None  # no losing day
    assert out[days(70)[5], "A"]["momentum_5d"] is None


def test_labels_look_forward_and_are_no_features(spark):
    out = by_key(X.forward_returns(bars(spark, 30), (5, 20)))
    b = by_key(bars(spark, 30))
    first, fifth = days(30)[0], days(30)[5]
    assert abs(out[first, "A"]["future_5d_return"] - (b[fifth, "A"]["close"] / b[first, "A"]["close"] - 1)) < 1e-12
    assert out[days(30)[-1], "A"]["future_5d_return"] is None
    assert abs(sum(out[first, t]["future_5d_market_adjusted_return"] for t in "ABCD")) < 1e-12
    assert P.factor_columns(["a_zscore", "future_x_zscore", "b"]) == ["a_zscore"]
    assert P.safe_factor_columns(["z_zscore", "mean_emb_0_zscore", "a_zscore", "future_1_zscore", "news_count_zscore"]) == ["a_zscore", "z_zscore"]


def test_gaps_in_prices_are_padded_or_not(spark):
    rows = [(d, "A", c, 1.0) for d, c in zip(days(4), (10.0, None, 11.0, 12.0), strict=True)]
    df = spark.createDataFrame(rows, "date date, ticker string, close double, volume double")
    pad = [r["ret_1d"] for r in X.returns(df).orderBy("date").collect()]
    strict = [r["ret_1d"] for r in X.returns(df, pad=False).orderBy("date").collect()]
    assert pad[1] == 0.0 and abs(pad[2] - 0.1) < 1e-12 and strict[1] is None and strict[2] is None and abs(strict[3] - 12 / 11 + 1) < 1e-12


def test_filings_show_only_after_their_lag(spark):
    stock = spark.createDataFrame([(dt.date(2020, 3, d), "A") for d in (13, 15, 16, 17)], "date date, ticker string")
    facts = spark.createDataFrame([("a ", "2020-03-15", 5.0, None), ("A", "2020-03-16", None, 7.0)], "ticker string, filed_date string, assets double, book_equity double")
    known = A.available(facts.withColumn("ticker", F.upper(F.trim("ticker"))), 1)
    out = {r["date"].day: (r["f_assets"], r["f_book_equity"]) for r in A.asof(stock, known, ["ticker"], "date", "available_date", ["filed_date"], "f_").collect()}
    assert out == {13: (None, None), 15: (None, None), 16: (5.0, None), 17: (None, 7.0)}  # the latest whole row, nulls and all
    with pytest.raises(KeyError):
        A.available(spark.createDataFrame([("A", 1)], "ticker string, x int"))


def test_style_library_has_fifty_factors_and_scores(spark):
    out = X.style_factors(bars(spark, 30))
    assert len(X.STYLE_FACTORS) == 50 and out.columns == [*P.KEYS, "source_filed_date", "latest_filing_date", *X.STYLE_FACTORS, *[f"{f}_zscore" for f in X.STYLE_FACTORS]]
    assert out.where("roe IS NOT NULL OR fy1_eps_revision_1m IS NOT NULL").count() == 0
    assert out.where("reversal_5d_zscore IS NOT NULL").count() > 0


def test_fundamental_rules_on_missing_parts(spark):
    facts = spark.createDataFrame([("A", "2020-01-01", 100.0, 50.0, 10.0, None, 4.0, None, 1000.0, 20.0)], "ticker string, filed_date string, Assets double, book_equity double, operating_income_ttm double, depreciation_ttm double, short_term_debt double, cash_and_equivalents double, shares_outstanding double, dividends_ttm double")
    out = X.fundamental_factors(X.style_price_factors(bars(spark, 10, ("A",))), facts)
    r = out.orderBy(F.col("date").desc()).first()
    assert abs(r["leverage"] - 0.04) < 1e-12 and abs(r["roic"] - 7.9 / 54) < 1e-12 and r["ebitda_ev"] is None  # no cash, no enterprise value
    assert abs(r["shareholder_yield"] - r["dividend_yield"]) < 1e-15 and r["interest_coverage"] is None


def test_first_existing_alias_wins_even_if_null(spark):
    df = spark.createDataFrame([(None, 3.0)], "StockholdersEquity double, CommonStocksIncludingAdditionalPaidInCapital double")
    assert df.select(X.first_existing(df, X.FACTS["book_equity"])).first()[0] is None


@pytest.mark.parametrize("how,flat,missing", [("filled", 0.0, 0.0), ("kept", 0.0, None), ("plain", None, None)])
def test_zscores_without_spread(spark, how, flat, missing):
    df = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 1.0), ("d", "c", None), ("e", "a", 1.0), ("e", "b", 2.0), ("e", "c", float("nan"))], "date string, ticker string, x double")
    out = {(r["date"], r["ticker"]): r["z"] for r in M.zscores(df, {"x": "z"}, how).collect()}
    assert out["d", "a"] == flat and out["d", "c"] == missing
    assert out["e", "c"] is None and abs(out["e", "a"] + out["e", "b"]) < 1e-9
    with pytest.raises(ValueError):
        M.zscores(df, {"x": "z"}, "other")


def test_drawdown_and_betas_against_plain_python(spark):
    r = [0.01, -0.02, 0.03, None, 0.01, -0.01, 0.02, 0.0]
    m = [0.02, -0.01, 0.01, 0.01, None, -0.02, 0.03, 0.01]
    df = spark.createDataFrame([(d, "A", a, b) for d, a, b in zip(days(8), r, m, strict=True)], "date date, ticker string, a double, b double")
    got = [x["v"] for x in df.select("date", M.rolling_beta("a", "b", 5, 3).alias("v")).orderBy("date").collect()]
    for i, v in enumerate(got):
        rows = list(zip(r, m, strict=True))[max(0, i - 4) : i + 1]
        both = [(x, y) for x, y in rows if x is not None and y is not None]
        ys = [y for _, y in rows if y is not None]
        if len(both) < 3 or len(ys) < 3:
            assert v is None
            continue
        mx, my = sum(x for x, _ in both) / len(both), sum(y for _, y in both) / len(both)
        cov = sum((x - mx) * (y - my) for x, y in both) / (len(both) - 1)
        mean = sum(ys) / len(ys)
        assert abs(v - cov / (sum((y - mean) ** 2 for y in ys) / (len(ys) - 1))) < 1e-9


def test_drawdown_from_doubled_spans_matches_a_plain_one(spark, capsys):
    rng = random.Random(4)
    prices = {t: [rng.choice([None, float("nan"), 0.0]) if rng.random() < 0.15 else round(rng.uniform(1, 9), 2) for _ in range(n)] for t, n in (("A", 90), ("B", 1), ("C", 41), ("D", 300))}
    df = spark.createDataFrame([(d, t, x) for t, xs in prices.items() for d, x in zip(days(len(xs)), xs, strict=True)], "date date, ticker string, x double").repartition(3)
    outs = {"one": (1, 1), "seven": (7, 3), "sixty": (60, 20), "year": (252, 63)}
    made = M.with_rolling_drawdown(df, "x", outs)
    got = {(r["ticker"], r["date"]): r for r in made.collect()}
    for t, xs in prices.items():
        for i, d in enumerate(days(len(xs))):
            for name, (n, least) in outs.items():
                inside = [x for x in xs[max(0, i - n + 1) : i + 1] if x is not None and x == x and x > 0]
                want = min(x / max(inside[: k + 1]) - 1 for k, x in enumerate(inside)) if len(inside) >= least else None
                assert got[t, d][name] == want if want is None else abs(got[t, d][name] - want) < 1e-12
    M.with_rolling_drawdown(df, "x", outs).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan and "array" not in plan


def test_panel_joins_check_their_keys(spark):
    d = dt.date(2020, 1, 2)
    f = spark.createDataFrame([(d, " a", 1.0)], "date date, ticker string, x double")
    labels = spark.createDataFrame([(d, "A", 0.1)], "date date, ticker string, y double")
    chunks = spark.createDataFrame([(d, "A", "n1", "c1"), (d, "A", "n1", "c2"), (d, "B", "n2", "c3")], "date date, ticker string, source_news_id string, chunk_id string")
    row = P.stock_day_panel(f, labels, chunks).first()
    assert (row["ticker"], row["y"], row["news_count"], row["chunk_count"], row["has_news"]) == ("A", 0.1, 1, 2, 1)
    with pytest.raises(Exception, match="more than once"):
        P.stock_day_panel(f, labels.unionByName(labels), chunks).collect()
    with pytest.raises(KeyError):
        P.keyed(f.drop("ticker"))
    assert P.only_new(f, f.withColumn("z", F.lit(2)), ["date", "ticker"]).columns == ["date", "ticker", "x", "z"]


def test_asof_of_a_hot_ticker_by_blocks(spark):
    rng = random.Random(1)
    start = dt.date(2020, 1, 1)
    facts = [(t, start + dt.timedelta(rng.randrange(900)), rng.randrange(5), rng.choice([None, 1.0, 2.0, 3.0])) for t in ["HOT"] * 40 + ["B"] * 3 + [None] * 2 for _ in range(1)]
    facts += [("HOT", None, 1, 9.0)]
    rows = [("HOT", start + dt.timedelta(i % 1000), i) for i in range(6000)] + [(t, start + dt.timedelta(rng.randrange(-50, 1000)), 7) for t in ["B", "C", None] * 20] + [("HOT", None, -1)]
    left = spark.createDataFrame(rows, "ticker string, date date, n int").repartition(4)
    right = spark.createDataFrame(facts, "ticker string, day date, tie int, v double").repartition(3)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = A.asof(left, right, ["ticker"], "date", "day", ["tie"], "f_", block=20).withColumn("_p", F.spark_partition_id()).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(out) == len(rows)
    for r in out:
        known = sorted((f for f in facts if f[0] == r["ticker"] and f[1] is not None and r["date"] is not None and f[1] <= r["date"]), key=lambda f: (f[1], f[2]))
        ties = {f[3] for f in known if f[1:3] == known[-1][1:3]} if known else {None}
        assert r["f_v"] in ties and (r["f_day"], r["f_tie"]) == (known[-1][1:3] if known else (None, None))
    sizes = {}
    for r in out:
        sizes[r["_p"]] = sizes.get(r["_p"], 0) + 1
    assert len(sizes) == 16 and max(sizes.values()) < len(rows) / 4
    numbers = A.asof(spark.range(10).selectExpr("id", "1 AS k"), spark.createDataFrame([(1, 3, "a"), (1, 7, "b")], "k int, at long, x string"), ["k"], "id", "at", block=2)
    assert [r["x"] for r in numbers.orderBy("id").collect()] == [None] * 3 + ["a"] * 4 + ["b"] * 3


@pytest.mark.parametrize("kind", ["even", "ties", "outliers", "tiny", "one", "none"])
def test_exact_quantiles_by_refined_ranges(spark, kind):
    rng = random.Random(2)
    xs = {
        "even": [rng.random() for _ in range(3001)], "ties": [float(rng.randrange(3)) for _ in range(2000)] + [1.5], "outliers": [rng.gauss(0, 1) * 10.0 ** rng.randrange(-300, 300) for _ in range(2500)] + [1e308, -1e308],
        "tiny": [1.0 + i * 2.0**-52 for i in range(2000)], "one": [4.0], "none": [],
    }[kind]
    df = spark.createDataFrame([(x,) for x in [*xs, None, float("nan"), float("inf")]], "x double").repartition(3)
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    # Few ranges and values held, so that ranges are refined again and again.
    for ranges, held in ((8, 4), (1024, 16_384)):
        found = exact_quantiles(df, "x", probs, ranges, held)
        assert found["n"] == len(xs)
        ordered = sorted(xs)
        for p, q in zip(probs, found["quantiles"], strict=True):
            if not xs:
                assert q is None
                continue
            at = (len(xs) - 1) * p
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            assert q == (low if at == math.floor(at) else (math.ceil(at) - at) * low + (at - math.floor(at)) * high)
