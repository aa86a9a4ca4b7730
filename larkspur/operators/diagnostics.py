"""Many factors at once: summaries by factor and split, correlations, stability, choice and combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.maths import annual_ratio, clean, correlation, ratio, zscores
from larkspur.operators.correlations import pairwise
from larkspur.operators.evaluation import ZERO, daily_ic, diagnostic_deciles, spread_by, spread_of, summarize_ic
from larkspur.operators.panel import KEYS, keyed, long_form, require

LONG = ("split", "factor", "date")
LEAST = 10
# The directional factors, their sources and signs.
ALPHAS = {
    "RSI_alpha": ("RSI_zscore", -1.0),
    "beta_60d_alpha": ("beta_60d_zscore", 1.0),
    "max_drawdown_60d_alpha": ("max_drawdown_60d_zscore", -1.0),
    "momentum_20d_alpha": ("momentum_20d_zscore", -1.0),
    "reversal_5d_alpha": ("reversal_5d_zscore", 1.0),
    "volatility_20d_alpha": ("volatility_20d_zscore", 1.0),
}
WEAK = 0.005  # fixed value: a test rank coefficient below this says nothing


def long_factors(panel: DataFrame, factors: list[str], label: str) -> DataFrame:
    """split, date, ticker, label, factor, value; rows outside of all splits go."""
    return long_form(panel.where("split IS NOT NULL").withColumn("_label", F.col(label).cast("double")), ["split", *KEYS, "_label"], factors).withColumnRenamed("_label", "label")


def all_daily_ic(long: DataFrame, least: int = LEAST) -> DataFrame:
    """split, factor, date, IC, RankIC, coverage, total_rows: every factor and split in one aggregation."""
    return daily_ic(long, "value", "label", LONG, least).select(*LONG, "IC", "RankIC", F.col("valid_count").alias("coverage"), "total_rows")


def decile_days(long: DataFrame, n: int = 10) -> DataFrame:
    """split, factor, date, decile, mean_return, count: what the decile tables are made of."""
    return diagnostic_deciles(long, "value", "label", LONG, n)


def decile_summary(long: DataFrame, n: int = 10) -> DataFrame:
    """split, factor, decile, mean_return, days, avg_count: means of the days' means."""
    return summary_of_days(decile_days(long, n))


def summary_of_days(days: DataFrame) -> DataFrame:
    return days.groupBy("split", "factor", "decile").agg(F.avg("mean_return").alias("mean_return"), F.count(F.lit(1)).alias("days"), F.avg("count").alias("avg_count"))


def decile_metrics(long: DataFrame, n: int = 10) -> DataFrame:
    """split, factor and how monotonic their deciles are; top and bottom returns here are those of the summary."""
    return metrics_of_days(decile_days(long, n), n)


def metrics_of_days(days: DataFrame, n: int = 10) -> DataFrame:
    table = summary_of_days(days)
    w = Window.partitionBy("split", "factor")
    ranked = table.select("*", (F.rank().over(w.orderBy("mean_return")) + (F.count(F.lit(1)).over(Window.partitionBy("split", "factor", "mean_return")) - 1) / 2.0).alias("_rank"))
    shape = ranked.groupBy("split", "factor").agg(
        correlation(F.col("decile").cast("double"), F.col("_rank")).alias("decile_monotonic_score"),
        F.max(F.when(F.col("decile") == n, F.col("mean_return"))).alias("top_decile_return"), F.max(F.when(F.col("decile") == 1, F.col("mean_return"))).alias("bottom_decile_return"),
    )
    return shape.join(spread_of(days, LONG, n).select("split", "factor", "top_bottom_return", "top_bottom_tstat"), ["split", "factor"], "left")


def summary(ic: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """factor, split and fifteen measures of their daily coefficients, with the decile measures if given."""
    def share(c: str) -> Column:
        # What rounding leaves of a zero has no sign.
        return F.try_divide(F.count_if(F.col(c) > ZERO).cast("double"), F.count(c).cast("double"))

    out = ic.groupBy("factor", "split").agg(
        F.avg("IC").alias("IC"), annual_ratio(F.avg("IC"), F.stddev_samp("IC")).alias("ICIR"), F.avg("RankIC").alias("RankIC"), annual_ratio(F.avg("RankIC"), F.stddev_samp("RankIC")).alias("RankICIR"),
        F.stddev_samp("IC").alias("IC_std"), F.stddev_samp("RankIC").alias("RankIC_std"), share("IC").alias("positive_IC_ratio"), share("RankIC").alias("positive_RankIC_ratio"),
        F.count(F.lit(1)).alias("days"), F.avg("coverage").alias("avg_coverage"), F.min("coverage").alias("min_coverage"), F.max("coverage").alias("max_coverage"),
        ratio(F.sum("coverage"), F.sum("total_rows")).alias("coverage_ratio"),
    )
    return out.join(metrics, ["factor", "split"], "left") if metrics is not None else out


def factor_correlations(panel: DataFrame, factors: list[str], method: str, least: int = LEAST) -> DataFrame:
    """split, factor_a, factor_b (a before b in the list), corr: the mean over dates of the pairwise correlation."""
    return pairwise(panel, factors, (method,), least).drop("method")


def over_threshold(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """split, factor_a, factor_b, corr, abs_corr, method of the pairs at or over the threshold."""
    return pairs.withColumn("abs_corr", F.abs("corr")).where(F.col("abs_corr") >= threshold).select("split", "factor_a", "factor_b", "corr", "abs_corr", "method")


def high_pairs(panel: DataFrame, factors: list[str], threshold: float = 0.8) -> DataFrame:
    """The pairs at or over the threshold by values or by ranks, from one pass over the panel."""
    return over_threshold(pairwise(panel, factors, least=LEAST), threshold)


def _by_split(name: str = "RankIC") -> list[Column]:
    return [F.max(F.when(F.col("split") == s, F.col(name))).alias(f"{s}_{name}") for s in ("train", "valid", "test")]


def stability(table: DataFrame) -> DataFrame:
    """factor, its three rank coefficients, whether their signs agree, and the direction of their median."""
    wide = table.groupBy("factor").agg(*_by_split())
    three = F.array("train_RankIC", "valid_RankIC", "test_RankIC")
    agree = F.forall(three, lambda v: F.coalesce(v > 0, F.lit(False))) | F.forall(three, lambda v: F.coalesce(v < 0, F.lit(False)))
    known = F.array_sort(F.filter(three, lambda v: v.isNotNull()))
    n = F.size(known)
    median = F.when(n == 3, F.get(known, F.lit(1))).when(n == 2, (F.get(known, F.lit(0)) + F.get(known, F.lit(1))) / 2.0).otherwise(F.get(known, F.lit(0)))
    turned = F.coalesce(F.col("train_RankIC") * F.col("test_RankIC") < 0, F.lit(False)) | F.coalesce(F.col("valid_RankIC") * F.col("test_RankIC") < 0, F.lit(False))
    return wide.select(
        "*", agree.alias("direction_consistent"), turned.alias("unstable_flag"), F.coalesce(F.abs("test_RankIC") < WEAK, F.lit(True)).alias("weak_flag"), F.coalesce(F.signum(median).cast("int"), F.lit(0)).alias("selected_direction")
    )


def stability_score(flags: DataFrame, table: DataFrame) -> DataFrame:
    """flags with stability_score; NULL for a factor without a test row."""
    test = table.where("split = 'test'").select("factor", F.col("RankIC_std").alias("_std"), F.col("positive_RankIC_ratio").alias("_pos"), F.lit(True).alias("_there"))
    score = F.coalesce(F.abs("test_RankIC") * 100.0, F.lit(0.0)) + F.coalesce("_pos", F.lit(0.0)) + F.col("direction_consistent").cast("double") + F.coalesce(1.0 / (1.0 + F.col("_std")), F.lit(0.0))
    return flags.join(test, "factor", "left").withColumn("stability_score", F.when(F.col("_there"), score)).drop("_std", "_pos", "_there")


def groups_of(names: list[str], edges: list[tuple[str, str]]) -> dict[str, str]:
    """The first name of each name's connected group. Names are factor columns: few."""
    near: dict[str, set[str]] = {n: set() for n in names}
    for a, b in edges:
        if a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    out: dict[str, str] = {}
    for n in names:
        todo = [] if n in out else [n]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = n
                todo += near[x]
    return out


def keep_drop(factors: list[str], table: DataFrame, pairs: DataFrame) -> DataFrame:
    """factor, keep_or_drop, reason, correlated_with: one factor of each group of correlated ones, the best by score, then test coefficient."""
    edges = [(r["factor_a"], r["factor_b"]) for r in pairs.select("factor_a", "factor_b").distinct().collect()]
    group = groups_of(factors, edges)
    named = table.sparkSession.createDataFrame([(f, group[f], i) for i, f in enumerate(factors)], "factor string, _group string, _i int")
    scored = named.join(stability_score(stability(table), table), "factor", "left")
    w = Window.partitionBy("_group")
    best = w.orderBy(F.col("stability_score").desc_nulls_last(), F.col("test_RankIC").desc_nulls_last(), "_i")
    marked = scored.select("*", F.row_number().over(best).alias("_r"), F.first("factor").over(best.rowsBetween(Window.unboundedPreceding, 0)).alias("_keep"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "factor")).over(w)), lambda s: s["factor"]).alias("_all"))
    others = F.array_remove("_all", F.col("factor"))
    # The three reasons.
    reason = F.when(F.col("_r") > 1, F.concat(F.lit("drop in favor of "), F.col("_keep"))).when(F.size(others) > 0, "best stability score among correlated factors").otherwise("no abs(corr) >= threshold pair")
    return marked.select("factor", F.when(F.col("_r") == 1, "keep").otherwise("drop").alias("keep_or_drop"), reason.alias("reason"), F.array_join(others, ";").alias("correlated_with"), "test_RankIC", "direction_consistent", "stability_score")


def alpha_panel(panel: DataFrame, label: str, alphas: dict[str, tuple[str, float]] = ALPHAS) -> DataFrame:
    """panel with signed factors, label and the label's daily z-score (NULL without spread)."""
    require(panel, [*KEYS, label, *[s for s, _ in alphas.values()]], "panel")
    out = keyed(panel).withColumns({a: F.col(s).cast("double") * sign for a, (s, sign) in alphas.items()} | {"label": F.col(label).cast("double")})
    return zscores(out.withColumn("label", clean("label")), {"label": "label_zscore"}, "plain")


def direction_flags(table: DataFrame) -> DataFrame:
    """summary rows with direction_failed_test and unstable_direction of their factor."""
    s = stability(table).select("factor", F.coalesce(F.col("test_RankIC") < 0, F.lit(False)).alias("direction_failed_test"), (~F.col("direction_consistent")).alias("unstable_direction"))
    return table.join(s, "factor", "left")


def equal_weight(columns: list[str]) -> Column:
    """The mean of the values there are; NULL if none."""
    there = F.filter(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.size(there))


def linear(columns: list[str], weights: list[float], intercept: float = 0.0) -> Column:
    """Weighted sum, a missing value as 0."""
    out = F.lit(float(intercept))
    for c, w in zip(columns, weights, strict=True):
        out = out + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(w)
    return out


def ic_weights(table: DataFrame, factors: list[str]) -> DataFrame:
    """factor, train_RankIC, raw_weight (0 unless positive), normalized_weight, used; equal weights if none is positive."""
    named = table.sparkSession.createDataFrame([(f,) for f in factors], "factor string")
    own = named.join(table.where("split = 'train'").select("factor", F.col("RankIC").alias("train_RankIC")), "factor", "left")
    raw = F.coalesce(F.greatest("train_RankIC", F.lit(0.0)), F.lit(0.0))
    w = Window.partitionBy(F.lit(0))
    out = own.withColumn("raw_weight", raw).withColumn("_s", F.sum("raw_weight").over(w))
    return out.select("factor", "train_RankIC", "raw_weight", F.when(F.col("_s") > 0, ratio("raw_weight", "_s")).otherwise(1.0 / len(factors)).alias("normalized_weight"), F.when(F.col("_s") > 0, F.col("raw_weight") > 0).otherwise(True).alias("used"))


def score_ic(df: DataFrame, score: str, keys: tuple[str, ...] = ("split", "date")) -> DataFrame:
    return daily_ic(df, score, "label", keys).select(*keys, "IC", "RankIC", F.col("valid_count").alias("coverage"))


def evaluate_scores(df: DataFrame, scores: list[str], every: int = 20, n: int = 10) -> DataFrame:
    """model, split, coefficients on all dates and spreads on every N-th date of the split, for all scores in one pass."""
    long = long_form(df.where("split IS NOT NULL"), ["split", *KEYS, "label"], scores, "model", "score")
    ic = summarize_ic(score_ic(long, "score", ("model", "split", "date")), ("model", "split")).select("model", "split", "IC", "ICIR", "RankIC", "RankICIR", "coverage")
    spread = spread_by(long, "score", "label", ("model", "split", "date"), n, every)
    return ic.join(spread, ["model", "split"], "left").withColumnsRenamed({"top_bottom_return": "long_short_return", "top_bottom_tstat": "long_short_tstat"}).withColumn("top_bottom_return", F.col("long_short_return"))


def compare_models(table: DataFrame) -> DataFrame:
    """model and its three splits side by side, with a conclusion; the best positive test coefficient is "best"."""
    wide = table.groupBy("model").agg(*_by_split("IC"), *_by_split(), *[F.max(F.when(F.col("split") == "test", F.col(c))).alias(f"test_{c}") for c in ("ICIR", "RankICIR", "long_short_return", "long_short_tstat")])
    three = F.array("train_RankIC", "valid_RankIC", "test_RankIC")
    agree = F.forall(three, lambda v: F.coalesce(v > 0, F.lit(False))) | F.forall(three, lambda v: F.coalesce(v < 0, F.lit(False)))
    good = F.coalesce(F.col("test_RankIC") > 0, F.lit(False))
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("test_RankIC").desc_nulls_last(), "model")) == 1
    return wide.withColumn("conclusion", F.when(first & good, "best").when(good & agree, "positive").when(good, "unstable").otherwise("fail"))


def top_factors(panel: DataFrame, factors: list[str], label: str, n: int = 30, every: int = 1) -> DataFrame:
    """The n factors with the highest mean rank coefficient."""
    long = long_form(panel, [*KEYS, label], factors)
    return summarize_ic(daily_ic(long, "value", label, ("factor", "date"), every=every), ("factor",)).orderBy(F.col("RankIC").desc_nulls_last(), "factor").limit(n)
