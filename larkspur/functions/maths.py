"""Null-safe arithmetic, rolling statistics, ranks and standardisation. NULL is the only missing value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SQRT_YEAR = 252.0**0.5


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: Column | str) -> Column:
    """A double without NaN and infinities: those become NULL."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clean_doubles(df: DataFrame) -> DataFrame:
    """Every float and double column cleaned, in one projection."""
    return df.select(*[clean(f"`{n}`").alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes])


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; NULL where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def change(now: Column, then: Column) -> Column:
    return ratio(now, then) - 1.0


def positive_log(x: Column | str) -> Column:
    return F.when(col(x) > 0, F.ln(col(x)))


def by_entity(key: str = "ticker", date: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(date)


def by_date(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("date",)))


def rolling(f: Callable[[Column], Column], x: Column | str, n: int, least: int | None = None, window: WindowSpec | None = None) -> Column:
    """f over the last n rows, NULL unless at least `least` (n if not given) of them have a value."""
    w = (window or by_entity()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(x)).over(w) >= (n if least is None else least), f(col(x)).over(w))


def rolling_cov(a: Column | str, b: Column | str, n: int, least: int | None = None, window: WindowSpec | None = None) -> Column:
    """Sample covariance over the rows that have both."""
    w = (window or by_entity()).rowsBetween(-(n - 1), 0)
    both = F.count(F.when(col(a).isNotNull() & col(b).isNotNull(), 1)).over(w)
    return F.when(both >= (n if least is None else least), F.covar_samp(col(a), col(b)).over(w))


def rolling_beta(a: str, b: str, n: int, least: int | None = None, window: WindowSpec | None = None) -> Column:
    """Covariance over the rows with both, by the variance of b over all rows that have b."""
    return ratio(rolling_cov(a, b, n, least, window), rolling(F.var_samp, b, n, least, window))


def with_rolling_drawdown(df: DataFrame, x: str, outs: dict[str, tuple[int, int]], window: WindowSpec | None = None) -> DataFrame:
    """df with the deepest fall from a running maximum over the last n rows, as a share (0 or less), for each out: (n, least values).

    x is positive or NULL; what is neither finite nor positive counts as missing. A span of rows has a state: its highest and lowest value and its deepest
    fall. The states of two neighbouring spans give that of both, so spans of 1, 2, 4, ... rows come from one another by `lag`, and n rows are made of the spans
    of n's binary digits. An empty span is neutral. All steps share one order of the rows: one shuffle and one sort.
    """
    w = window or by_entity()
    value = F.when(clean(x) > 0, clean(x))
    out = df.withColumn("_lk_x", value).select("*", F.col("_lk_x").alias("_lk_hi0"), F.col("_lk_x").alias("_lk_lo0"), F.when(F.col("_lk_x").isNotNull(), F.lit(0.0)).alias("_lk_fall0"))
    State = tuple[Column, Column, Column]

    def state(k: int, back: int = 0) -> State:
        return tuple(F.lag(f"_lk_{c}{k}", back).over(w) if back else F.col(f"_lk_{c}{k}") for c in ("hi", "lo", "fall"))

    def joined(old: State, new: State) -> State:
        return F.greatest(old[0], new[0]), F.least(old[1], new[1]), F.least(old[2], new[2], ratio(new[1], old[0]) - 1.0)

    digits = {name: [k for k in range(n.bit_length()) if n >> k & 1] for name, (n, _) in outs.items()}
    for k in range(max(d[-1] for d in digits.values())):
        both = joined(state(k, 1 << k), state(k))
        out = out.select("*", *[c.alias(f"_lk_{name}{k + 1}") for name, c in zip(("hi", "lo", "fall"), both, strict=True)])
    results = []
    for name, (n, least) in outs.items():
        back, whole = 0, None
        for k in digits[name]:
            part = state(k, back)
            whole = part if whole is None else joined(part, whole)
            back += 1 << k
        enough = F.count("_lk_x").over(w.rowsBetween(-(n - 1), 0)) >= least
        results.append(F.when(enough, whole[2]).alias(name))
    return out.select(*[c for c in df.columns if c not in outs], *results)


def average_rank(x: Column | str, *keys: str) -> Column:
    """Rank from 1 in the group, ties at their mean. Rows without x must be gone."""
    return F.rank().over(by_date(*keys).orderBy(col(x))) + (F.count(F.lit(1)).over(Window.partitionBy(*(keys or ("date",)), col(x))) - 1) / 2.0


def correlation(x: Column | str, y: Column | str, least: int = 2) -> Column:
    """Pearson correlation as an aggregate; NULL on fewer than `least` pairs or where either side is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when((F.count(a) >= least) & ~constant, ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def decile_of_rank(rank: Column, n: Column, buckets: int = 10) -> Column:
    """Bucket of the rank-th of n values by right-closed interpolated edges of the ranks themselves; NULL under `buckets` values."""
    over = sum(((rank - 1) > (n - 1) * F.lit(k / buckets)).cast("int") for k in range(1, buckets))
    return F.when(n >= buckets, F.lit(1) + over)


def winsor(x: Column, low: Column, high: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def annual_ratio(mean: Column, std: Column) -> Column:
    """mean / std on a yearly scale; NULL on no spread."""
    return ratio(mean, std) * SQRT_YEAR


def zscores(df: DataFrame, columns: dict[str, str], how: str, keys: tuple[str, ...] = ("date",), limits: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Cross-sectional z-scores of columns (new name by old name), population spread.

    how: "filled" (winsorised; a date without spread is 0 for every row, also for missing ones), "kept"
    (winsorised; a date without spread is 0 where there is a value) or "plain" (not winsorised; NULL without spread).
    All columns share one shuffle by date.
    """
    if how not in ("filled", "kept", "plain"):
        raise ValueError(f"no z-score of kind {how}")
    w = Window.partitionBy(*keys)
    names = list(columns)
    base = df.columns
    x = {n: clean(f"`{n}`") for n in names}
    if how != "plain":
        edges = df.select("*", *[F.percentile(x[n], F.array(*map(F.lit, limits))).over(w).alias(f"_q_{n}") for n in names])
        df = edges.select(*base, *[winsor(x[n], F.get(f"_q_{n}", F.lit(0)), F.get(f"_q_{n}", F.lit(1))).alias(f"_x_{n}") for n in names])
    else:
        df = df.select("*", *[x[n].alias(f"_x_{n}") for n in names])
    moments = df.select("*", *[f(F.col(f"_x_{n}")).over(w).alias(f"_{k}_{n}") for n in names for k, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))])
    out = []
    for n in names:
        v, m, s = F.col(f"_x_{n}"), F.col(f"_m_{n}"), F.col(f"_s_{n}")
        flat = F.col(f"_lo_{n}").isNull() | (F.col(f"_lo_{n}") == F.col(f"_hi_{n}")) | (s == 0)
        score = ratio(v - m, s)
        if how == "filled":
            score = F.when(flat, 0.0).otherwise(score)
        elif how == "kept":
            score = F.when(v.isNull(), None).when(flat, 0.0).otherwise(score)
        else:
            score = F.when(~flat, score)
        out.append(score.alias(columns[n]))
    return moments.select(*[c for c in base if c not in columns.values()], *out)
