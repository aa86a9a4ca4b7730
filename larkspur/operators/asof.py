"""Point-in-time joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The columns that can date a fact, the first that exists wins; only the first needs no lag.
DATE_COLUMNS = ("available_date", "filed_date", "source_filed_date", "latest_filing_date", "date")
BLOCK = 64


def available(facts: DataFrame, lag_days: int = 1) -> DataFrame:
    """facts with available_date: given, or the filing date and `lag_days` calendar days."""
    source = next((c for c in DATE_COLUMNS if c in facts.columns), None)
    if source is None:
        raise KeyError(f"facts need one of {DATE_COLUMNS}")
    day = F.to_date(source)
    return facts.withColumn("available_date", day if source == "available_date" else F.date_add(day, lag_days))


def block_of(t: str, df: DataFrame, block: int) -> Column:
    """The number of the block of `block` days (dates and times) or units (numbers) that t lies in."""
    kind = df.schema[t].dataType
    place = F.unix_date(F.col(t).cast("date")) if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.col(t)
    return F.floor(place / block).cast("long")


def asof(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, tie: list[str] | None = None, prefix: str = "", block: int = BLOCK) -> DataFrame:
    """left with the columns of the latest whole row of right that is not later, per `by`; nulls of that row stay nulls.

    Time is cut into blocks of `block` days. The last fact of each (by, block) is an aggregate; a scan over those few gives every block the fact that it starts
    from; then each (by, block) is one group of its own, so a key that has most of the rows is many groups. Of facts on the same day the last by `tie` wins. A row
    without a time has no fact.
    """
    payload = [c for c in right.columns if c not in by]
    keys = [*by, "_block"]
    facts = right.where(F.col(right_on).isNotNull()).select(*by, block_of(right_on, right, block).alias("_block"), F.col(right_on).alias("_t"), F.struct(*[F.col(c) for c in tie or []], F.lit(0).alias("_")).alias("_tie"), F.struct(*payload).alias("_fact"))
    rows = left.select(*by, block_of(left_on, left, block).alias("_block"), F.col(left_on).alias("_t"), F.struct(*[c for c in left.columns if c not in by]).alias("_row"))

    last = facts.groupBy(*keys).agg(F.max_by("_fact", F.struct("_t", "_tie")).alias("_fact"))
    asked = rows.where("_block IS NOT NULL").select(*keys).distinct().withColumn("_asked", F.lit(True))
    before = Window.partitionBy(*by).orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    starts = last.unionByName(asked, allowMissingColumns=True).withColumn("_fact", F.last("_fact", ignorenulls=True).over(before)).where("_asked AND _fact IS NOT NULL").select(*keys, "_fact")

    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = (
        facts.withColumn("_side", F.lit(0))
        .unionByName(rows.withColumn("_side", F.lit(1)), allowMissingColumns=True)
        .unionByName(starts.withColumn("_side", F.lit(-1)), allowMissingColumns=True)  # no time: before all others
        .withColumn("_seen", F.last("_fact", ignorenulls=True).over(w)).where("_side = 1")
    )
    return seen.select(*by, "_row.*", *[F.col(f"_seen.{c}").alias(f"{prefix}{c}") for c in payload])
