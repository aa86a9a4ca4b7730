"""Gapless numbering inside groups without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def gapless(df: DataFrame, group: list[str], spread: Column, order: list, copies: str | None = None, out: str = "_rank", buckets: int = BUCKETS) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in (bucket, order) order, where bucket = spread modulo `buckets`.

    A group is numbered bucket by bucket, so the largest sort is a group's share of one bucket; the buckets' own
    counts (at most groups * buckets rows) give the offsets. With `copies`, a row stands for that many equal rows
    and gets the first of their numbers. Ties in `order` must be between rows that are equal in all that matters.
    """
    tagged = df.withColumn("_lk_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    weight = F.col(copies) if copies else F.lit(1)
    keys = [*group, "_lk_bucket"]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_lk_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys).agg(F.sum(weight).alias("_lk_n"))
        .withColumn("_lk_offset", F.coalesce(F.sum("_lk_n").over(before), F.lit(0)))
        .drop("_lk_n")
    )
    return (
        tagged.withColumn("_lk_inner", F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .join(offsets, keys)
        .withColumn(out, (F.col("_lk_offset") + F.col("_lk_inner")).cast("long"))
        .drop("_lk_bucket", "_lk_inner", "_lk_offset")
    )


CHUNK = 4096


def unfold(df: DataFrame, copies: str, first: str, out: str) -> DataFrame:
    """One row for each of the `copies` equal rows that a row stands for, numbered in `out` from `first` on.

    Chunks of copies go out to all tasks before they are unfolded, so a row that stands for a third of a table is no hot spot.
    """
    chunks = df.withColumn("_lk_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(CHUNK).cast("long")))).hint("rebalance")
    each = F.explode(F.sequence(F.col("_lk_from"), F.least(F.col("_lk_from") + CHUNK, F.col(copies)) - 1))
    return chunks.withColumn("_lk_i", each).withColumn(out, (F.col(first) + F.col("_lk_i")).cast("long")).drop("_lk_from", "_lk_i")
