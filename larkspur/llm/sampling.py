"""Bounded samples by hash: the same rows whatever the partitions, a bound that holds at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bar(n: int, wanted: int) -> int:
    """The 64-bit hash up to which about 5/4 of `wanted` of n different hashes lie; all of them if there are few."""
    return min(2**63 - 1, -(2**63) + (5 * wanted * 2**64) // (4 * max(1, n)))


def lowest(df: DataFrame, order: Column, wanted: int, n: int | None = None) -> DataFrame:
    """The rows with the `wanted` lowest different values of `order` (a 64-bit hash), one row for each.

    Rows are cut to a range of hashes before the sort, so no task gets more than a quarter above what is wanted. n: how many
    different hashes there are, about; counted if not given. Rows with one hash count once, each task's before the shuffle.
    """
    hashed = df.withColumn("_lk_order", order)
    if n is None:
        n = hashed.agg(F.approx_count_distinct("_lk_order")).first()[0]
    few = hashed.where(F.col("_lk_order") <= bar(n, wanted)).dropDuplicates(["_lk_order"])
    return few.orderBy("_lk_order").limit(wanted).drop("_lk_order")
