"""News counts by ticker and signal day from a stream of news."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import news_ticker
from larkspur.functions.when import anchor


def news_counts(stream: DataFrame, lookup: DataFrame, late: str = "3 days") -> DataFrame:
    """ticker, day, news_count. stream: news_id, ticker, publish_time (string) and event_time; lookup: day_map() of a calendar.

    A news id counts once within the watermark; days are done when the watermark has passed them.
    """
    day, strict = anchor(F.col("publish_time"))
    seen = stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["news_id"]).select(news_ticker("ticker").alias("ticker"), day.alias("day"), strict.alias("strict"), "event_time")
    dated = seen.join(F.broadcast(lookup), "day").withColumn("signal_day", F.when(F.col("strict"), F.col("after")).otherwise(F.col("on_or_after")))
    windows = dated.groupBy(F.window("event_time", "1 day"), "ticker", "signal_day").agg(F.count(F.lit(1)).alias("news_count"))
    return windows.select("ticker", F.col("signal_day").alias("day"), F.col("window.start").alias("window_start"), "news_count")
