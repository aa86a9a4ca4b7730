"""News to tradable chunks: calendars, signal dates, chunks, and the columns vendors call by many names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import text as T
from larkspur.functions.when import CLOSE, anchor
from larkspur.operators.panel import KEYS, require

# What vendors call the columns of a news record.
ALIASES = {
    "id": "news_id", "article_id": "news_id", "symbol": "ticker", "stock": "ticker", "stock_symbol": "ticker", "headline": "title", "article_title": "title",
    "body": "text", "article": "text", "content": "text", "date": "publish_time", "published_at": "publish_time", "datetime": "publish_time",
}
CHUNKS_PER_DAY = 64
WORDS_PER_CHUNK = 256


def calendar(prices: DataFrame, date: str = "date") -> DataFrame:
    """The distinct days with prices."""
    return prices.select(F.to_date(date).alias("date")).where("date IS NOT NULL").distinct()


def business_days(spark: SparkSession, start: str, end: str, holidays: DataFrame | None = None) -> DataFrame:
    """Mondays to Fridays from start to end, without the holidays."""
    ends = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    days = spark.range(1).select(F.explode(ends).alias("date")).where(F.weekday("date") < 5)
    return days if holidays is None else days.join(holidays.select(F.to_date("date").alias("date")).distinct(), "date", "left_anti")


def day_map(days: DataFrame, first: Column | None = None) -> DataFrame:
    """For every calendar day from a week before the first trading day to the last: `on_or_after` and `after`, the trading days.

    One row a day, so it is small whatever the news; a lookup is an equi-join with it.
    """
    ends = days.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    span = ends.select(F.explode(F.sequence(F.date_sub("a", 7), F.col("b"))).alias("day"))
    marked = span.join(days.select(F.col("date").alias("day"), F.lit(True).alias("_open")), "day", "left").withColumn("_d", F.when(F.col("_open"), F.col("day")))
    w = Window.orderBy("day")
    return marked.select("day", F.min("_d").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("on_or_after"), F.min("_d").over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"))


def signal_dates(news: DataFrame, days: DataFrame, published: str = "publish_time", out: str = "date", past_end: str = "drop", close: str = CLOSE) -> DataFrame:
    """news with the first trading day on which it can be used; news past the calendar goes, fails or stays NULL (drop, fail, keep).

    A publication time that is missing or cannot be read fails, and so does news without any trading day.
    """
    if past_end not in ("drop", "fail", "keep"):
        raise ValueError(f"past_end cannot be {past_end}")
    raw = F.col(published).cast("string")
    day, strict = anchor(raw, close)
    dated = news.withColumn("_day", day).withColumn("_strict", strict)
    dated = dated.where(F.assert_true(F.col("_day").isNotNull(), "a publication time is missing or cannot be read").isNull())
    lookup = day_map(days)
    edges = days.agg(F.min("date").alias("_a"), F.lit(1).alias("_k"))
    # Days before the map's first lead to the first trading day; the map is small, and Spark sees its size.
    joined = dated.join(lookup.withColumnRenamed("day", "_day"), "_day", "left").withColumn("_k", F.lit(1)).join(edges, "_k")
    joined = joined.where(F.assert_true(F.col("_a").isNotNull(), "the calendar has no day").isNull())
    found = F.when(F.col("_day") < F.col("_a"), F.col("_a")).when(F.col("_strict"), F.col("after")).otherwise(F.col("on_or_after"))
    named = joined.withColumn(out, found).drop("_day", "_strict", "on_or_after", "after", "_k", "_a")
    if past_end == "fail":
        return named.where(F.assert_true(F.col(out).isNotNull(), "news past the end of the calendar").isNull())
    return named if past_end == "keep" else named.where(F.col(out).isNotNull())


def normalized(df: DataFrame, order: Column | str, names: dict[str, str] | None = None, bucket: Column | str | None = None) -> DataFrame:
    """Vendor columns under their own names, texts and tickers cleaned; a missing id is news_<row number by order, from 0>.

    A row without a ticker fails. An alias gives way to a column that has the name already. `bucket`, which must not fall where `order` rises (the
    day of a time, say), lets rows be numbered bucket by bucket; without it one task numbers all rows that lack an id.
    """
    wanted = {k.lower(): v for k, v in (ALIASES | (names or {})).items()}
    have = set(df.columns)
    rename = {}
    for c in df.columns:
        to = (names or {}).get(c) or wanted.get(c.lower())
        if to and to not in have and to not in rename.values():
            rename[c] = to
    out = require(df.withColumnsRenamed(rename), ["ticker", "text", "publish_time"], "news")
    if "news_id" not in out.columns:
        out = _numbered(out, order, F.lit(0) if bucket is None else bucket).withColumn("news_id", F.concat(F.lit("news_"), F.col("_n").cast("string"))).drop("_n")
    for c in ("title", "source"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(""))
    out = out.where(F.assert_true(F.col("ticker").isNotNull(), "a record has no ticker").isNull())
    return out.withColumns({"ticker": T.news_ticker("ticker"), "text": T.clean_text("text"), "title": T.clean_text("title"), "news_id": F.col("news_id").cast("string")})


def _numbered(df: DataFrame, order: Column | str, bucket: Column | str) -> DataFrame:
    """df with `_n`, from 0 in (bucket, order) order: the rows of a bucket in one task, then one row a bucket."""
    tagged = df.withColumn("_b", bucket if isinstance(bucket, Column) else F.col(bucket))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tagged.groupBy("_b").agg(F.count(F.lit(1)).alias("_c")).select(F.col("_b").alias("_b2"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inner = tagged.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1)
    return inner.join(offsets, F.col("_b").eqNullSafe(F.col("_b2"))).withColumn("_n", F.col("_o") + F.col("_i")).drop("_b", "_b2", "_o", "_i")


def alias_map(rows: DataFrame, order: str) -> DataFrame:
    """alias, ticker: lower-case tickers and company names to the canonical ticker; the last by `order` wins."""
    own = rows.select(T.news_ticker("ticker").alias("ticker"), F.col(order).alias("_o"), F.explode(F.array(F.lower("ticker"), F.lower(F.trim("company_name")))).alias("alias"))
    return own.where("alias IS NOT NULL AND alias <> ''").groupBy("alias").agg(F.max_by("ticker", F.struct("_o", "ticker")).alias("ticker"))


def chunk_news(news: DataFrame, days: DataFrame, most: int = WORDS_PER_CHUNK, per_day: int | None = CHUNKS_PER_DAY, overlap: int = 0, entities: bool = True) -> DataFrame:
    """Chunks of the news, the first `per_day` of each stock-day by publication time, news id and place in the news; all of them if that is None.

    The cap is a window limit, so a stock-day with much news is cut before the shuffle, not after.
    """
    dated = signal_dates(require(news, ["news_id", "ticker", "text", "publish_time"], "news"), days)
    # The decoded text and its words are columns of their own first: a lambda cannot hold a Python function, and would split the text for every chunk.
    cleaned = dated.withColumn("_clean", T.clean_text("text", entities)).withColumn("_words", T.tokens(F.col("_clean")))
    words = F.col("_words")
    ticker = T.news_ticker("ticker")
    cut = cleaned.select("date", ticker.alias("ticker"), F.col("news_id").cast("string").alias("source_news_id"), "publish_time", *[c for c in ("title",) if c in news.columns], F.posexplode(T.chunks(words, most, overlap)).alias("chunk_index", "chunk_text"))
    order = Window.partitionBy("ticker", "date").orderBy("publish_time", "source_news_id", "chunk_index")
    kept = cut if per_day is None else cut.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_day).drop("_r")
    return kept.withColumn("chunk_id", T.chunk_id(F.col("source_news_id"), F.col("ticker"), F.col("date"), F.col("chunk_index"))).withColumn("token_count", F.size(F.split("chunk_text", " ")))


def not_yet(chunks: DataFrame, done: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks without a row in `done`: what an interrupted encoding still has to do."""
    return chunks.join(done.select(key).distinct(), key, "left_anti")


def top_chunks(chunks: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """The k chunks of each stock-day with the largest attention weight, ties by id."""
    order = Window.partitionBy(*KEYS).orderBy(F.col("attention_weight").desc(), "chunk_id")
    return chunks.join(weights, [*KEYS, "chunk_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
