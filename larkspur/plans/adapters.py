"""Input tables of the factor engine, made of the driver's tables by SQL that Spark and DuckDB both read.

They only shape data: prices from order lines, news from documents and events, filings from orders. What is under test is
what the operators make of them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SQL = {
    # Weekly bars of each brand.
    "bars": """SELECT upper(p_brand) AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
        round(min(l_extendedprice / l_quantity), 6) AS open, round(max(l_extendedprice / l_quantity), 6) AS high, round(min(l_extendedprice / l_quantity), 6) AS low,
        round(sum(l_extendedprice) / sum(l_quantity), 6) AS close, sum(l_quantity) AS volume
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY 1, 2""",
    # Rounded signals and forward returns, so that ties are the same wherever they are ranked.
    "signals": """SELECT ticker, date, volume,
        CASE WHEN year(date) <= 1998 THEN 'train' WHEN year(date) = 1999 THEN 'valid' ELSE 'test' END AS split,
        round(lag(close, 1) OVER w / lag(close, 6) OVER w - 1, 6) AS momentum, round(lag(close, 1) OVER w / lag(close, 21) OVER w - 1, 6) AS momentum_20,
        floor(20 * lag(volume, 1) OVER w / lag(volume, 2) OVER w) / 20 AS surge, round(1 - lag(close, 1) OVER w / lag(high, 1) OVER w, 6) AS distance,
        round(lead(close, 5) OVER w / close - 1, 6) AS fwd5, round(lead(close, 10) OVER w / close - 1, 6) AS fwd10, round(lead(close, 20) OVER w / close - 1, 6) AS fwd20
        FROM ({bars}) AS b WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
    # Two branch predictions, a gate and a target from the signals.
    "preds": """SELECT ticker, date, split, floor(1000000 * (0.5 * momentum - 0.25 * distance)) / 1000000 AS factor_only_pred, floor(1000000 * (0.5 * momentum + 0.125 * surge)) / 1000000 AS fusion_pred,
        floor(1000 * distance) / 1000 AS gate_news_prob, fwd5 AS target, CASE WHEN distance > 0.25 THEN 1 ELSE 0 END AS has_news, momentum, momentum_20, surge, distance
        FROM ({signals}) AS s WHERE momentum IS NOT NULL AND surge IS NOT NULL AND momentum_20 IS NOT NULL""",
    "filings": """SELECT ticker, filed_date, max(o_totalprice) AS assets, max(o_orderkey) AS filing, min(o_totalprice) / 3 AS book_equity, sum(o_totalprice) AS revenue_ttm
        FROM (SELECT concat('BRAND#', CAST(o_custkey % 25 + 1 AS STRING)) AS ticker, CAST(o_orderdate AS DATE) AS filed_date, o_totalprice, o_orderkey FROM {orders}) AS o GROUP BY 1, 2""",
    "news": """SELECT CAST(doc_id AS STRING) AS news_id, source AS ticker, text, ts AS published, CAST(ts AS STRING) AS publish_time
        FROM {documents} JOIN {events} ON event_id = doc_id * 5""",
    "calendar": """SELECT DISTINCT CAST(ts AS DATE) AS date FROM {events} WHERE dayofweek(CAST(ts AS DATE)) NOT IN ({weekend})""",
    "vectors": """SELECT concat('chunk', CAST(vec_id AS STRING)) AS chunk_id, concat('T', CAST(label AS STRING)) AS ticker, CAST(vec_id % 20 AS INT) AS day, vec_id, embedding FROM {embeddings}""",
}


def _fill(name: str, spark_side: bool) -> str:
    """An adapter's SQL with the adapters it is made of; table names stay as fields for Spark."""
    text = SQL[name]
    for inner in SQL:
        if f"{{{inner}}}" in text:
            text = text.replace(f"{{{inner}}}", _fill(inner, spark_side))
    # The engines number the days of the week from different ends.
    text = text.replace("{weekend}", "1, 7" if spark_side else "0, 6")
    return text if spark_side else re.sub(r"\{(\w+)\}", r"\1", text)


def oracle(name: str) -> str:
    """The adapter for DuckDB, as the body of a CTE."""
    return f"{name} AS ({_fill(name, False)})"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _fill(name, True)
    used = {t: load(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)
