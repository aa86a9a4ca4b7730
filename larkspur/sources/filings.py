"""Company facts and ticker lists as regulators publish them in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "struct<end:string,val:double,fy:int,fp:string,form:string,filed:string,frame:string>"
FACTS = f"struct<cik:long,entityName:string,facts:map<string,map<string,struct<label:string,units:map<string,array<{ENTRY}>>>>>>"
TICKERS = "map<string,struct<cik_str:long,ticker:string,title:string>>"


def company_facts(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row for each reported value: ticker, taxonomy, concept, unit, value, fy, fp, form, filed_date, end_date, frame.

    Entries without a filing date or value go; an end date that cannot be read is NULL.
    """
    tree = payloads.select(F.upper(F.trim("ticker")).alias("ticker"), F.from_json(payload, FACTS).alias("_j"))
    concepts = tree.select("ticker", F.explode("_j.facts").alias("taxonomy", "_c")).select("ticker", "taxonomy", F.explode("_c").alias("concept", "_u"))
    units = concepts.select("ticker", "taxonomy", "concept", F.explode("_u.units").alias("unit", "_e"))
    entries = units.select("ticker", "taxonomy", "concept", "unit", F.explode("_e").alias("e"))
    out = entries.select(
        "ticker", "taxonomy", "concept", "unit", F.col("e.val").alias("value"), "e.fy", "e.fp", "e.form",
        F.col("e.filed").try_cast("date").alias("filed_date"), F.col("e.end").try_cast("date").alias("end_date"), "e.frame",
    )
    return out.where("filed_date IS NOT NULL AND value IS NOT NULL")


def company_tickers(spark: SparkSession, path: str) -> DataFrame:
    """ticker, cik (ten digits), title from a published list."""
    tree = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", TICKERS)).alias("_k", "t"))
    return tree.select(F.upper("t.ticker").alias("ticker"), F.lpad(F.col("t.cik_str").cast("string"), 10, "0").alias("cik"), F.col("t.title").alias("title"))


def wide_facts(long: DataFrame, concepts: list[str]) -> DataFrame:
    """ticker, filed_date and one column a concept: the value with the latest end date filed that day."""
    picked = long.where(F.col("concept").isin(concepts))
    return picked.groupBy("ticker", "filed_date").agg(*[F.max_by(F.when(F.col("concept") == c, F.col("value")), F.when(F.col("concept") == c, F.struct("end_date", "value"))).alias(c) for c in concepts])
