"""Tables in files, checked folders, settings, and the sinks of a run."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from larkspur.operators.panel import keyed, require

# The columns of price bars and of filed events.
PRICE_SCHEMA = "date date, ticker string, open double, high double, low double, close double, adj_close double, volume double"
EVENT_SCHEMA = "ticker string, filed_at timestamp_ntz, form string, accession string, text string"


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A Parquet or CSV table by its suffix; CSV has a header and, without a schema, only strings."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"no reader for {path}")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, in whatever store it names."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def read_optional(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The table, or None without a path or a table there."""
    return read_table(spark, path) if path and exists(spark, path) else None


def read_required(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return read_table(spark, path)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel with its keys in their normal form."""
    return keyed(require(read_table(spark, path), ["date", "ticker"], path))


def empty_prices(spark: SparkSession) -> DataFrame:
    """The price schema without rows: what a fetch gives that is not carried out."""
    return spark.createDataFrame([], PRICE_SCHEMA)


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], EVENT_SCHEMA)


def raw_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, size of the files under a folder whose names match; FileNotFoundError if there is none."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    except AnalysisException as e:
        raise FileNotFoundError(root) from e
    if found.isEmpty():
        raise FileNotFoundError(f"{root}: no file like {pattern}")
    return found


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """To Parquet or CSV by the path's suffix."""
    if path.endswith(".parquet"):
        df.write.mode(mode).parquet(path)
    elif path.endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError(f"no writer for {path}")


def write_calendar(days: DataFrame, path: str) -> None:
    days.select("date").write.mode("overwrite").parquet(path)


def write_together(frames: dict[str, DataFrame], spark: SparkSession, at_once: int = 4) -> None:
    """Tables by their paths, several jobs at a time: small ones do not wait for one another."""
    with ThreadPoolExecutor(at_once) as pool:
        for done in [pool.submit(inheritable_thread_target(spark)(write_table), df, path) for path, df in frames.items()]:
            done.result()


def write_fan_out(frames: dict[str, DataFrame], root: str) -> list[str]:
    """Several result tables under one folder."""
    write_together({f"{root.rstrip('/')}/{name}.csv": df for name, df in frames.items()}, next(iter(frames.values())).sparkSession)
    return sorted(frames)


def write_json(spark: SparkSession, payload: dict[str, Any], path: str) -> None:
    """One small document, through Spark's own writer."""
    text = json.dumps(payload, sort_keys=True, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def one_row(df: DataFrame) -> dict[str, Any]:
    """The single row of a summary, for a JSON document."""
    row = df.first()
    return row.asDict() if row else {}


def merged(base: dict[str, Any], override: dict[str, Any]) -> dict[str, Any]:
    """Settings with others laid over them, folder by folder."""
    out = dict(base)
    for k, v in override.items():
        both = isinstance(v, dict) and isinstance(out.get(k), dict)
        out[k] = merged(out[k], v) if both else v
    return out


def read_settings(path: str) -> dict[str, Any]:
    """Settings from a JSON or YAML file on the driver; YAML needs its library."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df in a copy of its session that hands rows to Python in batches of bounded rows and bytes: whole texts are wide. df's own session stays as it is."""
    spark = df.sparkSession
    copy = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    copy.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    copy.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy._jsparkSession, df._jdf.logicalPlan())
    return DataFrame(rows, copy)
