"""Manifests of stored vectors, and stores of vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.panel import require
from larkspur.sources.commits import CommittedTable
from larkspur.sources.vector_files import ManifestVectors

# The columns of a manifest line.
LINE = "embedding_id string, chunk_id string, ticker string, date string, model_name string, embedding_path string, embedding_dim int, publish_time string, source_news_id string, chunk_index int, embedding array<double>"
REQUIRED = ["chunk_id", "embedding_path", "ticker", "date"]


def numbered_lines(spark: SparkSession, root: str, name: str = "manifest.jsonl") -> DataFrame:
    """path, line (from 1), value of every line of the files of that name under a folder.

    Files are read by blocks: lines are numbered in their block, and the blocks' counts give the offsets, so a file of any size is split.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root)
    lines = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"), "value")
    numbered = lines.withColumn("_r", F.row_number().over(Window.partitionBy("path", "_b").orderBy("_i")))
    blocks = lines.groupBy("path", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("path").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("path", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return numbered.join(offsets, ["path", "_b"]).where(F.trim("value") != "").select("path", (F.col("_o") + F.col("_r")).cast("int").alias("line"), "value")


def read_manifests(spark: SparkSession, root: str, name: str = "manifest.jsonl", required: list[str] | None = None) -> DataFrame:
    """All manifest lines with their file and line; a line that is no JSON, or lacks a required value, fails."""
    parsed = numbered_lines(spark, root, name).withColumn("_j", F.from_json("value", LINE))
    good = F.col("_j").isNotNull()
    for c in required or REQUIRED:
        good = good & F.col(f"_j.{c}").isNotNull()
    return parsed.where(F.assert_true(good, "a manifest line cannot be read or lacks a value").isNull()).select("path", "line", "_j.*")


def stored_vectors(spark: SparkSession, manifests: str, root: str | None = None, name: str = "manifest.jsonl") -> DataFrame:
    """The manifests' rows with their vectors (NULL where the file is missing), by path and line (the byte at which it begins).

    A condition on ticker, date or chunk_id reaches the reader, which then opens the files of those rows only. Sets the session's switch for that.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ManifestVectors)
    found = spark.read.format(ManifestVectors.name()).option("manifests", manifests).option("root", root or manifests).option("pattern", name).load()
    return found.withColumnRenamed("place", "line")


def with_numbers(rows: DataFrame, manifests: str, name: str = "manifest.jsonl") -> DataFrame:
    """rows of stored_vectors (path, line, ...) with `number`: a line's place, from 1, among the lines of all manifests of one folder, by file and line.

    Lines are counted in the manifests, so no vector is opened for it, and numbered in their file; one row a file is summed in one task.
    """
    text = rows.sparkSession.read.option("pathGlobFilter", name).text(manifests)
    files = text.where(F.trim("value") != "").groupBy(F.col("_metadata.file_name").alias("_file")).agg(F.count(F.lit(1)).alias("_n"))
    before = files.select("_file", (F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    placed = rows.withColumn("_file", F.substring_index("path", "/", -1)).withColumn("_r", F.row_number().over(Window.partitionBy("_file").orderBy("line")))
    return placed.join(before, "_file").withColumn("number", F.col("_before") + F.col("_r")).drop("_file", "_r", "_before")


@dataclass(frozen=True)
class VectorStore:
    """A store of vectors under a root, with chunk_id, ticker, date, model_name and embedding, that grows by commits."""

    spark: SparkSession
    root: str

    @property
    def table(self) -> CommittedTable:
        return CommittedTable(self.spark, self.root)

    def load(self) -> DataFrame:
        """All vectors of committed batches."""
        return self.table.load(STORED)

    def get(self, chunk_id: str) -> DataFrame:
        """The vectors of an id: the condition goes to the scan."""
        return self.load().where(F.col("chunk_id") == chunk_id)

    def ids(self) -> DataFrame:
        return self.load().select("chunk_id").distinct()

    def manifest(self) -> DataFrame:
        """What is stored, without the vectors."""
        return self.load().select("chunk_id", "ticker", "date", "model_name", F.size("embedding").alias("embedding_dim"))

    def save(self, df: DataFrame, batch: str | None = None) -> bool:
        """Add vectors as one batch. With a batch's id, a repeat changes nothing and gives False."""
        require(df, ["chunk_id", "ticker", "date", "embedding"], "vectors")
        return self.table.append(df.select("chunk_id", "ticker", F.to_date("date").alias("date"), "model_name", F.col("embedding").cast("array<float>").alias("embedding")), batch)


STORED = "chunk_id string, ticker string, date date, model_name string, embedding array<float>"
