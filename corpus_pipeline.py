"""From raw documents to sampled pieces: language, near duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents; the last gives pieces and the position in the mixture.

In every stage: an empty table gives an empty one; a null text is an empty one (language rejects it); rows without an id or a source stay; rows that
repeat an id with other texts are documents of their own; exact repeats are one near-duplicate class, so one row of them stays, and only those without an id
stay as often as they come; texts are processed whole, whatever their length; extra columns go with the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import language, mixing, neardup, pieces, secrets
from larkspur.llm.queries import tokenizer
from larkspur.llm.store import fresh_dir, settle

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# The least score of a language for a document to stay. Rejected: no text, no letter, or no language that stands out.
MIN_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which becomes theirs. Documents without a letter or with a score below the least go. Without any labelled document all go.

    The model learns from the documents' own labels where there are some; equal scores go to the language first by name.
    """
    model = language.train(docs, "doc_id", "text", "lang", ~language.held_out(F.col("doc_id")))
    found = language.predict(docs, "text", model).where((F.col("lang_pred") != language.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class, one text of those with that id in it; documents without an id stay."""
    settle(spark)
    docs = docs.select(*COLUMNS)
    rows = neardup.members(docs, "doc_id", "text")
    kept = rows.where("_id = class_id").groupBy("_label").agg(F.min(F.struct("_id", "_hash")).alias("_m")).select(F.col("_m._id").alias("doc_id"), F.col("_m._hash").alias("_hash"))
    named = docs.where("doc_id IS NOT NULL").withColumn("_hash", neardup.text_hash("text"))
    named = named.join(kept, ["doc_id", "_hash"], "left_semi").dropDuplicates(["doc_id", "_hash"]).drop("_hash")
    return named.unionByName(docs.where("doc_id IS NULL")).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked and n_chars counted anew where one was. A null text stays null."""
    model = secrets.train(secrets.labelled(spark, docs, "doc_id", "text"))
    found = secrets.scan(docs, "text", model)
    clean = found.withColumn("text", secrets.redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: equal weights for all sources that still have documents. File names and the rows in them keep the order.

    Ids and hashes of the texts are mixed, not the texts; equal documents share a place. Documents with a null id or a null source are mixed like others.
    """
    settle(spark)
    hashed = docs.select(*COLUMNS, neardup.text_hash("text").alias("_hash"))
    light = mixing.mix(hashed.select("doc_id", "source", "_hash").distinct(), "source", "doc_id", "_hash").select("doc_id", "source", "_hash", "position")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in ("doc_id", "source", "_hash")]
    placed = hashed.alias("d").join(light.alias("m"), same).select(*[f"d.{c}" for c in COLUMNS], "position", F.spark_partition_id().alias("_from"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionByRange(n, "position", "_from").sortWithinPartitions("position").select(*COLUMNS)


def in_file_order(docs: DataFrame) -> DataFrame:
    """docs with `position`: the place of each row in the order of its files' names, and of the rows in a file; NULL where docs come from no file.

    Spark reads files in an order of its own, so the order is taken from the files themselves. One row a file is numbered in one task.
    """
    names = docs.inputFiles()
    if not names:
        return docs.withColumn("position", F.lit(None).cast("long"))
    named = docs.select(*COLUMNS, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = named.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = files.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    # About 100 bytes a file; beyond that many files the join is left to Spark.
    before = F.broadcast(before) if len(names) <= 50_000 else before
    return named.join(before, "_file").withColumn("position", F.col("_before") + F.col("_row"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sampled pieces, and its position in the mixture: the order of docs' files."""
    settle(spark)
    return pieces.encode(in_file_order(docs), "doc_id", "text", tokenizer("piece_bpe_32k.model"), keep="position")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixture", mix_sources),
    ("pieces", encode_pieces),
]

# Models and sampling by hash cannot be put in SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where = fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{where}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
