"""Weighted rendezvous sharding by stable record keys, with DataFrame functions only.

Each (key, shard) pair has a uniform hash u in (0, 1); the key goes to the shard with the largest -weight / ln(u).
A shard's score does not depend on the others, so a new shard takes rows only into itself, and a shard gets keys
in proportion to its weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.ranks import gapless, unfold


def scores(key: Column, weights: list[float]) -> Column:
    """An array of the shards' scores for a key. A null key hashes like any other value: all null keys share a shard."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    known = F.coalesce(F.xxhash64(key), F.lit(0))
    unit = [(F.shiftrightunsigned(F.xxhash64(known, F.lit(i)), 11).cast("double") + 0.5) * (2.0**-53) for i in range(len(weights))]
    return F.array(*[F.lit(-float(w)) / F.ln(u) for w, u in zip(weights, unit, strict=True)])


def best(score: Column, n: int) -> Column:
    """The index of the largest of the first n scores; the lower index of equal ones."""
    head = F.slice(score, 1, n)
    return (F.array_position(head, F.array_max(head)) - 1).cast("int")


def shard(df: DataFrame, key: str, weights: list[float], out: str = "shard") -> DataFrame:
    """df with the shard of each row in a new column `out`, which replaces a column of that name. A projection: no shuffle."""
    return df.withColumn(out, best(scores(F.col(key), weights), len(weights)))


def layout(df: DataFrame, key: str, text: str, weights: list[float], grown: list[float]) -> DataFrame:
    """One row for each row of df: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text and 1 more (a null text counts as empty). Slots are gapless from 0 in each
    shard. `grown` are the weights with one shard more, of which the first ones must be `weights`. Equal rows
    (same key, size and checksum) are counted before the first shuffle, so a key that holds a third of all rows
    costs one row a task; their numbers are unfolded at the end in chunks that go out to all tasks. Very long texts cost a
    pass over their bytes, and no shuffle has a text in it. An empty table gives an empty one; extra columns are not read.
    """
    if grown[: len(weights)] != weights:
        raise ValueError("growing keeps the weights of the shards there are")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = (
        df.select(F.col(key).alias("_key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
        .groupBy("_key", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_scores", scores(F.col("_key"), grown))
        .select("_key", "size", "text_crc32", "_copies", best(F.col("_scores"), len(weights)).alias("shard"), best(F.col("_scores"), len(grown)).alias("grown_shard"))
    )
    order = ["_key", "size", "text_crc32"]
    first = gapless(rows, ["shard"], F.xxhash64(*order), order, copies="_copies", out="_first")
    rows = unfold(first, "_copies", "_first", "slot")
    return rows.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
