"""What the vector searches share: which vectors take part, and the k best of a block with ties to the smaller id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Whether an array is there, is not empty and has finite components only."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True))


def nonzero(v: Column) -> Column:
    return F.exists(v, lambda x: x != 0)


def taking_part(df: DataFrame, id_col: str, vector_col: str, zero: bool) -> DataFrame:
    """_id, _v (array of doubles), _dim of the rows that take part; a row without an id takes none."""
    v = F.col(vector_col).cast("array<double>")
    own = df.select(F.col(id_col).cast("long").alias("_id"), v.alias("_v")).where(F.col("_id").isNotNull() & finite(F.col("_v")))
    if not zero:
        own = own.where(nonzero(F.col("_v")))
    return own.withColumn("_dim", F.size("_v"))


COMMON = 64  # lengths that have an index of their own


def dimensions(own: DataFrame, most: int = COMMON) -> tuple[dict[int, int], DataFrame | None]:
    """Rows by number of components for the `most` commonest lengths, and the rows of all other lengths, if there are any. Vectors of different length never meet."""
    counted = own.groupBy("_dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "_dim").limit(most + 1).collect()
    common = {r["_dim"]: r["n"] for r in counted[:most]}
    return common, None if len(counted) <= most else own.where(~F.col("_dim").isin(list(common)))


PART, ASKED = 2048, 512


def searched_whole(own: DataFrame, is_query: Column, k: int, answer: Callable, kind: str) -> DataFrame:
    """query_id, vec_id, worse (of the given kind, less is better): the k best for each query among the rows of its length in each part of them, however many lengths there are.

    Every length is cut into parts of about PART rows and ASKED queries; a task has one of each at a time. answer(vectors, ids, query vectors, query ids, k) gives
    (query row, worse, id), as topk.pruned does.
    """
    asked = own.where(is_query).groupBy("_id", "_dim").agg(F.min("_v").alias("_v"))

    def parts(rows: DataFrame, size: int, name: str) -> DataFrame:
        return rows.groupBy("_dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))

    sizes = parts(own, PART, "_parts").join(parts(asked, ASKED, "_asks"), "_dim")

    def dealt(rows: DataFrame, own_parts: str, of: str, other_parts: str, to: str) -> DataFrame:
        placed = rows.join(sizes, "_dim").withColumn(of, F.pmod(F.xxhash64("_id", "_v"), F.col(own_parts)).cast("int"))
        return placed.withColumn(to, F.explode(F.sequence(F.lit(0), F.col(other_parts) - 1))).select("_dim", "_part", "_ask", "_id", "_v")

    keys = ["_dim", "_part", "_ask"]
    stored, queries = dealt(own, "_parts", "_part", "_asks", "_ask"), dealt(asked, "_asks", "_ask", "_parts", "_part")

    def run(rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asking):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "worse": np.zeros(0)})
        q_ids = asking["_qid"].to_numpy()
        at, worse, ids = answer(matrix(rows["_v"]), rows["_id"].to_numpy(), matrix(asking["_q"]), q_ids, k)
        return pd.DataFrame({"query_id": q_ids[at], "vec_id": ids, "worse": [int(w) for w in worse] if kind == "long" else worse})

    # Names of their own, since both sides come from the same rows.
    queries = queries.toDF("_dim2", "_part2", "_ask2", "_qid", "_q")
    return stored.groupBy(*keys).cogroup(queries.groupBy("_dim2", "_part2", "_ask2")).applyInPandas(run, f"query_id long, vec_id long, worse {kind}")


def matrix(rows) -> np.ndarray:
    return np.array(rows.tolist(), dtype=np.float64)


def top(worse: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k smallest by (worse, id); infinities are left out."""
    if len(worse) > k:
        near = np.flatnonzero(worse <= np.partition(worse, k - 1)[k - 1])
    else:
        near = np.arange(len(worse))
    near = near[worse[near] < np.inf]
    return near[np.lexsort((ids[near], worse[near]))[:k]]


def beside_shards(stored: DataFrame, asked: DataFrame, shards: int, of_stored: list[str], of_asked: list[str], hold: Callable[[pd.DataFrame], Any], answer: Callable[[Any, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """answer(hold(rows of a shard), some of the queries sent to it), for every shard: both tables have `_shard`, from 0 to below `shards`.

    A shard's rows are shuffled once and come first; its queries follow in batches. So a task holds one shard (its rows are bounded by the
    caller) and one batch, however many queries there are. Shards without queries are read and give nothing.
    """
    tagged = stored.select("_shard", F.lit(0).alias("_kind"), *of_stored).unionByName(asked.select("_shard", F.lit(1).alias("_kind"), *of_asked), allowMissingColumns=True)
    dealt = tagged.repartitionById(max(1, shards), F.col("_shard")).sortWithinPartitions("_shard", "_kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, shard = None, [], None
        for batch in batches:
            for (number, kind), part in batch.groupby(["_shard", "_kind"], sort=True):
                if number != at:
                    at, parts, shard = number, [], None
                if kind == 0:
                    parts.append(part[of_stored])
                elif parts or shard is not None:
                    if shard is None:
                        shard, parts = hold(pd.concat(parts, ignore_index=True)), []
                    yield answer(shard, part[of_asked])

    return dealt.mapInPandas(run, schema)
