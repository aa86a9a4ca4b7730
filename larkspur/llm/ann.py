"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all trees for each
query, and exact distances to the different rows of the leaves it reaches.

The trees are fitted on at most `sample` rows (the lowest hashes of ids and vectors); every row is indexed and stored once, with
its leaf in each tree. Rows lie in shards by the first tree's leaves, shards of more than `cell` rows are split by a hash of the id. A
query opens its leaves, goes to the shards that have rows in them, and there each different row of the opened leaves is ranked once. Shards
hold still: a task reads a shard's rows, then the queries that came to it, batch by batch, so its memory does not grow with the queries.

Rows with equal vectors are cut to the k + 1 smallest ids, which are all that can be among k neighbours with ties to the smaller id,
so a vector that many rows share does not make a leaf large.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id. Of
rows with the same id, the query is the one with the smallest vector, and none is a candidate for its own id. An empty table has no result.
The 64 commonest lengths of vectors have a forest each; rows of all other lengths are searched whole, part by part, which is exact. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.forest import Forest
from larkspur.llm.sampling import lowest
from larkspur.llm.store import cut
from larkspur.llm.vectors import beside_shards, dimensions, matrix, searched_whole, taking_part, top

# At most 256 leaves a tree: a row's leaf in a tree is one byte.
TREES, DEPTH, SHARE, SAMPLE, CELL, SHARDS = 64, 8, 0.008, 8192, 8192, 16
# A query opens leaves for so many rows at least, and a leaf has so many rows on average.
LEAST, LEAF = 3000, 16


def search(df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 10, trees: int = TREES, depth: int = DEPTH, share: float = SHARE, sample: int = SAMPLE, cell: int = CELL, seed: int = 7) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance in doubles) of each query's k nearest found.

    is_query is a condition on `_id`. `share` is the part of all (tree, leaf) pairs that a query opens; leaves overlap, so the different rows
    in them are fewer than share * trees of all.
    """
    own = taking_part(df, id_col, vector_col, zero=False)
    sizes, rest = dimensions(own)
    parts = [_search(own.where(F.col("_dim") == dim), n, is_query, k, trees, min(8, depth), share, sample, cell, seed) for dim, n in sorted(sizes.items())]
    if rest is not None:
        parts.append(searched_whole(rest, is_query, k, nearest, "double").withColumnRenamed("worse", "score"))
    if not parts:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    # A row that repeats an id with another vector is a candidate by each of them.
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(v: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, distance, id) of the k nearest different ids for each query among all rows of v."""
    found = []
    for i in range(len(q)):
        gap = v - q[i]
        away = np.einsum("ij,ij->i", gap, gap)
        order = np.lexsort((ids, away))
        order = order[ids[order] != q_ids[i]]
        _, once = np.unique(ids[order], return_index=True)
        best = order[np.sort(once)[:k]]
        found.append((np.full(len(best), i), np.sqrt(away[best]), ids[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def rows_in_leaves(cells: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows by (tree, leaf), and where each pair's rows begin: cells is (rows, trees)."""
    flat = (cells.T.astype(np.int32) + (np.arange(cells.shape[1], dtype=np.int32) * leaves)[:, None]).ravel()
    order = np.argsort(flat, kind="stable")
    return (order % len(cells)).astype(np.int64), np.searchsorted(flat[order], np.arange(cells.shape[1] * leaves + 1))


def _search(own: DataFrame, n: int, is_query: Column, k: int, trees: int, depth: int, share: float, sample: int, cell: int, seed: int) -> DataFrame:
    depth = min(depth, max(1, int(math.log2(max(2, n / LEAF)))))
    rows = lowest(own.select("_id", "_v"), F.xxhash64("_id", "_v"), sample, n).select("_v").toPandas()
    shared = own.sparkSession.sparkContext.broadcast(Forest(matrix(rows["_v"]), trees, depth, seed))
    leaves = 1 << depth
    opened = min(trees * leaves, max(math.ceil(share * trees * leaves), math.ceil(LEAST * leaves / n)))
    coarse = min(depth, max(int(math.log2(SHARDS)), math.ceil(math.log2(max(1, n / cell)))))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cells = shared.value.leaves(matrix(b["_v"]))
                yield b.assign(_cells=[c.tobytes() for c in cells.astype(np.uint8)], _shard=cells[:, 0] >> (depth - coarse))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(_open=[[t * leaves + leaf for t, leaf in shared.value.probes(q, opened)] for q in matrix(b["_v"])])

    few = Window.partitionBy("_v").orderBy("_id")
    kept = own.withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= k + 1).select("_id", "_v")
    indexed = cut(kept.mapInPandas(index, "_id long, _v array<double>, _cells binary, _shard int"))
    # At most 256 counts. A shard's parts have numbers of their own, one after another.
    sizes = {r["_shard"]: r["n"] for r in indexed.groupBy("_shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    splits = [-(-sizes.get(s, 0) // cell) for s in range(1 << coarse)]
    first = np.concatenate(([0], np.cumsum(splits))).tolist()
    split, base = (F.from_json(F.lit(str(x)), "array<int>") for x in (splits, first))
    stored = indexed.withColumn("_shard", (F.get(base, F.col("_shard")) + F.pmod(F.xxhash64("_id", F.lit(seed)), F.get(split, F.col("_shard")))).cast("int"))

    def cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, part in b.groupby("_shard"):
                yield pd.DataFrame({"_shard": shard, "_cell": np.unique(np.frombuffer(b"".join(part["_cells"]), np.uint8).reshape(len(part), trees) + np.arange(trees) * leaves)})

    there = stored.select("_shard", "_cells").mapInPandas(cells_of, "_shard int, _cell int").distinct()
    queries = cut(own.where(is_query).groupBy("_id").agg(F.min("_v").alias("_v")).mapInPandas(probe, "_id long, _v array<double>, _open array<int>"))
    # A query without a cell with rows in it has no neighbours; the empty cells are not asked.
    reached = queries.select("_id", F.explode("_open").alias("_cell")).join(there, "_cell").select("_id", "_shard").distinct()
    asked = reached.join(queries, "_id").select("_shard", "_id", "_v", "_open")

    def hold(held: pd.DataFrame) -> tuple:
        cells = np.frombuffer(b"".join(held["_cells"]), np.uint8).reshape(len(held), trees)
        return matrix(held["_v"]), held["_id"].to_numpy(), *rows_in_leaves(cells, leaves)

    def answer(shard: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        v, ids, by_cell, begin = shard
        out = []
        for q, own_id, cells in zip(matrix(asked["_v"]), asked["_id"].to_numpy(), asked["_open"], strict=True):
            mine = np.zeros(len(v), dtype=bool)
            for c in cells:
                mine[by_cell[begin[c] : begin[c + 1]]] = True
            near = np.flatnonzero(mine)
            gap = v[near] - q
            away = np.einsum("ij,ij->i", gap, gap)
            away[ids[near] == own_id] = np.inf
            best = top(away, ids[near], k)
            out.append(pd.DataFrame({"query_id": own_id, "vec_id": ids[near[best]], "score": np.sqrt(away[best])}))
        return pd.concat(out)

    return beside_shards(stored, asked, first[-1], ["_id", "_v", "_cells"], ["_id", "_v", "_open"], hold, answer, "query_id long, vec_id long, score double")
