"""Exact top-k by integer inner product, with block-at-a-time pruning.

Components are "terms" with signed weights. Rows are numbered so that rows with the same strongest component stand
together, and cut into shards of SHARD rows and ranges of RANGE rows. A range keeps its largest and smallest weight of
each term; their products with a query, summed, bound every score in it. Each query takes its ranges by falling
bound, scores them through the range's own rows (its forward index), and stops at the first range whose bound lies
below its k-th score. A query starts with the k-th of its scores against FIRST rows (the lowest hashes), which the k-th of all cannot be below,
so every shard prunes from its first range on. Shards hold still: a task reads one, then the queries batch by batch.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id. Of rows
with the same id, the query is the one with the smallest vector, and none is a candidate for its own id. Scores
that may pass 2**53 are computed in whole numbers of any size; a score beyond 64 bits fails. An empty table has no result. The 64 commonest
lengths of vectors have shards of their own; all others are searched together, part by part. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.ranks import gapless
from larkspur.llm.sampling import lowest
from larkspur.llm.vectors import beside_shards, dimensions, matrix, searched_whole, taking_part, top

SHARD, RANGE, BLOCK, WAVE, FIRST = 8192, 64, 1024, 8, 2048
# A table is cut into so many shards at least, if they have a range each.
SHARDS = 16


def search(df: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 5, scale: float = 256.0, shard: int = SHARD) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k largest inner products, ties to the smaller id. is_query is a condition on `_id`."""
    own = taking_part(df, id_col, vector_col, zero=True)
    # floor() of a double beyond 64 bits would overflow a long; such components stay whole doubles as they are.
    whole = F.transform("_v", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(F.lit(scale) * x).cast("double")).otherwise(F.lit(scale) * x))
    own = own.withColumn("_v", whole)
    sizes, rest = dimensions(own)
    if not sizes:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = [_search(own.where(F.col("_dim") == dim), n, is_query, k, min(shard, max(RANGE, -(-n // SHARDS)))) for dim, n in sorted(sizes.items())]
    if rest is not None:
        found.append(searched_whole(rest, is_query, k, pruned, "long").select("query_id", "vec_id", (-F.col("worse")).alias("score")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(own: DataFrame, n: int, is_query: Column, k: int, shard: int) -> DataFrame:
    strongest = F.array_position(F.transform("_v", F.abs), F.array_max(F.transform("_v", F.abs)))
    numbered = gapless(own, ["_dim"], strongest * 8 + F.pmod(F.xxhash64("_id"), F.lit(8)), [F.xxhash64("_id", "_v"), "_id"], out="_at")
    shards = -(-n // shard)
    stored = numbered.withColumn("_shard", F.floor(F.col("_at") / shard).cast("int"))
    sample = lowest(own.select("_id", "_v"), F.xxhash64("_id", "_v"), FIRST, n).toPandas()
    shared = own.sparkSession.sparkContext.broadcast((matrix(sample["_v"]), sample["_id"].to_numpy()))

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v, ids = shared.value
        for b in batches:
            q, floor = matrix(b["_v"]) if len(b) else None, []
            for i, own_id in enumerate(b["_id"].to_numpy()):
                # A row that repeats an id counts once: the k-th of different candidates is the bound.
                score = pd.Series(v @ q[i]).groupby(ids).max().drop(own_id, errors="ignore").nlargest(k)
                safe = len(score) == k and v.shape[1] * np.abs(v).max() * np.abs(q[i]).max() < 2.0**53
                floor.append(float(score.iloc[-1]) if safe else -np.inf)
            yield b.assign(_floor=floor)

    queries = own.where(is_query).groupBy("_id").agg(F.min("_v").alias("_v")).mapInPandas(begin, "_id long, _v array<double>, _floor double")
    asked = queries.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def hold(held: pd.DataFrame) -> tuple:
        held = held.sort_values("_at", kind="stable")
        return matrix(held["_v"]), held["_id"].to_numpy()

    def answer(held: tuple, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at in range(0, len(asked), BLOCK):
            part = asked.iloc[at : at + BLOCK]
            q_ids = part["_id"].to_numpy()
            rows, worse, ids = pruned(*held, matrix(part["_v"]), q_ids, k, part["_floor"].to_numpy())
            out.append(pd.DataFrame({"query_id": q_ids[rows], "vec_id": ids, "score": [int(-w) for w in worse]}))
        return pd.concat(out)

    return beside_shards(stored, asked, shards, ["_at", "_id", "_v"], ["_id", "_v", "_floor"], hold, answer, "query_id long, vec_id long, score long")


def pruned(v: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, minus the score, id) of the k best for each query among the rows of v, by range-at-a-time pruning.

    floor: a score that the query's k-th best of all rows, here and elsewhere, is not below. Ranges bounded below it are not scored.
    """
    n, dim = v.shape
    if dim * np.abs(v).max() * np.abs(q).max() >= 2.0**53:
        v, q = np.array([[int(x) for x in row] for row in v], dtype=object), np.array([[int(x) for x in row] for row in q], dtype=object)
    ranges = -(-n // RANGE)
    edges = np.arange(0, n, RANGE)
    high, low = np.maximum.reduceat(v, edges, axis=0), np.minimum.reduceat(v, edges, axis=0)
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    order = np.argsort(-bound, axis=1, kind="stable")
    kind = v.dtype
    none = np.inf
    best = np.full((len(q), k), none, dtype=kind)
    best_ids = np.full((len(q), k), -1, dtype=np.int64)
    live = np.arange(len(q))
    for at in range(0, ranges, WAVE):
        turn = order[live, at : at + WAVE]
        # Ranges whose bound is below the k-th score cannot change the result; an equal bound can, by a smaller id.
        least = -best[live, k - 1]
        open_ = bound[live[:, None], turn] >= (least if floor is None else np.maximum(least, floor[live]))[:, None]
        going = open_.any(axis=1)
        live, turn, open_ = live[going], turn[going], open_[going]
        if not len(live):
            break
        worse = np.full((len(live), turn.shape[1] * RANGE + k), none, dtype=kind)
        near = np.full(worse.shape, -1, dtype=np.int64)
        worse[:, -k:], near[:, -k:] = best[live], best_ids[live]
        who, slot = np.nonzero(open_)
        which = turn[who, slot]
        by = np.argsort(which, kind="stable")
        for part in np.split(by, np.flatnonzero(np.diff(which[by])) + 1):
            b = which[part[0]]
            rows = slice(b * RANGE, min(n, (b + 1) * RANGE))
            here = ids[rows]
            score = -(q[live[who[part]]] @ v[rows].T)
            score[here[None, :] == q_ids[live[who[part]]][:, None]] = none
            cols = slot[part][:, None] * RANGE + np.arange(len(here))
            worse[who[part][:, None], cols] = score
            near[who[part][:, None], cols] = here
        for i, row in enumerate(live):
            pick = top(worse[i], near[i], k)
            best[row, : len(pick)], best_ids[row, : len(pick)] = worse[i, pick], near[i, pick]
    row, col = np.nonzero(best < none)
    return row, best[row, col], best_ids[row, col]
