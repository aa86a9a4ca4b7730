"""Importance resampling: draw the documents that look most like a target, in proportion, without replacement.

Features are all runs of 1 to `longest` words, hashed into buckets. A bucket's gain is the log ratio of its share in the target texts and in the
documents, both with one count more, in thousandths, rounded down: one array that every task scores by. A document's weight is the mean gain of its features. Its weight and a
Gumbel variable from a hash of its key make its score; the highest scores are a draw in proportion to the weights.

The draw: scores are whole numbers that a double's logarithm bounds, so there are at most some 100,000 different ones, whatever the table. Their
counts give the exact score at which the draw ends, how many rows lie above each score, and key ranges of a few thousand rows. Only rows at or above the last score go on. Each
partition sorts its own into a run, cut into blocks at the ranges; the blocks of a range meet in one task, in order of their first rows, and a
tournament tree merges the runs from there, opening a block when its turn comes. It stops at the exact number of rows to draw.

Words are runs of ASCII digits, letters and characters beyond ASCII, A to Z lower-cased. A null or empty text has none and weighs 0. Ties of scores go to the smaller key, a null key
last, then to fewer features and the smaller weight. Equal rows are one entry with a count, so a key that a third of the rows share is no hot spot, and each of
them has a rank of its own. An empty table gives an empty one; an empty target has no counts. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.ranks import unfold
from larkspur.llm.store import cut
from larkspur.llm.tournament import merged

LONGEST, BUCKETS = 1, 10_000
LEAST_WORDS, PERCENT = 20, 10
SEED = "2024"
KNOWN_FEATURES = 1 << 19  # features whose bucket a task remembers
RANGE_ROWS, BLOCK_ROWS = 4_096, 1_024
# ASCII letters are lower-cased; other ASCII characters but digits part words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class BucketOf(dict):
    """A feature's bucket, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_FEATURES:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found


def features(words: list[bytes], longest: int) -> Iterator[bytes]:
    yield from words
    for n in range(2, longest + 1):
        for i in range(len(words) - n + 1):
            yield b" ".join(words[i : i + n])


def bucketed(known: BucketOf, longest: int) -> Callable[[str | None], tuple[int, np.ndarray]]:
    """For a text: how many words it has, and its features' buckets."""
    def read(text: str | None) -> tuple[int, np.ndarray]:
        words = words_of(text)
        each = words if longest == 1 else features(words, longest)
        return len(words), np.fromiter(map(known.__getitem__, each), dtype=np.int64)

    return read


def counts(df: DataFrame, text: str, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of df's texts each bucket has. Every task sums its own; at most `buckets` sums come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, total = bucketed(BucketOf(buckets), longest), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(read(t.as_py())[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in df.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target and in the source, rounded down."""
    n, t_all, s_all = len(source), int(target.sum()), int(source.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + n) / (float(s + 1) * float(t_all + n)))) for t, s in zip(target.tolist(), source.tolist(), strict=True)], dtype=np.int64)


def gumbel(key: int | None, seed: str = SEED) -> int:
    """Thousandths of a standard Gumbel variable of the key, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "_key long, n_features long, weight long, score long, enough boolean"


def scored(df: DataFrame, key: str, text: str, gain: np.ndarray, least_words: int = LEAST_WORDS, longest: int = LONGEST, seed: str = SEED) -> DataFrame:
    """_key, n_features, weight, score, and whether the document has enough words to be drawn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = bucketed(BucketOf(len(gain)), longest)
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, at = read(t.as_py())
                weight = int(gain[at].sum()) // len(at) if len(at) else 0
                rows.append((k, len(at), weight, weight + gumbel(k, seed), words >= least_words))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.bool_())], names=["_key", "n_features", "weight", "score", "enough"])

    return df.select(F.col(key).cast("long").alias("_key"), text).mapInArrow(run, SCORED)


class Plan:
    """Where a draw of `wanted` rows ends, and its ranges: from the exact counts of all scores."""

    def __init__(self, histogram: dict[int, int], wanted: int, range_rows: int = RANGE_ROWS):
        self.wanted = wanted
        self.last = None  # the lowest score of the draw
        self.ends: list[int] = []  # the negated last score of each range
        self.before: list[int] = []  # rows before each range
        above = held = 0
        for score in sorted(histogram, reverse=True):
            if above >= wanted:
                break
            if held == 0 or held + histogram[score] > range_rows:
                self.before.append(above)
                self.ends.append(-score)
                held = 0
            self.ends[-1], self.last = -score, score
            held += histogram[score]
            above += histogram[score]

    def range_of(self, negated: int) -> int:
        return bisect_left(self.ends, negated)


def _entry(row: tuple) -> tuple:
    key, n_features, weight, score, copies = row
    return -score, key is None, key or 0, n_features, weight, copies


BLOCK = "range int, run int, first_score long, first_null boolean, first_key long, first_features long, first_weight long, body binary"


def runs(candidates: DataFrame, plan: Plan, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every partition's rows as one sorted run, in blocks that lie in one range each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId()
        rows = (_entry(r) for b in batches for r in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True))
        for place, inside in groupby(rows, lambda e: plan.range_of(e[0])):
            held: list[tuple] = []

            def block(place=place) -> pa.RecordBatch:
                row = [place, me, *held[0][:5], np.array(held, dtype="<i8").tobytes()]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BLOCK.split(", ")])

            for e in inside:
                held.append(e)
                if len(held) == block_rows:
                    yield block()
                    held = []
            if held:
                yield block()

    ordered = candidates.sortWithinPartitions(F.col("score").desc(), F.col("_key").asc_nulls_last(), "n_features", "weight")
    return ordered.select("_key", "n_features", "weight", "score", "copies").mapInArrow(run, BLOCK)


def draw(blocks: DataFrame, plan: Plan) -> DataFrame:
    """_key, n_features, weight, score, copies, first: the rank of the first of a row's copies, NULL where the draw has ended."""
    order = ["range", "first_score", "first_null", "first_key", "first_features", "first_weight", "run"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrived() -> Iterator[tuple[int, int, list[tuple]]]:
            for b in batches:
                for place, me, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    yield place, me, list(map(tuple, np.frombuffer(body.as_py(), dtype="<i8").reshape(-1, 6).tolist()))

        names = ["_key", "n_features", "weight", "score", "copies", "first"]
        held: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=names)

        for place, inside in groupby(arrived(), lambda x: x[0]):
            at = plan.before[place]
            for negated, null, key, n_features, weight, copies in merged((me, block) for _, me, block in inside):
                row = (None if null else key, n_features, weight, -negated)
                drawn = min(copies, max(0, plan.wanted - at))
                if drawn:
                    held.append((*row, drawn, at + 1))
                if copies > drawn:
                    held.append((*row, copies - drawn, None))
                at += copies
                if len(held) >= 4096:
                    yield made()
                    held.clear()
            if held:
                yield made()
                held.clear()

    met = blocks.repartition("range").sortWithinPartitions(*order).select("range", "run", "body")
    return met.mapInArrow(run, "_key long, n_features long, weight long, score long, copies long, first long")


def resample(
    df: DataFrame, key: str, text: str, target: DataFrame, target_text: str, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    longest: int = LONGEST, buckets: int = BUCKETS, seed: str = SEED,
) -> DataFrame:
    """Every row of df: key, n_features, weight, score, rank (NULL unless drawn). Of the rows with enough words, `percent` in a hundred are drawn."""
    gain = gains(counts(target, target_text, longest, buckets), counts(df, text, longest, buckets))
    rows = cut(scored(df, key, text, gain, least_words, longest, seed))
    histogram: dict[int, int] = defaultdict(int)
    for r in rows.where("enough").groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram[r["score"]] = r["n"]
    plan = Plan(histogram, sum(histogram.values()) * percent // 100)
    names = [F.col("_key").alias(key), "n_features", "weight", "score", "rank"]
    if plan.last is None:
        return rows.withColumn("rank", F.lit(None).cast("long")).select(*names)
    high = F.col("enough") & (F.col("score") >= plan.last)
    candidates = rows.where(high).groupBy("_key", "n_features", "weight", "score").agg(F.count(F.lit(1)).alias("copies"))
    ranked = unfold(draw(runs(candidates, plan), plan), "copies", "first", "rank")
    return rows.where(~high).withColumn("rank", F.lit(None).cast("long")).select(*names).unionByName(ranked.select(*names))
