"""Samples over each ticker's history, cut in tasks from overlapping time ranges."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators.panel import KEYS

RANGE_DAYS = 200  # about 140 trading days: 29 days before each range are a fifth of it
OUT_BYTES = 16 << 20
MATRIX = "array<array<float>>"


def ranges_needed(panel: DataFrame, lookback: int, days: int = RANGE_DAYS) -> DataFrame:
    """ticker, _block, _target, _from: that the days of range `_block` from `_from` on are history of range `_target`. Keys only."""
    w = Window.partitionBy("ticker").orderBy("date")
    keys = panel.select("ticker", "date", _block(days).alias("_target"))
    firsts = keys.select("*", F.first("date").over(w.rowsBetween(-(lookback - 1), 0)).alias("_from"), F.lag("_target").over(w).alias("_last"))
    heads = firsts.where("_last IS NOT NULL AND _last <> _target")  # the first row of each range but a ticker's first
    return heads.select("ticker", F.explode(F.sequence(_block(days, "_from"), F.col("_target") - 1)).alias("_block"), "_target", "_from")


def _block(days: int, date: str = "date") -> Column:
    return F.floor(F.unix_date(F.col(date).cast("date")) / days).cast("long")


def cut_samples(
    panel: DataFrame, columns: list[str], lookback: int = 30, keep: Column | None = None, vector: str | None = None, matrices: DataFrame | None = None, width: int = 0, most: int = 64, days: int = RANGE_DAYS
) -> DataFrame:
    """One row for each stock-day with a full history: panel's columns, factor_seq and date_seq, oldest first, and the history of what is wide.

    vector names a column of panel: news_seq has its values. matrices (date, ticker, matrix) gives chunk_seq, each day's matrix with zero rows up to `most`, and chunk_mask_seq, which
    rows are its own. History comes from the whole panel, which has one row a ticker and date; `keep` picks the days that become samples.

    Rows go to the range of time they are in, and the last ones before a range to that range as well, as far back as its first day needs. A task has the rows of a range in
    order and holds `lookback` days, so a day's matrix is shuffled once and a fifth, not once for each sample, and a ticker with most rows is many ranges.
    """
    kept = [c for c in panel.columns if c not in ("factor_seq", "date_seq", "news_seq", "chunk_seq", "chunk_mask_seq")]
    factors = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    wide = F.col(vector).cast("array<float>") if vector else F.lit(None).cast("array<float>")
    rows = panel.select(
        "ticker", "date", _block(days).alias("_block"), F.lit(1).alias("_side"), F.coalesce(keep if keep is not None else F.lit(True), F.lit(False)).alias("_own"),
        factors.alias("_f"), wide.alias("_v"), F.lit(None).cast(MATRIX).alias("_m"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"),
    )
    if matrices is not None:
        held = matrices.select("ticker", "date", _block(days).alias("_block"), F.lit(0).alias("_side"), F.lit(False).alias("_own"), F.slice("matrix", 1, most).cast(MATRIX).alias("_m"))
        rows = rows.unionByName(held, allowMissingColumns=True)
    base = rows.repartition("ticker", "_block")
    needed = ranges_needed(panel, lookback, days)
    copies = base.join(needed, ["ticker", "_block"]).where("date >= _from").withColumns({"_block": F.col("_target"), "_own": F.lit(False), "_row": F.lit(None).cast(rows.schema["_row"].dataType)}).select(*rows.columns)
    # The window brings a range's rows together, in order; where a union keeps its sides' partitions, they are together already.
    place = F.row_number().over(Window.partitionBy("ticker", "_block").orderBy("date", "_side"))
    ordered = base.unionByName(copies.repartition("ticker", "_block")).select(place.alias("_n"), "_side", "_own", "date", "_f", "_v", "_m", "_row")

    doubles = T.ArrayType(T.ArrayType(T.DoubleType()))
    fields = [T.StructField(f.name, f.dataType) for f in panel.schema.fields if f.name in kept] + [T.StructField("factor_seq", doubles), T.StructField("date_seq", T.ArrayType(T.DateType()))]
    if vector:
        fields.append(T.StructField("news_seq", T.ArrayType(T.ArrayType(T.FloatType()))))
    if matrices is not None:
        fields += [T.StructField("chunk_seq", T.ArrayType(T.ArrayType(T.ArrayType(T.FloatType())))), T.StructField("chunk_mask_seq", T.ArrayType(T.ArrayType(T.BooleanType())))]

    names, carried, chunked, vectored = [f.name for f in fields], len(kept), matrices is not None, vector is not None
    day_bytes = 8 * len(columns) + 4 * most * width * chunked

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        past: deque = deque(maxlen=lookback)
        matrix = matrix_day = None
        for b in batches:
            places, sides, own, dates = (b.column(i).to_pylist() for i in range(4))
            at: list[int] = []
            made: list[tuple] = []
            size = 0
            for i in range(b.num_rows):
                if places[i] == 1:
                    matrix = None
                    past.clear()
                if sides[i] == 0:
                    matrix, matrix_day = _matrix(b.column(6)[i], width), dates[i]
                    continue
                v = b.column(5)[i].values
                past.append((b.column(4)[i].as_py(), dates[i], v.to_numpy(zero_copy_only=False) if v is not None else None, matrix if matrix is not None and matrix_day == dates[i] else None))
                if own[i] and len(past) == lookback:
                    at.append(i)
                    made.append(tuple(past))
                    size += lookback * day_bytes
                    if size >= OUT_BYTES:
                        yield _batch(b, at, made)
                        at, made, size = [], [], 0
            if at:
                yield _batch(b, at, made)

    def _batch(b: pa.RecordBatch, at: list[int], made: list[tuple]) -> pa.RecordBatch:
        given = b.column(7).take(pa.array(at))
        out = [given.field(i) for i in range(carried)]
        out += [pa.array([[d[0] for d in s] for s in made], pa.list_(pa.list_(pa.float64()))), pa.array([[d[1] for d in s] for s in made], pa.list_(pa.date32()))]
        if vectored:
            out.append(pa.array([[d[2] for d in s] for s in made], pa.list_(pa.list_(pa.float32()))))
        if chunked:
            full = np.zeros((len(made), lookback, most, width), dtype=np.float32)
            mask = np.zeros((len(made), lookback, most), dtype=bool)
            for i, s in enumerate(made):
                for j, (*_, m) in enumerate(s):
                    if m is not None:
                        full[i, j, : len(m)], mask[i, j, : len(m)] = m, True
            out += [_nested(full), _nested(mask)]
        return pa.RecordBatch.from_arrays(out, names=names)

    return ordered.mapInArrow(run, T.StructType(fields))


def _matrix(value: pa.ListScalar, width: int) -> np.ndarray | None:
    """A list of rows of one width as an array."""
    if not value.is_valid:
        return None
    rows = value.values
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(rows) * width:
        raise ValueError(f"a vector has not {width} components")
    return flat.reshape(len(rows), width)


def _nested(x: np.ndarray) -> pa.Array:
    """An array of n dimensions as n - 1 nested lists."""
    out = pa.array(x.ravel())
    for n in x.shape[:0:-1]:
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, n, dtype=np.int32) if n else np.zeros(1, dtype=np.int32)), out)
    return out


def day_matrices(vectors: DataFrame, order: list[str], most: int = 64) -> DataFrame:
    """ticker, date, matrix: the first `most` vectors of each stock-day in order."""
    ranked = vectors.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order))).where(F.col("_r") <= most)
    held = F.array_sort(F.collect_list(F.struct("_r", F.col("embedding").cast("array<float>").alias("v"))))
    return ranked.groupBy(*KEYS).agg(F.transform(held, lambda s: s["v"]).alias("matrix")).select("ticker", "date", "matrix")


def packed(vectors: DataFrame, order: list[str], most: int = 64) -> DataFrame:
    """ticker, date, matrix, length, offset: stock-days' matrices, their rows, and the rows of all stock-days before them by (ticker, date).

    Offsets come from counts: a running sum over a ticker's days, then over tickers, so no task sees more than a ticker's days or the list of tickers.
    """
    counts = vectors.groupBy(*KEYS).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("length"))
    days = Window.partitionBy("ticker").orderBy(F.col("date").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    tickers = Window.orderBy(F.col("ticker").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.groupBy("ticker").agg(F.sum("length").alias("_n")).select(F.col("ticker").alias("_t"), (F.sum("_n").over(tickers) - F.col("_n")).alias("_before"))
    inner = counts.withColumn("_in", F.sum("length").over(days) - F.col("length")).join(totals, F.col("ticker").eqNullSafe(F.col("_t")))
    places = inner.select(F.col("ticker").alias("_t"), F.col("date").alias("_d"), "length", (F.col("_before") + F.col("_in")).alias("offset"))
    return day_matrices(vectors, order, most).join(places, F.col("ticker").eqNullSafe(F.col("_t")) & F.col("date").eqNullSafe(F.col("_d"))).drop("_t", "_d")
