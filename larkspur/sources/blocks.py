"""Stock-days' vectors in binary files, read by range.

A file is a sequence of blocks, one a stock-day: its vectors as rows of float32, little-endian. Behind them lie an index (ticker, day, first byte, rows, width) as an
Arrow stream, its length as 8 bytes and the mark `LKB1`. All files' indexes are also one Parquet table beside them, by which a reader finds the
file and bytes of a stock-day without opening anything else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.history import day_matrices
from larkspur.operators.vectors import first_of_each
from larkspur.sources.tables import exists

MARK = b"LKB1"
INDEX = "file string, ticker string, date date, start long, rows int, width int"
ORDER = ["publish_time", "source_news_id", "chunk_index", "chunk_id"]
FILE_BYTES = 256 << 20


def opened(directory: str):
    """(file system, path) of a folder that all tasks reach, by its URI or path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(directory) if "://" in directory or directory.startswith("file:") else (fs.LocalFileSystem(), directory)


class BlockFile:
    """A file being written: under a hidden name until it is whole."""

    def __init__(self, directory: str, name: str):
        self.store, self.root = opened(directory)
        self.store.create_dir(self.root, recursive=True)
        self.name = name
        self.hidden = f"{self.root}/_{name}.{uuid.uuid4().hex}"
        self.stream = self.store.open_output_stream(self.hidden, compression=None)
        self.size = 0
        self.index: list[tuple] = []

    def add(self, ticker: str, date, rows: np.ndarray) -> None:
        self.index.append((self.name, ticker, date, self.size, *rows.shape))
        data = np.ascontiguousarray(rows, dtype="<f4").tobytes()
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> pa.RecordBatch:
        """Its index, once the file is in its place."""
        kinds = [pa.string(), pa.string(), pa.date32(), pa.int64(), pa.int32(), pa.int32()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*self.index, strict=True), kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        footer = sink.getvalue().to_pybytes()
        self.stream.write(footer + len(footer).to_bytes(8, "little") + MARK)
        self.stream.close()
        self.store.move(self.hidden, f"{self.root}/{self.name}")
        return batch


def footer(directory: str, name: str) -> pa.Table:
    """A file's own index, from its end."""
    store, root = opened(directory)
    with store.open_input_file(f"{root}/{name}") as f:
        size = f.size()
        tail = f.read_at(12, size - 12)
        if tail[8:] != MARK:
            raise ValueError(f"{name} is no block file")
        n = int.from_bytes(tail[:8], "little")
        return pa.ipc.open_stream(f.read_at(n, size - 12 - n)).read_all()


def write_blocks(vectors: DataFrame, directory: str, most: int = 64, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the first `most` vectors of each stock-day, by publication time, news and place, and return the index, which is written last.

    vectors: chunk_id, date, ticker, embedding, the columns of the order, and path and line to tell which of repeated chunks is first. Rows go out by ranges of (ticker, date);
    each task writes the stock-days of its range, sorted, one at a time. A task that runs again writes other files, which no index names.
    """
    spark = vectors.sparkSession
    once = first_of_each(vectors.where("embedding IS NOT NULL"))
    ranked = once.withColumn("_r", F.row_number().over(Window.partitionBy("ticker", "date").orderBy(*ORDER))).where(F.col("_r") <= most)
    lined = ranked.select("ticker", "date", "_r", F.col("embedding").cast("array<float>").alias("v")).repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date", "_r")
    where = f"{directory.rstrip('/')}/blocks"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me, made = TaskContext.get().partitionId(), 0
        file: BlockFile | None = None
        key, held = None, []

        def flush() -> None:
            nonlocal file
            if held:
                file = file or BlockFile(where, f"part-{me:06d}-{made:04d}-{uuid.uuid4().hex[:12]}.blocks")
                file.add(*key, np.stack(held))
                held.clear()

        for b in batches:
            for ticker, date, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if (ticker, date) != key:
                    flush()
                    if file and file.size >= file_bytes:
                        yield file.close()
                        file, made = None, made + 1
                    key = (ticker, date)
                held.append(v.values.to_numpy(zero_copy_only=False))
        flush()
        if file:
            yield file.close()

    lined.select("ticker", "date", "v").mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{directory.rstrip('/')}/index.parquet")
    return read_index(spark, directory)


def read_index(spark: SparkSession, directory: str) -> DataFrame:
    """file, ticker, date, start, rows, width of every stock-day."""
    return spark.read.schema(INDEX).parquet(f"{directory.rstrip('/')}/index.parquet")


def summary(index: DataFrame) -> DataFrame:
    """One row: stock-days, chunks, width."""
    return index.agg(F.count(F.lit(1)).alias("stock_days"), F.coalesce(F.sum("rows"), F.lit(0)).alias("chunks"), F.max("width").alias("width"))


def read_blocks(index: DataFrame, directory: str) -> DataFrame:
    """ticker, date, matrix of the stock-days in a part of the index: only their bytes are read.

    Ask for stock-days by a condition on the index or by a join with it. Each task opens the files of its stock-days once and reads them in order.
    """
    where = f"{directory.rstrip('/')}/blocks"
    names = ["ticker", "date", "matrix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(where)
        name, f = None, None
        try:
            for b in batches:
                for row in b.to_pylist():
                    if row["file"] != name:
                        if f:
                            f.close()
                        name, f = row["file"], store.open_input_file(f"{root}/{row['file']}")
                    rows, width = row["rows"], row["width"]
                    data = f.read_at(4 * rows * width, row["start"])
                    flat = pa.array(np.frombuffer(data, dtype="<f4"))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, dtype=np.int32)), flat)
                    matrix = pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), lists)
                    yield pa.RecordBatch.from_arrays([pa.array([row["ticker"]]), pa.array([row["date"]], pa.date32()), matrix], names=names)
        finally:
            if f:
                f.close()

    return index.repartition("file").sortWithinPartitions("file", "start").mapInArrow(run, "ticker string, date date, matrix array<array<float>>")


def packed_or_direct(spark: SparkSession, directory: str | None, vectors: DataFrame, most: int = 64) -> DataFrame:
    """ticker, date, matrix: from the block files if they are there, else made from the vectors."""
    if directory and exists(spark, f"{directory.rstrip('/')}/index.parquet"):
        return read_blocks(read_index(spark, directory), directory)
    return direct(vectors, most)


def direct(vectors: DataFrame, most: int = 64) -> DataFrame:
    """What the block files hold, made from the vectors each time."""
    return day_matrices(first_of_each(vectors.where("embedding IS NOT NULL")), ORDER, most)
