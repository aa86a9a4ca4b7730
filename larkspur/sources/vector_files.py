"""A Spark data source for manifests of vectors in NumPy files.

    spark.dataSource.register(ManifestVectors)
    spark.read.format("manifest_vectors").option("manifests", folder).option("root", folder).load().where("ticker = 'A'")

A partition is a range of a manifest's bytes, so planning lists the manifests and nothing else. A task reads the lines that begin in its range, drops those that pushed
conditions on ticker, date and id reject, and opens the files that the others name. No folder of vectors is listed.
"""

from __future__ import annotations

import fnmatch
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, place long, chunk_id string, ticker string, date date, model_name string, embedding_path string, publish_time string, source_news_id string, chunk_index int, embedding array<float>"
# What every manifest line must have.
REQUIRED = ("chunk_id", "embedding_path", "ticker", "date")
RANGE_BYTES = 4 << 20
BATCH_ROWS = 256


def opened(directory: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(directory) if "://" in directory or directory.startswith("file:") else (fs.LocalFileSystem(), directory)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class ManifestReader(DataSourceReader):
    """Reads ranges of manifests; `files_opened` counts the vector files that this reader opened."""

    def __init__(self, options: dict[str, str]):
        self.manifests = options["manifests"]
        self.root = options.get("root", self.manifests)
        self.pattern = options.get("pattern", "manifest.jsonl")
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.filters: list[Filter] = []
        self.files_opened = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions on the key columns; Spark checks the others."""
        for f in filters:
            if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute in (("ticker",), ("date",), ("chunk_id",)):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, root = opened(self.manifests)
        out = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if info.type == fs.FileType.File and fnmatch.fnmatch(info.base_name, self.pattern):
                out += [Range(info.path, a, min(a + self.range_bytes, info.size)) for a in range(0, info.size, self.range_bytes)]
        return out

    def wanted(self, row: dict) -> bool:
        for f in self.filters:
            x, value = row[f.attribute[0]], getattr(f, "value", None)
            if isinstance(f, EqualTo) and x != value:
                return False
            if isinstance(f, In) and x not in f.value:
                return False
            if isinstance(f, GreaterThan) and not x > value or isinstance(f, GreaterThanOrEqual) and not x >= value or isinstance(f, LessThan) and not x < value or isinstance(f, LessThanOrEqual) and not x <= value:
                return False
        return True

    @staticmethod
    def lines(store, part: Range) -> Iterator[tuple[int, bytes]]:
        """(place, line) of the lines that begin in a range. The byte before it tells whether a line begins at its start."""
        with store.open_input_file(part.path) as f:
            f.seek(max(0, part.start - 1))
            stream = io.BufferedReader(f, 1 << 20)
            at = max(0, part.start - 1)
            if part.start:
                at += len(stream.readline())
            while at < part.end:
                line = stream.readline()
                if not line:
                    return
                yield at, line
                at += len(line)

    def vector(self, store, root: str, manifest: str, named: str) -> np.ndarray | None:
        """The array of a named file: as named, under the root, beside the manifest, or by its base name beside it; None if there is none."""
        beside = manifest.rsplit("/", 1)[0]
        base = named.rsplit("/", 1)[-1]
        for path in [*([named] if named.startswith("/") else []), f"{root.rstrip('/')}/{named}", f"{beside}/{named}", f"{beside}/{base}"]:
            try:
                with store.open_input_file(path) as f:
                    self.files_opened += 1
                    return np.load(io.BytesIO(f.read()), allow_pickle=False).astype(np.float32).ravel()
            except (FileNotFoundError, NotADirectoryError):
                continue
        return None

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        import datetime as dt

        store, _ = opened(self.manifests)
        vectors, root = opened(self.root)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.date32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float32())]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

        for at, line in self.lines(store, part):
            if not line.strip():
                continue
            try:
                row = json.loads(line)
                missing = [c for c in REQUIRED if row.get(c) is None]
            except (ValueError, AttributeError) as e:
                raise ValueError(f"{part.path}, byte {at}: a manifest line cannot be read") from e
            if missing:
                raise ValueError(f"{part.path}, byte {at}: a manifest line lacks {missing}")
            row |= {"date": dt.date.fromisoformat(str(row["date"])[:10]), "ticker": str(row["ticker"]).strip().upper(), "chunk_id": str(row["chunk_id"])}
            if self.wanted(row):
                rest = [row.get(c) for c in ("model_name", "embedding_path", "publish_time", "source_news_id", "chunk_index")]
                held.append((part.path, at, row["chunk_id"], row["ticker"], row["date"], *rest, self.vector(vectors, root, part.path, row["embedding_path"])))
                if len(held) >= BATCH_ROWS:
                    yield batch()
                    held.clear()
        if held:
            yield batch()


class ManifestVectors(DataSource):
    """Manifest rows with their vectors. Options: manifests (folder), root (of the vectors; the same folder if not given), pattern (of manifests' names), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "manifest_vectors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ManifestReader:
        return ManifestReader(self.options)
