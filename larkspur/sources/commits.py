"""Tables that grow by commits: what is saved twice is there once, and what is half saved is not there."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.tables import exists

ENTRY = "batch string, folder string, rows long"


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file with its whole text, or return False if there is one: of several at once, one succeeds.

    The text is written beside it and then renamed, which must be atomic and must not replace (HDFS, a shared POSIX folder).
    """
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        return False
    stream = fs.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), none)
    except Exception as e:
        fs.delete(aside, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


@dataclass(frozen=True)
class CommittedTable:
    """A Parquet table under a root: data in folders of their own, and a log with an entry for each committed batch.

    A batch's files are written aside first. Creating its entry, named by the batch, commits them; readers read the folders that entries name, so they see a batch whole or
    not at all. Whoever comes second with a batch id changes nothing; the folder it may have written is named by no entry.
    """

    spark: SparkSession
    root: str

    @property
    def log(self) -> str:
        return f"{self.root.rstrip('/')}/log"

    def entries(self) -> list[dict[str, Any]]:
        """batch, folder, rows of every commit, by batch: one line each."""
        if not exists(self.spark, self.log):
            return []
        files = self.spark.read.option("pathGlobFilter", "*.json").schema(ENTRY).json(self.log)
        return sorted((r.asDict() for r in files.collect()), key=lambda e: e["batch"])

    def committed(self, batch: str) -> bool:
        return exists(self.spark, self._entry(batch))

    def _entry(self, batch: str) -> str:
        if not re.fullmatch(r"[\w.=-]+", batch):
            raise ValueError(f"no name for a batch: {batch}")
        return f"{self.log}/{batch}.json"

    def append(self, df: DataFrame, batch: str | None = None) -> bool:
        """Add df as one batch (of a new id, if none is given); False if that batch is there."""
        batch = batch or uuid.uuid4().hex
        entry = self._entry(batch)
        if self.committed(batch):
            return False
        folder = f"data/{batch}-{uuid.uuid4().hex}"
        where = f"{self.root.rstrip('/')}/{folder}"
        df.write.parquet(where)
        rows = self.spark.read.schema(df.schema).parquet(where).count()
        return create_once(self.spark, entry, json.dumps({"batch": batch, "folder": folder, "rows": rows}) + "\n")

    def load(self, schema: str) -> DataFrame:
        """All committed rows."""
        folders = [f"{self.root.rstrip('/')}/{e['folder']}" for e in self.entries()]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
