"""Where intermediate tables go: always the folder the cluster shares, never a machine's own."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local master without that setting gets one of its own (as in tests)."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = os.path.join(tempfile.gettempdir(), "checkpoints")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def fresh_dir(spark: SparkSession, prefix: str) -> str:
    """A new name under the shared folder; nothing is created yet."""
    return f"{shared_dir(spark).rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that later stages do not depend on its lineage or on any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Notes:
    """The narrow tables that a run's rounds pass on, as Parquet under the shared folder until the run clears them.

    Read back, Spark knows how large they are and reads many small files in one task: a join with a small one needs no shuffle. What a checkpoint
    would keep besides, how rows are dealt, is worth less than that here.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.where = spark, fresh_dir(spark, "notes")

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.where}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


BATCH_ROWS, BATCH_BYTES = 256, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df in a session of its own that hands rows to Python in batches of bounded rows and bytes: texts and packs of sketches are wide.

    The session is a copy of df's, with all its settings as they are now; df's own session stays as it is. What is made of
    the result runs with the copy's settings, unless it is joined to the right of a table of another session.
    """
    spark = df.sparkSession
    copy = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    copy.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    copy.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = spark.sparkContext._jvm.org.apache.spark.sql.classic.Dataset.ofRows(copy._jsparkSession, df._jdf.logicalPlan())
    return DataFrame(rows, copy)


def released(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """run, a task's function in Python, after which the worker gives unused memory back to the system: workers live on between stages."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return task


def trim() -> None:
    """Give the memory that this process does not use back to the system."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its memory
        ctypes.CDLL(None).malloc_trim(0)


def settle(spark: SparkSession) -> None:
    """Have every executor collect its garbage, so that its heap shrinks before Python workers need memory beside it.

    A heap that earlier stages filled stays at its largest otherwise. A few short tasks a core reach all executors, or nearly all; one that is missed loses nothing.
    """
    n = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("reflect('java.lang.System', 'gc') AS done").where("done IS NULL").count()
