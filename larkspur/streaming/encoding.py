"""Chunks encoded as they arrive, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from larkspur.operators.pipelines import encode_chunks
from larkspur.sources.manifests import VectorStore


def encode_batch(chunks: DataFrame, batch: str, store: VectorStore, make: Callable, model_name: str) -> bool:
    """Encode the chunks that the store lacks and commit them as the batch; a batch that is committed is not encoded again."""
    if store.table.committed(batch):
        return False
    return store.save(encode_chunks(chunks.dropDuplicates(["chunk_id"]), store.ids(), make, model_name), batch)


def encode_arrivals(stream: DataFrame, store: VectorStore, make: Callable, model_name: str, checkpoint: str, name: str = "encode") -> DataStreamWriter:
    """A writer that encodes a stream of chunks into the store. The stream's batches are the store's commits, so a batch that is replayed after a failure is there once."""
    def each(chunks: DataFrame, number: int) -> None:
        encode_batch(chunks, f"{name}-{number:012d}", store, make, model_name)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(name)
