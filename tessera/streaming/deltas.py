"""Streams of text deltas and of new files, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import sse_results
from tessera.schemas import DELTA


def delta_stream(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """Rows (stream_id, seq, chunk) of JSON files as they arrive in a folder."""
    return spark.readStream.schema(DELTA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def watched(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def accumulated(deltas: DataFrame) -> DataFrame:
    """One row (stream_id, content, chunks) for each stream: its chunks in the order of ``seq``, whatever order they came in. Works
    on streams (update or complete mode) and on tables."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "chunk"))), lambda x: x["chunk"])
    return deltas.groupBy("stream_id").agg(F.array_join(parts, "").alias("content"), F.count("chunk").alias("chunks"))


def first_chunks(deltas: DataFrame) -> DataFrame:
    """One row (stream_id, chunk): what a caller that waits for the first chunk only gets."""
    return deltas.groupBy("stream_id").agg(F.min_by("chunk", "seq").alias("chunk"))


def sse_deltas(raw: DataFrame) -> DataFrame:
    """Chunks of a server's event stream as deltas: each event of a chunk is one; ``seq`` is a struct of the chunk's number and the
    event's in it, which keeps their order at any number of events."""
    return raw.select("stream_id", "seq", F.posexplode(sse_results(F.col("chunk"))).alias("k", "chunk")).select("stream_id", F.struct("seq", "k").alias("seq"), "chunk")


def relayed(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", once: bool = True) -> StreamingQuery:
    """Hand each batch to a callable; ``once`` ends when all that is there was read."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def cancellable(spark: SparkSession, signal: str, action: Callable[[], object]) -> object:
    """Run an action under a signal's name; cancel() with that name stops its jobs."""
    spark.addTag(signal)
    try:
        return action()
    finally:
        spark.removeTag(signal)


def cancel(spark: SparkSession, signal: str) -> list[str]:
    return spark.interruptTag(signal)
