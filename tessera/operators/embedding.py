"""From chunks to vectors: batches for an embedding service, and its answers put back in place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.tokens import BATCH_LIMIT, approximate_tokens
from tessera.plans.ranking import running

CONCURRENCY = 2


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], content: str = "page_content", count: Callable[[str], int] = lambda s: -(-len(s) // 4), limit: int = BATCH_LIMIT, concurrency: int | None = None) -> DataFrame:
    """``chunks`` with ``embedding``. Each task fills batches by token count, in row order, and calls the service once a batch: a text
    joins while the sum is within the limit, an oversize text is a batch by itself. ``concurrency`` bounds the calls at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(content)).to_pylist()
            vectors: list = []
            held: list[str] = []
            used = 0
            for text in [t or "" for t in texts]:
                n = count(text)
                if held and used + n > limit:
                    vectors += embed(held)
                    held, used = [], 0
                held.append(text)
                used += n
            if held:
                vectors += embed(held)
            if len(vectors) != len(texts):
                raise ValueError("the service gave another number of vectors than texts")
            yield batch.append_column("embedding", pa.array(vectors, pa.list_(pa.float32())))

    rows = chunks.drop("embedding")
    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return (rows.repartition(concurrency) if concurrency else rows).mapInArrow(run, schema)


def reassociated(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Rows (batch, pos, text, embedding): requests (batch, texts) and responses (batch, data) joined by place."""
    asked = requests.select("batch", F.posexplode("texts").alias("pos", "text"))
    got = responses.select("batch", F.posexplode("data").alias("pos", "embedding"))
    return asked.join(got, ["batch", "pos"])


def task_batches(rows: DataFrame, order: str, size: int, name: str = "batch", group: list[str] | None = None) -> DataFrame:
    """``rows`` with the number of its run of ``size`` rows, in order, inside each group."""
    placed = running(rows, group or [], [order], F.lit(1).cast("long"), "__ts_place")
    return placed.withColumn(name, F.floor(F.col("__ts_place") / size).cast("int")).drop("__ts_place")


def document_id(*columns: str) -> Column:
    """A stable id of a row's contents."""
    return F.sha2(F.concat_ws("\x1f", *(F.col(c).cast("string") for c in columns)), 256)


def oversized(chunks: DataFrame, content: str = "page_content", limit: int = BATCH_LIMIT) -> DataFrame:
    """Chunks that no batch could take together with another."""
    return chunks.where(approximate_tokens(F.col(content)) > limit)
