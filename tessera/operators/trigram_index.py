"""Text search over a corpus by a stored positional index of trigrams: what is found, and where, is known without reading a text.

Texts lie behind one another in blocks of bounded size. A row of the index is a trigram with all places in one block where it begins, in code points of
the lower-cased texts, as gaps in as few bytes as each needs; two marks that no text holds follow each text. A trigram is one number, ordered by its
characters. A block's first row has no trigram: it tells which texts the block holds and where they begin. Blocks are written by the task that
reads their texts: nothing is shuffled, a block is whole in one file, and each file is in the order of trigrams with small row groups, so
a reading of few trigrams opens few of them. The trigrams that cover a wanted text have fixed distances: it occurs where
their lists, each shifted by its distance, meet. Wanted texts of one or two characters are ranges of trigrams.

Null texts and null keys are not indexed; an empty wanted text is found nowhere; null ones give no row. Rows of a repeated key are searched each by itself
and give the union of their places.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import SLICE
from tessera.plans.staging import scratch

#: Bits of a character in a trigram's number; beyond all characters: the mark after a text's end.
BITS, MARK = 21, (1 << 21) - 1
#: Code points of a block; a longer text is a block by itself.
BLOCK = 1 << 19
#: In place of a trigram, before all of them: the block's texts.
TEXTS = -1
INDEX = "gram long, block long, at binary, keys array<long>, begins array<int>"
FOUND = "wanted string, key long, starts array<int>"
#: Bytes of a row group in a file of the index.
GROUP = 16 << 20
#: Ranges of trigrams up to which they are written into the scan's filter.
FILTERED = 500


def packed(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 to 2**35 as bytes of seven bits, the lowest first, the eighth bit set where more follow; and where each number ends."""
    width = 1 + sum((numbers >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(width)
    out = np.empty(ends[-1], np.uint8)
    for k in range(width.max()):
        has = np.flatnonzero(width > k)
        out[ends[has] - width[has] + k] = numbers[has] >> 7 * k & 127 | (width[has] > k + 1) * 128
    return out, ends


def unpacked(data: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.append(True, data[:-1] < 128))
    place = np.arange(len(data)) - np.repeat(first, np.diff(first, append=len(data)))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, first)


def block(texts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """The index's rows of (key, code points), none of which is empty."""
    spans = np.array([len(points) + 2 for _, points in texts])
    marks = np.full(2, MARK, np.uint32)
    points = np.concatenate([x for _, points in texts for x in (points, marks)]).astype(np.int64)
    grams = points[:-2] << 2 * BITS | points[1:-1] << BITS | points[2:]
    at = np.flatnonzero(points[:-2] != MARK)
    at = at[np.argsort(grams[at], kind="stable")]
    grams = grams[at]
    starts = np.flatnonzero(np.diff(grams, prepend=-1))
    gaps = np.diff(at, prepend=0)
    gaps[starts] = at[starts]
    data, ends = packed(gaps)
    offsets = np.append(0, ends[np.append(starts[1:], len(at)) - 1]).astype(np.int32)
    lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    after = lambda one, kind: pa.concat_arrays([pa.array([one], kind), pa.nulls(len(starts), kind)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(TEXTS, grams[starts])),
            pa.array(np.full(len(starts) + 1, uuid.uuid4().int >> 65)),
            pa.concat_arrays([pa.nulls(1, pa.binary()), lists]),
            after([key for key, _ in texts], pa.list_(pa.int64())),
            after(np.cumsum(spans) - spans, pa.list_(pa.int32())),
        ],
        ["gram", "block", "at", "keys", "begins"],
    )


def build(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the index of ``docs`` and return it."""
    most = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                for name, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    points = np.frombuffer(content.encode("utf-32-le"), dtype=np.uint32)
                    if held and size + len(points) > most:
                        yield block(held)
                        held, size = [], 0
                    if len(points):
                        held.append((name, points))
                        size += len(points)
        if held:
            yield block(held)

    spark, path = docs.sparkSession, path or scratch(docs.sparkSession, "trigrams")
    rows = docs.select(F.col(key).cast("long"), F.lower(text).alias("text")).where(F.col(key).isNotNull() & F.col("text").isNotNull())
    rows.mapInArrow(run, INDEX).sortWithinPartitions("gram", "block").write.option("compression", "zstd").option("parquet.block.size", GROUP).parquet(path)
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def covering(wanted: str) -> list[tuple[int, int, int]]:
    """(distance, least number, greatest number) of the trigrams that cover a lower-cased text."""
    points = [ord(c) for c in wanted]
    number = lambda a, b, c: a << 2 * BITS | b << BITS | c
    if len(points) < 3:
        fill = lambda x: [*points, x, x][:3]
        return [(0, number(*fill(0)), number(*fill(MARK)))] if points else []
    return [(i, number(*points[i : i + 3]), number(*points[i : i + 3])) for i in sorted({*range(0, len(points) - 2, 3), len(points) - 3})]


def asked(spark: SparkSession, wanted: list[str]) -> list[tuple]:
    """(text, length, parts, distance, low, high) of every trigram of the lower-cased texts."""
    texts = sorted({t for t in wanted if t})
    lowered = {r.t: r.low for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.lower("t").alias("low")).collect()} if texts else {}  # as the index lowers
    return [(t, len(lowered[t]), len(parts), *p) for t in texts for parts in [covering(lowered[t])] for p in parts]


def read(index: DataFrame, parts: list[tuple]) -> DataFrame:
    """The index's rows of these trigrams and of the blocks' texts; few trigrams are filters of the scan."""
    ranges = sorted({(low, high) for *_, low, high in parts})
    if len(ranges) > FILTERED:
        return index
    kept: Column = F.col("gram").isin([TEXTS, *(low for low, high in ranges if low == high)])
    for low, high in ranges:
        if low < high:
            kept = kept | F.col("gram").between(low, high)
    return index.where(kept)


def found(index: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows (wanted, key, starts): where each text begins, overlaps included, ascending from 0."""
    parts = asked(index.sparkSession, wanted)
    covers: dict[str, list[tuple[int, int, int]]] = {}
    for t, _, _, *cover in parts:
        covers.setdefault(t, []).append(tuple(cover))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("gram")
        grams, lists = rows.column("gram").to_numpy(), rows.column("at").combine_chunks()
        keys, begins = (rows.column(c)[0].values.to_numpy() for c in ("keys", "begins"))

        def places(low: int, high: int) -> np.ndarray:
            met = range(np.searchsorted(grams, low), np.searchsorted(grams, high, "right"))
            return np.sort(np.concatenate([np.empty(0, np.int64), *(np.cumsum(unpacked(np.frombuffer(lists[i].as_buffer(), np.uint8))) for i in met)]))

        out = [pa.table({"wanted": pa.array([], pa.string()), "key": pa.array([], pa.int64()), "starts": pa.array([], pa.list_(pa.int32()))})]
        for t, cover in covers.items():
            common = None
            for distance, low, high in cover:
                at = places(low, high) - distance
                common = at if common is None else np.intersect1d(common, at, assume_unique=True)
                if not len(common):
                    break
            else:
                which = np.searchsorted(begins, common, "right") - 1
                cut = np.flatnonzero(np.diff(which, prepend=-1))
                starts = pa.ListArray.from_arrays(pa.array(np.append(cut, len(which)).astype(np.int32)), pa.array((common - begins[which]).astype(np.int32)))
                out.append(pa.table({"wanted": pa.array([t] * len(cut), pa.string()), "key": pa.array(keys[which[cut]]), "starts": starts}))
        return pa.concat_tables(out)

    run.__annotations__ = {"rows": pa.Table, "return": pa.Table}
    met = read(index, parts).groupBy("block").applyInArrow(run, FOUND)
    return met.groupBy("wanted", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))


def counted(index: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows (wanted, key, matches, first_at): matches that do not overlap, leftmost first, and the place of the first, from 1."""
    fold = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("free")),
        lambda acc, x: F.when(x >= acc["free"], F.struct((acc["n"] + 1).alias("n"), (x + F.col("size")).alias("free"))).otherwise(acc),
    )
    spark = index.sparkSession
    sizes = F.broadcast(spark.createDataFrame(sorted({(t, n) for t, n, *_ in asked(spark, wanted)}), "wanted string, size int"))
    return found(index, wanted).join(sizes, "wanted").select("wanted", "key", fold["n"].alias("matches"), (F.element_at("starts", 1) + 1).alias("first_at"))
