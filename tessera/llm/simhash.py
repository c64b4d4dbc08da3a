"""Near-duplicates by SimHash, with pigeonring filtering of candidates.

A fingerprint's 64 bits are eight segments on a ring. If two fingerprints differ in at most two bits, some start exists from
which every chain of k consecutive segments has at most floor(2k / 8) differences: none over three segments, one over seven. So the
first three segments are equal, and of the next four at least the first two or the last two: 40 equal bits, which make a
bucket key for each start and half. Fingerprints that are alone in all their buckets have no partner and go no further.

The others are checked on all 64 bits without pairing the members of a bucket: each is dealt to its 65 neighbourhood centres (itself
and each one-bit flip). Two fingerprints differ in at most two bits just when they share a centre, and a centre has at most 65
members, so the work is linear whatever the buckets' sizes. Only distinct fingerprints meet: exact copies cost nothing.

Nulls, empty and blank texts have fingerprint zero and are linked like others. Rows without an id have no say in a
component's smallest id; a component without ids has a null one. Repeated rows are members like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.process_cache import give_back, only
from tessera.llm.words import slices
from tessera.plans.components import roots
from tessera.plans.staging import staged

SHINGLE, SEED, RADIUS, SEGMENTS = 3, 42, 2, 8
SEGMENT_BITS = 64 // SEGMENTS
#: Segments at a chain's start that must be equal: all k with 2k / 8 below 1. Segments of each half of the next ones that may
#: differ in one bit together: 2k / 8 is below 2 for the whole chain.
EQUAL_SEGMENTS = -(-SEGMENTS // RADIUS) - 1
HALF_SEGMENTS = (SEGMENTS - 1 - EQUAL_SEGMENTS) // 2
EQUAL_BITS, HALF_BITS = EQUAL_SEGMENTS * SEGMENT_BITS, HALF_SEGMENTS * SEGMENT_BITS


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of a text: a bit is set if it is in over half of the shingles' hashes."""
    import numpy as np
    from itertools import repeat

    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    shingles = map(b" ".join, zip(*(words[i : i + n] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=n)
    columns = hashes.view(np.uint8).reshape(n, 8).astype(np.intp) + np.arange(8) * 256
    found = np.bincount(columns.ravel(), minlength=2048).reshape(8, 256)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    ones = (found @ bits).ravel()
    value = sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: Column) -> Column:
    """Fingerprints of a text column, as signed longs."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only()
        for batch in slices(batches):
            yield pa.array([simhash(t) if t else 0 for t in batch.cast(pa.binary()).to_pylist()], pa.int64())
        give_back()

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "long").asNondeterministic()(text)


def turned(value: Column, by: Column) -> Column:
    """The bits of a long, turned left on their ring."""
    return F.call_function("shiftleft", value, by).bitwiseOR(F.call_function("shiftrightunsigned", value, F.lit(64) - by))


def chain_keys(fp: Column) -> Column:
    """The keys of all chains: for each start, the equal segments and either half of the following ones."""

    def key(at: int, half: int) -> Column:
        r = turned(fp, F.lit(at * SEGMENT_BITS)) if at else fp
        first = F.shiftrightunsigned(r, 64 - EQUAL_BITS)
        second = F.shiftrightunsigned(r, 64 - EQUAL_BITS - (half + 1) * HALF_BITS).bitwiseAND(F.lit((1 << HALF_BITS) - 1))
        return F.shiftleft(first, HALF_BITS).bitwiseOR(second).bitwiseOR(F.lit((2 * at + half) << (EQUAL_BITS + HALF_BITS)))

    return F.array(*(key(at, half) for at in range(SEGMENTS) for half in (0, 1)))


def links(prints: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints ``fp``: every two within the radius are joined, directly or over a third."""
    keyed = prints.select("fp", F.explode(chain_keys(F.col("fp"))).alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    candidates = staged(keyed.join(shared, "bucket").select("fp").distinct(), "candidates")
    centres = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63))) for i in range(64)))
    members = candidates.select("fp", F.explode(centres).alias("centre")).groupBy("centre").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return members.select("u", F.explode("all").alias("v")).where("u != v")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of ``docs``."""
    prints = staged(docs.select(docs[doc_id].alias("doc_id"), fingerprint(docs[text]).alias("fp")), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = roots(links(distinct.select("fp")))
    member = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = member.join(smallest, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return prints.join(classes, prints.fp == classes.class_fp, "left").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component one row stays: that with the smallest id; among equal ids and without ids, the first as read. The texts
    are shuffled once; if ids repeat or are missing, they are numbered in a staged table before."""
    columns = docs.columns
    found = staged(components(docs, doc_id, text), "components")
    if found.where("doc_id is null").isEmpty() and found.groupBy("doc_id").count().where("count > 1").isEmpty():
        keep = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__ts_keep"))
        # a shuffle at every size: a broadcast would end where the kept ids outgrow it
        return docs.join(keep.hint("shuffle_merge"), docs[doc_id] == keep["__ts_keep"], "left_semi")
    rows = staged(docs.withColumn("__ts_row", F.monotonically_increasing_id()), "rows")
    found = components(rows, "__ts_row", text).select(F.col("doc_id").alias("__ts_of"), "component_id")
    ids = rows.select("__ts_row", F.col(doc_id).alias("__ts_id")).join(found, F.col("__ts_row") == F.col("__ts_of"))
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("__ts_id").isNull().alias("none"), "__ts_id", "__ts_row")).alias("b"))
    keep = first.select(F.col("b.__ts_row").alias("__ts_keep"))
    return rows.join(keep.hint("shuffle_merge"), rows["__ts_row"] == keep["__ts_keep"], "left_semi").select(*columns)
