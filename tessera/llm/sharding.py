"""Shards by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source and ranked; sorted by the fraction of their source that stands before
them, every stretch of the order holds the sources in the mixture's proportions. The order is cut into shards whose row
counts differ by one at most (law ``rows``).

Ranks come from order-preserving buckets with summed counts (tessera.plans.ranking), so a source of any size is spread. Only ids,
sizes, checksums and hashes are shuffled, never texts. Null sources are a source; null texts have size 1 and no
checksum. Rows that are equal in all columns may change places; nothing else depends on partitions or attempts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.ranking import bucket_count, ranked
from tessera.plans.staging import staged

SHARDS, SEED = 16, 20240229


def interleaved(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (doc_id, source, size, text_crc32, shard, slot), one for each row of ``docs``."""
    slim = docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), (F.coalesce(F.octet_length(docs[text]), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(docs[text]).alias("text_crc32"))
    slim = staged(slim.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"), 1)), "rows")
    total = slim.count()
    n = bucket_count(total)
    order = [F.col(c).asc_nulls_first() for c in ("h", "doc_id", "text_crc32", "size")]
    inside = ranked(slim, ["source"], F.floor(F.shiftright("h", 32) * n / F.lit(float(1 << 31))), order, "rank")
    sizes = slim.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    part = inside.join(sizes, inside.source.eqNullSafe(sizes.of)).withColumn("part", (2 * F.col("rank") + 1) / (2.0 * F.col("n"))).drop("of", "n", "rank")
    placed = ranked(staged(part, "parts"), [], F.floor(F.col("part") * n), [F.col("part"), F.col("source").asc_nulls_first(), *order], "position")
    shard = F.expr(f"cast((({shards} * (position + 1)) - 1) div {max(total, 1)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {total}) div {shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("position") - first).select("doc_id", "source", "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> None:
    """Write the rows of ``docs`` to one folder a shard, in slot order. Here ids must be unique and not null."""
    placed = interleaved(docs, shards, seed, doc_id, text, source).select(F.col("doc_id").alias("__ts_id"), F.col("shard").alias("__ts_shard"), F.col("slot").alias("__ts_slot"))
    out = docs.join(placed, docs[doc_id] == placed["__ts_id"]).drop("__ts_id")
    out.repartitionByRange(4 * shards, "__ts_shard", "__ts_slot").sortWithinPartitions("__ts_shard", "__ts_slot").withColumnsRenamed({"__ts_shard": "shard_no", "__ts_slot": "shard_slot"}).write.partitionBy("shard_no").parquet(path)
