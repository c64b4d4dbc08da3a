"""Dense labels by bitmaps: which labels stay is a bit each, and a new label is the number of set bits before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.ranking import running
from tessera.plans.staging import staged

BITS = 32_768  # of one bitmap of the built-in aggregate
#: Bytes of bitmaps up to which they are broadcast (some 500 million labels); beyond, the rows are joined by a shuffle.
MOST_BYTES = 64_000_000


def _bucket(label: Column) -> Column:
    return F.shiftright(label.cast("long"), 15)  # 32,768 labels a bucket, also below 0


def _position(label: Column) -> Column:
    return label.cast("long").bitwiseAND(F.lit(BITS - 1))


def bitmaps(labels: DataFrame, label: str) -> DataFrame:
    """Rows (bucket, bits, before): the labels' bits in buckets of 32,768 and how many are set in earlier buckets. Only labels are
    shuffled, by bucket, so that no task holds a bitmap for each of a few scattered labels."""
    rows = labels.where(F.col(label).isNotNull()).select(_bucket(F.col(label)).alias("bucket"), _position(F.col(label)).alias("at"))
    found = staged(rows.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), "bitmaps")
    sums = running(found.select("bucket", F.bitmap_count("bits").alias("n")), [], ["bucket"], F.col("n"), "before")
    before = sums.select(F.col("bucket").alias("__ts_b"), "before")
    return found.join(before, F.col("bucket") == F.col("__ts_b")).select("bucket", "bits", "before")


def relabelled(rows: DataFrame, gone: DataFrame, label: str, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """``rows`` without the labels of ``gone`` and with dense labels from 0 on in the old order, and one row (removed) with the
    number of rows that went.

    Labels are unique; gaps and negative ones are allowed, rows without a label go and are not counted. ``gone`` may repeat labels, hold nulls and ones that no row
    has. Two passes read labels alone. While the bitmaps, whose size is counted, are at most ``most`` bytes, the rows themselves pass
    through no exchange."""
    own = rows.select(F.col(label).alias("__ts_label"))
    lost = gone.select(F.col(gone.columns[0]).alias("__ts_gone")).distinct()
    same = F.col("__ts_label") == F.col("__ts_gone")
    removed = own.join(lost, same, "left_semi").agg(F.count(F.lit(1)).alias("removed"))
    maps = bitmaps(own.join(lost, same, "left_anti"), "__ts_label").select(F.col("bucket").alias("__ts_bucket"), F.col("bits").alias("__ts_bits"), F.col("before").alias("__ts_before"))
    held = maps.select("__ts_bucket").count() * (BITS // 8 + 16)
    joined = rows.join(F.broadcast(maps) if held <= most else maps, _bucket(F.col(label)) == F.col("__ts_bucket"))
    whole, bit = F.shiftright(_position(F.col(label)), 3).cast("int"), _position(F.col(label)).bitwiseAND(F.lit(7)).cast("int")
    byte = F.conv(F.hex(F.substring("__ts_bits", whole + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.bitmap_count(F.substring("__ts_bits", F.lit(1), whole)) + F.bit_count(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit) - 1))
    stays = F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1
    new = (F.col("__ts_before") + inside).cast(rows.schema[label].dataType)
    return joined.where(stays).select(*(new.alias(c) if c == label else rows[c] for c in rows.columns)), removed
