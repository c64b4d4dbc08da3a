"""Ranks, running sums and neighbours over any number of rows without a window over a whole (hot) group.

Rows are dealt into order-preserving buckets: about sqrt(n) of a number that is uniform by construction, those of an expression that the
caller knows to spread the rows, or else ranges whose bounds Spark samples (these rows are written first, so that all that follows sees
the same ranges). A window looks at the rows of one bucket; what the buckets before it hold is summed up in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.staging import staged

OFFSET, BUCKET = "__ts_offset", "__ts_bucket"


def bucket_count(n: int) -> int:
    return max(1, math.isqrt(max(n, 1)))


def ranked(df: DataFrame, groups: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """``df`` with column ``name``: the row's position from 0 in its group, by (bucket, order).

    ``bucket`` must not decrease along the wanted order and must spread the rows. Null group keys are a group.
    """
    df = df.withColumn(BUCKET, bucket)
    counts = df.groupBy(*groups, BUCKET).agg(F.count(F.lit(1)).alias("__ts_n"))
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(g).alias(f"__ts_g_{g}") for g in groups), F.col(BUCKET).alias("__ts_b"), F.coalesce(F.sum("__ts_n").over(before), F.lit(0)).alias(OFFSET))
    inside = Window.partitionBy(*groups, BUCKET).orderBy(*order)
    df = df.withColumn("__ts_rn", F.row_number().over(inside))
    same = df[BUCKET].eqNullSafe(offsets["__ts_b"])
    for g in groups:
        same = same & df[g].eqNullSafe(offsets[f"__ts_g_{g}"])
    keep = [c for c in df.columns if c not in (BUCKET, "__ts_rn", name)]
    return df.join(offsets, same).select(*(df[c] for c in keep), (F.col(OFFSET) + F.col("__ts_rn") - 1).cast("long").alias(name))


def ranged(df: DataFrame, groups: list[str], order: list[str], bucket: Column | None = None) -> DataFrame:
    """``df`` with a bucket column: ``bucket``, which must not decrease along the order, or ranges of (groups, order). Rows of equal keys
    are in one bucket."""
    if bucket is not None:
        return df.withColumn(BUCKET, bucket)
    keys = [*groups, *order] or [F.lit(0)]
    return staged(df.repartitionByRange(*keys).withColumn(BUCKET, F.spark_partition_id()), "ranged")


def _same(left: DataFrame, right: DataFrame, groups: list[str]) -> Column:
    ok = left[BUCKET] == right["__ts_b"]
    for g in groups:
        ok = ok & left[g].eqNullSafe(right[f"__ts_g_{g}"])
    return ok


def running(df: DataFrame, groups: list[str], order: list[str], value: Column, name: str, bucket: Column | None = None) -> DataFrame:
    """``df`` with column ``name``: the sum of ``value`` (a long) over the rows before this one in its group, in the order of columns
    that must tell rows apart, or else rows of equal keys come in any order."""
    rows = ranged(df.withColumn("__ts_value", value), groups, order, bucket)
    sums = rows.groupBy(*(F.col(g).alias(f"__ts_g_{g}") for g in groups), F.col(BUCKET).alias("__ts_b")).agg(F.sum("__ts_value").alias("__ts_sum"))
    before = Window.partitionBy(*([f"__ts_g_{g}" for g in groups] or [F.lit(0)])).orderBy("__ts_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    offsets = sums.withColumn(OFFSET, F.coalesce(F.sum("__ts_sum").over(before), F.lit(0)))
    inside = Window.partitionBy(*groups, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__ts_inside", F.coalesce(F.sum("__ts_value").over(inside), F.lit(0)))
    return rows.join(offsets, _same(rows, offsets, groups)).select(*(rows[c] for c in df.columns if c != name), (F.col(OFFSET) + F.col("__ts_inside")).cast("long").alias(name))


def with_next(df: DataFrame, groups: list[str], order: list[str], column: str, name: str, bucket: Column | None = None) -> DataFrame:
    """``df`` with column ``name``: ``column`` of the next row of its group, null for the last."""
    rows = ranged(df, groups, order, bucket)
    inside = Window.partitionBy(*groups, BUCKET).orderBy(*order)
    first = F.min_by(F.struct(column), F.struct(*order))
    firsts = rows.groupBy(*(F.col(g).alias(f"__ts_g_{g}") for g in groups), F.col(BUCKET).alias("__ts_b")).agg(first.alias("__ts_first"))
    after = Window.partitionBy(*([f"__ts_g_{g}" for g in groups] or [F.lit(0)])).orderBy("__ts_b")  # a row a bucket
    firsts = firsts.select(*(f"__ts_g_{g}" for g in groups), "__ts_b", F.lead("__ts_first").over(after).alias("__ts_after"))
    rows = rows.withColumn("__ts_next", F.lead(F.struct(column)).over(inside))
    found = F.coalesce("__ts_next", "__ts_after")[column]
    return rows.join(firsts, _same(rows, firsts, groups)).select(*(rows[c] for c in df.columns if c != name), found.alias(name))


def percentiles(df: DataFrame, groups: list[str], value: str, share: float, name: str, bucket: Column | None = None) -> DataFrame:
    """Rows (groups, ``name``): the exact percentile of each group's values that are not null, between two neighbours in proportion.
    Equal values are one row with their number, so that no value is hot."""
    kept = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__ts_n"))
    placed = running(kept, groups, [value], F.col("__ts_n"), "__ts_place", bucket)
    sizes = kept.groupBy(*(F.col(g).alias(f"__ts_g_{g}") for g in groups)).agg((F.sum("__ts_n") - 1).alias("__ts_top"))
    same = F.lit(True)
    for g in groups:
        same = same & placed[g].eqNullSafe(sizes[f"__ts_g_{g}"])
    at = F.col("__ts_top") * F.lit(share)
    near = placed.join(sizes, same).where((F.col("__ts_place") <= F.floor(at) + 1) & (F.col("__ts_place") + F.col("__ts_n") > F.floor(at))).withColumn("__ts_at", at)
    low, high = F.min_by(value, "__ts_place"), F.max_by(value, "__ts_place")  # one row holds both places, or two hold one each
    return near.groupBy(*groups).agg((low + (high - low) * (F.max("__ts_at") - F.floor(F.max("__ts_at")))).alias(name))
