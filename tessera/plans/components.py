"""Connected components by alternating large-star and small-star rounds, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import recorded, remove, staged


def _smallest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both)
    return both.join(least, both.u == least.w).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    moved = down.join(least, down.u == least.w).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).where("u != v").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """For links (u, v): rows (node, root), root the smallest node that is reachable; roots themselves have no row.

    Rounds go on until one changes nothing; each at least halves what is left of a path. A round's table goes when the next is written.
    """
    spark = edges.sparkSession
    with recorded() as paths:
        edges, mark = staged(edges.where("u != v").distinct(), "links"), None
        while True:
            edges = staged(_small_star(_large_star(edges)), "round")
            remove(spark, paths[:-1])
            now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
            if now == mark:
                return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            mark = now
