"""All queries of the engine and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.queries import conversations, graphs, ingestion, resources, retrieval, storage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for module in (retrieval, ingestion, conversations, resources, graphs, storage):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["knn_l2_threshold"](spark, sf_dir)
