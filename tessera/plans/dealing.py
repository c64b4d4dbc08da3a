"""Rows dealt into tasks of bounded size, for work that costs far more than reading its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, key: str, size: int = 4_096) -> DataFrame:
    """``rows`` in partitions of about ``size`` rows by a key that spreads them. Scans deal by bytes of files, at best by row groups: millions of
    short rows may be one task. The rows are counted (of a Parquet table: from its footers) and shuffled: make them wide afterwards."""
    return rows.repartition(max(1, -(-rows.count() // size)), key)
