"""Queries over the driver's tables, each beside the SQL that it is compared with."""

from __future__ import annotations


def collector():
    """Two dictionaries and a decorator that fills them: queries by name, and SQL of those that have some."""
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def add(function):
            queries[name] = function
            if sql:
                oracles[name] = sql
            return function

        return add

    return queries, oracles, query


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
