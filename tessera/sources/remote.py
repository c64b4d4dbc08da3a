"""Repositories on a code host. All requests go through injected callables, so that nothing here needs a network."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.urls import models_url, rebased, repository
from tessera.plans.staging import staged

Listing = Callable[[str], list[dict] | dict]
Fetch = Callable[[str], bytes]


def resolved(urls: DataFrame, default_branch: Callable[[str], str], url: str = "url") -> DataFrame:
    """``urls`` with ``repo`` (see repository()); where no branch is named the host is asked for its default one."""

    def ask(prefixes: pa.Array) -> pa.Array:
        return pa.array([None if p is None else default_branch(p) for p in prefixes.to_pylist()], pa.string())

    ask.__annotations__ = {"prefixes": pa.Array, "return": pa.Array}
    named = urls.withColumn("repo", repository(F.col(url)))
    asked = F.arrow_udf(ask, "string")(F.when(F.col("repo.branch").isNull(), F.regexp_replace("repo.url_prefix", "/contents/$", "")))
    branch = F.coalesce("repo.branch", asked)
    return named.withColumn("repo", F.col("repo").withField("branch", branch).withField("url_postfix", F.concat(F.lit("?ref="), branch)))


def listed(spark: SparkSession, prefix: str, postfix: str, res_path: str, listing: Listing) -> DataFrame:
    """Rows (path, download_url) of all files below a path: folders are listed level by level, each level in parallel.

    A single file's listing is an object, a folder's an array; entries without a URL are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                found = listing(f"{prefix}{path}{postfix}")
                rows += [(x["path"], x.get("type"), x.get("download_url")) for x in (found if isinstance(found, list) else [found])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["path", "type", "download_url"])

    level, out = spark.createDataFrame([(res_path,)], "path string"), None  # a tree: some level has no folders
    while True:
        entries = staged(level.mapInArrow(run, "path string, type string, download_url string"), "listing")
        files = entries.where("type != 'dir' and download_url is not null").select("path", "download_url")
        out = files if out is None else out.unionByName(files)
        level = entries.where("type = 'dir'").select("path")
        if level.isEmpty():
            return out


def fetched(files: DataFrame, fetch: Fetch, res_path: str = "", parallel: int | None = None) -> DataFrame:
    """Rows (path, content) of listed files, each with its path inside the resource; ``parallel`` bounds the requests at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, url in zip(*(batch.column(i).to_pylist() for i in range(2))):
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([fetch(url)], pa.binary())], ["path", "content"])

    rows = files.select(rebased(F.col("path"), F.lit(res_path)).alias("path"), "download_url")
    return (rows.repartition(parallel) if parallel else rows).mapInArrow(run, "path string, content binary")


def repository_files(spark: SparkSession, url: str, listing: Listing, fetch: Fetch, default_branch: Callable[[str], str], archive: Callable[[str], bytes] | None = None) -> DataFrame:
    """Rows (path, content) of a repository URL: without a path inside the repository its archive, else the folder or file."""
    from tessera.sources.files import zip_entries

    repo = resolved(spark.createDataFrame([(url,)], "url string"), default_branch).first().repo
    if not repo.res_path and archive:
        content = archive(f"{repo.author}/{repo.repository}@{repo.branch}")
        return zip_entries(spark.createDataFrame([(url, bytearray(content))], "path string, content binary"), repo.root_name).select(F.col("entry_path").alias("path"), "content")
    return fetched(listed(spark, repo.url_prefix, repo.url_postfix, repo.res_path, listing), fetch, repo.res_path)


def models(bases: DataFrame, get: Callable[[str], tuple[int, dict]], base: str = "base_url") -> DataFrame:
    """Rows (base_url, id) of each server's models; a status of 400 or more raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for b, url in zip(*(batch.column(i).to_pylist() for i in range(2))):
                status, body = get(url)
                if status >= 400:
                    raise ConnectionError(f"status {status}")
                rows += [(b, m["id"]) for m in body.get("data", [])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(2)], ["base_url", "id"])

    return bases.select(base, models_url(F.col(base))).mapInArrow(run, "base_url string, id string")
