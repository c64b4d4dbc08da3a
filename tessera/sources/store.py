"""Persisted vector stores: one Parquet table, partitioned by resource."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.operators.catalog import upserted


def _rows(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.parquet(store)
    except AnalysisException:  # nothing is stored yet
        return None


def exists(spark: SparkSession, store: str, resource: str) -> bool:
    rows = _rows(spark, store)
    return rows is not None and not rows.where(F.col("resource") == resource).isEmpty()


def _folder(spark: SparkSession, store: str, name: str):
    """A Hadoop path in the store and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store, name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _claim(spark: SparkSession, store: str, resource: str):
    """The path of a resource's claim; Parquet readers skip it, as its folder begins with an underscore."""
    return _folder(spark, store, "_claims/" + spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(resource))


def claimed(spark: SparkSession, store: str, resource: str) -> bool:
    """Take a resource's name, once: of all that ask at a time one gets it. On a local disk the file is made by the system's own exclusive
    creation, elsewhere by the file system's (HDFS and object stores with conditional writes; others check first)."""
    path, system = _claim(spark, store, resource)
    system.mkdirs(path.getParent())
    if system.getUri().getScheme() == "file":
        try:
            os.close(os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    return system.createNewFile(path)


def save(rows: DataFrame, store: str, resource: str) -> None:
    """Append a resource. One of that name must neither be stored nor be in the making by another saver: both raise FileExistsError. The name
    is free again when the write fails; after a driver that died in a write, delete() frees it."""
    spark = rows.sparkSession
    if not claimed(spark, store, resource):
        raise FileExistsError(resource)
    try:
        if exists(spark, store, resource):  # stored before claims were kept
            raise FileExistsError(resource)
        rows.withColumn("resource", F.lit(resource)).write.mode("append").partitionBy("resource").parquet(store)
    except BaseException:
        path, system = _claim(spark, store, resource)
        system.delete(path, False)
        raise


def load(spark: SparkSession, store: str, resource: str) -> DataFrame:
    """A resource's rows; only its partition is read."""
    return spark.read.parquet(store).where(F.col("resource") == resource).drop("resource")


def delete(spark: SparkSession, store: str, resource: str) -> None:
    """Remove a resource's partition, then free its name."""
    if _rows(spark, store) is not None:
        path, system = _folder(spark, store, "resource=" + spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(resource))
        system.delete(path, True)
        spark.catalog.refreshByPath(store)
    path, system = _claim(spark, store, resource)
    system.delete(path, False)


#: Bytes of an index up to which it may pass through the driver.
MOST_BYTES = 256_000_000


def settings(spark: SparkSession, path: str) -> DataFrame:
    """Rows (key, value) of a stored key-value table; none if nothing is stored."""
    versions = _versions(spark, path)
    return spark.read.schema("key string, value string").parquet(f"{path}/{versions[-1]}") if versions else spark.createDataFrame([], "key string, value string")


def _versions(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    done = [n for n in names if n.startswith("v") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(done, key=lambda n: int(n[1:]))


def put_settings(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """Write a new version of a key-value table with rows (key, value) in place of older ones. A version counts when it is whole; older
    ones than the last two go."""
    versions = _versions(spark, path)
    upserted(settings(spark, path), changes).coalesce(1).write.parquet(f"{path}/v{int(versions[-1][1:]) + 1 if versions else 0}")
    for old in versions[:-1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def to_bytes(rows: DataFrame, most: int = MOST_BYTES) -> bytes:
    """A small index as Arrow bytes. It passes through the driver, so its size is measured first; a larger one raises (its table is
    stored by save())."""
    import io

    import pyarrow as pa

    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))))).first()[0] or 0
    if size > most:
        raise ValueError(f"an index of {size} bytes does not pass through the driver")
    out, table = io.BytesIO(), rows.toArrow()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue()


def from_bytes(spark: SparkSession, content: bytes) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(pa.ipc.open_stream(content).read_all())
