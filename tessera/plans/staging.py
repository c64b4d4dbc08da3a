"""Written intermediate tables: they cut lineage and survive the loss of any executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.process_cache import kept

_recorders: list[list[str]] = []


def own_folder() -> str:
    """A temporary folder for local sessions that name none; it goes with the process."""
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a session whose executors are its own process has a
    temporary folder; any other raises, since its executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return kept("shared-folder", spark.sparkContext.applicationId, own_folder)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. Hadoop removes what lies there when the driver's JVM ends, remove() before."""
    folder = f"{shared_folder(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    for paths in _recorders:
        paths.append(folder)
    return f"{folder}/{label}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that are made inside the block, in order."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [x for x in _recorders if x is not paths]


def remove(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete folders of written tables that nothing will read again."""
    for folder in folders:
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
