"""The catalog of resources and the key-value store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import unescaped
from tessera.functions.urls import decoded

#: The files that make a stored index whole.
MARKERS = ("docstore.json", "faiss.index")
KEY_PREFIX = "@tessera/"


def resources(documents: DataFrame, outputs: DataFrame, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """Rows (filename, birthtime, embedding), oldest first: output folders (dir, file, birthtime) that hold all marker files, and
    documents (filename, birthtime) whose name no output folder has. A folder without the markers hides its document too."""
    whole = outputs.groupBy("dir").agg(F.min("birthtime").alias("birthtime"), *(F.bool_or(F.col("file") == m).alias(f"m{i}") for i, m in enumerate(markers)))
    has_all = F.lit(True)
    for i in range(len(markers)):
        has_all = has_all & F.col(f"m{i}")
    stored = whole.where(has_all).select(F.col("dir").alias("filename"), "birthtime", F.lit(True).alias("embedding"))
    plain = documents.join(outputs.select(F.col("dir").alias("filename")).distinct(), "filename", "left_anti").select("filename", "birthtime", F.lit(False).alias("embedding"))
    return stored.unionByName(plain).orderBy("birthtime", "filename")


def display_name(filename: Column) -> Column:
    return unescaped(decoded(filename))


def source_link(metadata: Column) -> Column:
    """The first that is not empty of a chunk's source and file path."""
    return F.coalesce(F.nullif(F.try_element_at(metadata, F.lit("source")), F.lit("")), F.nullif(F.try_element_at(metadata, F.lit("file_path")), F.lit("")))


def prefixed(key: Column, prefix: str = KEY_PREFIX) -> Column:
    """With the store's prefix, once."""
    return F.when(key.startswith(prefix), key).otherwise(F.concat(F.lit(prefix), key))


def upserted(store: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows (key, value) with the changes' values in place of older ones."""
    return store.join(changes, "key", "left_anti").select("key", "value").unionByName(changes.select("key", "value"))


def inserted_if_absent(store: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    return store.unionByName(rows.join(store, key, "left_anti").select(*store.columns))


def without_keys(store: DataFrame, names: DataFrame, key: str = "key") -> DataFrame:
    return store.join(names, key, "left_anti")


def without_key(cache: Column, name: Column) -> Column:
    """A map column without one key."""
    return F.map_filter(cache, lambda k, _: ~k.eqNullSafe(name))


def proxy(enabled: Column, address: Column) -> Column:
    """Enabled: the address; disabled: none; undecided: the address unless it is empty."""
    return F.when(enabled, address).when(~enabled, F.lit(None)).otherwise(F.nullif(address, F.lit("")))


def embedding_config(own_key: Column, own_url: Column, chat_key: Column, chat_url: Column) -> Column:
    """struct(api_key, base_url): the chat's settings if both of the embedding's are empty."""
    none = (F.coalesce(own_key, F.lit("")) == "") & (F.coalesce(own_url, F.lit("")) == "")
    return F.struct(F.when(none, chat_key).otherwise(own_key).alias("api_key"), F.when(none, chat_url).otherwise(own_url).alias("base_url"))


def config_complete(*values: Column) -> Column:
    ok = F.lit(True)
    for v in values:
        ok = ok & (F.coalesce(v, F.lit("")) != "")
    return ok
