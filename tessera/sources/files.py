"""Files as DataFrames: code trees, texts, archives, PDF pages, and listings."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import not_blank
from tessera.functions.urls import SUFFIXES, file_name, is_supported, suffix
from tessera.plans.staging import staged


def plain(path: Column) -> Column:
    """A path without the scheme of a local file."""
    return F.regexp_replace(path, r"^file:/*", "/")


def _binary(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def _named(df: DataFrame) -> DataFrame:
    source = plain(F.col("path"))
    return df.select(source.alias("source"), file_name(source).alias("file_name"), suffix(source).alias("suffix"), F.decode("content", "UTF-8").alias("content"))


def code_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Rows (source, file_name, suffix, content) of a tree, or of a single file; files whose name begins with a dot are left out."""
    pattern = "*.{" + ",".join(s.lstrip(".") for s in suffixes) + "}"
    return _named(_binary(spark, path, pattern)).where(~F.col("file_name").startswith("."))


def documents(spark: SparkSession, path: str, kind: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """The reader by kind: ``code`` reads a tree; otherwise a supported file is read and anything else is empty."""
    files = code_files(spark, path, suffixes)
    return files if kind == "code" or any(path.endswith(s) for s in suffixes) else files.limit(0)


def all_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows (source, file_name, suffix, content) of every file of a tree whose name does not begin with a dot or underscore."""
    return _named(_binary(spark, path))


def one_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("content"))


def text_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Rows (source, file_name, content) of whole texts that are not blank."""
    return _named(_binary(spark, path, pattern)).drop("suffix").where(not_blank(F.col("content")))


def as_chunks(files: DataFrame) -> DataFrame:
    """Files as (page_content, metadata); missing contents are empty."""
    meta = F.create_map(*(x for c in files.columns if c != "content" for x in (F.lit(c), F.col(c).cast("string"))))
    return files.select(F.coalesce("content", F.lit("")).alias("page_content"), meta.alias("metadata"))


def zip_entries(archives: DataFrame, rename_root: str | None = None) -> DataFrame:
    """Rows (path, entry_path, content) of the files in archives (path, content), one archive at a time in a task. The entries'
    common first folder takes the name ``rename_root``. A null or empty archive has no rows; one that cannot be read has a row without an
    entry, and so has an entry that is broken without its content."""

    def row(path, name, content):
        return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([name], pa.string()), pa.array([content], pa.binary())], ["path", "entry_path", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not content:
                    continue
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    yield row(path, None, None)
                    continue
                with archive:
                    for item in archive.infolist():
                        if not item.is_dir():
                            name = item.filename
                            if rename_root and "/" in name:
                                name = f"{rename_root}/{name.split('/', 1)[1]}"
                            try:
                                found = archive.read(item)
                            except (zipfile.BadZipFile, zlib.error, RuntimeError):  # broken or encrypted
                                found = None
                            yield row(path, name, found)

    return archives.select("path", "content").mapInArrow(run, "path string, entry_path string, content binary")


def zip_files(spark: SparkSession, path: str, rename_root: str | None = None) -> DataFrame:
    return zip_entries(_binary(spark, path, "*.zip"), rename_root)


def pdf_pages(spark: SparkSession, path: str, whole: bool = False, reader: Callable[[bytes], list[tuple[str, str]]] | None = None) -> DataFrame:
    """Rows (source, file_name, page_label, text). ``whole`` joins a file's pages without a separator and leaves source and label
    out. ``reader`` gives (label, text) of each page; the default needs the pypdf package."""

    def pages(content: bytes) -> list[tuple[str, str]]:
        import pypdf

        file = pypdf.PdfReader(io.BytesIO(content))
        return [(label, page.extract_text()) for label, page in zip(file.page_labels, file.pages)]

    read = reader or pages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, name = read(content), source.rsplit("/", 1)[-1]
                rows += [(None, name, None, "".join(t for _, t in found))] if whole else [(source, name, label, t) for label, t in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(4)], ["source", "file_name", "page_label", "text"])

    return _binary(spark, path, "*.pdf").select(plain(F.col("path")), "content").mapInArrow(run, "source string, file_name string, page_label string, text string")


def zip_code_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Rows (source, file_name, suffix, content) of the supported files in archives; a source is the archive's path and the entry's."""
    source = F.concat_ws("/", plain(F.col("path")), "entry_path")
    rows = zip_files(spark, path).where("content is not null").select(source.alias("source"), file_name(source).alias("file_name"), suffix(source).alias("suffix"), F.decode("content", "UTF-8").alias("content"))
    return rows.where(is_supported(F.col("source"), suffixes) & ~F.col("file_name").startswith("."))


def written(files: DataFrame, folder: str, parallel: int | None = None) -> DataFrame:
    """Write rows (path, content) as files below a folder, on any file system that pyarrow knows; rows (path, size) of what was written.
    A path that would leave the folder raises. ``parallel`` bounds the writers at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from posixpath import dirname, normpath

        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths, sizes = batch.column(0).to_pylist(), []
            for path, content in zip(paths, batch.column(1).to_pylist()):
                name = normpath("/" + (path or ""))[1:]
                if not name or ".." in (path or "").split("/"):
                    raise ValueError(f"no path inside the folder: {path!r}")
                target.create_dir(dirname(f"{root}/{name}"), recursive=True)
                with target.open_output_stream(f"{root}/{name}") as out:
                    out.write(content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    rows = files.select("path", "content")
    return staged((rows.repartition(parallel) if parallel else rows).mapInArrow(run, "path string, size long"), "written")


def file_tree(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows (filepath, parent, filename, type, depth): every file and every folder above one, once."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    head = F.when(F.col(path).startswith("/"), "/").otherwise("")
    steps = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(F.concat("head", F.array_join(F.slice("parts", F.lit(1), i), "/")).alias("filepath"), F.when(i > 1, F.concat("head", F.array_join(F.slice("parts", F.lit(1), i - 1), "/"))).alias("parent"), F.element_at("parts", i).alias("filename"), F.when(i == F.size("parts"), "file").otherwise("dir").alias("type"), i.alias("depth")))
    spread = paths.select(parts.alias("parts"), head.alias("head")).where(F.size("parts") > 0).select(F.inline(steps))
    return spread.groupBy("filepath").agg(F.min("parent").alias("parent"), F.min("filename").alias("filename"), F.min("type").alias("type"), F.min("depth").alias("depth"))


def by_suffix(paths: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]], path: str = "path") -> DataFrame:
    """The readers' results for the files of their suffixes, one after another."""
    out = None
    for s, read in readers.items():
        part = read(paths.where(F.col(path).endswith(s)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def supported(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.where(is_supported(F.col(path)))


def chunks_from_json(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows (page_content, metadata) of JSON arrays of chunks; the reverse of to_json_chunks()."""
    kind = "array<struct<page_content:string,metadata:map<string,string>>>"
    return payloads.select(F.inline(F.from_json(payload, kind)))


def to_json_chunks(chunks: DataFrame, group: str, order: str = "chunk_no") -> DataFrame:
    """One JSON array of chunks for each group (a file's chunks), in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("page_content").alias("c"))))
    return chunks.groupBy(group).agg(F.to_json(F.transform(rows, lambda x: F.struct(x["c"].alias("page_content")))).alias("payload"))
