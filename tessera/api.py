"""The calls that an application makes: ingest, ask, list, look up, search, delete. Paths may be on any file system that Spark reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import models
from tessera.functions.text import find_positions, not_blank
from tessera.functions.urls import file_name, is_supported, suffix
from tessera.operators import answering, call_graph, catalog, chunking, embedding
from tessera.operators.vector_index import DEFAULT_K, MAX_DISTANCE
from tessera.sources import code, files, remote, store
from tessera.streaming.deltas import cancel, cancellable

#: Stored configuration of a new application.
API_DEFAULT = {"api_key": "", "base_url": "https://api.openai.com/v1"}


@dataclass
class Engine:
    """One store of resources under ``root``. ``embed`` makes vectors of texts, ``speak`` answers of prompts."""

    spark: SparkSession
    root: str
    embed: models.Embedder = models.letter_vector
    speak: Callable = models.echo
    model_name: str = "gpt-3.5-turbo"
    read_pdf: Callable | None = None
    host: dict[str, Callable] = field(default_factory=dict)

    @property
    def vectors(self) -> str:
        return f"{self.root}/vectors"

    def ingest(self, path: str, name: str, kind: str = "code", signal: str = "") -> int:
        """Read, cut, embed and store a resource; a name that is stored already is refused. The number of chunks. Kinds: ``code`` (a tree or
        a file), ``text``, ``pdf``, ``zip`` (archives of code) and ``remote`` (a repository's URL)."""
        if store.exists(self.spark, self.vectors, name):
            raise FileExistsError(name)
        if kind in ("text", "pdf"):
            found = files.text_files(self.spark, path) if kind == "text" else files.pdf_pages(self.spark, path, reader=self.read_pdf).withColumnRenamed("text", "content")
            label = [F.concat_ws("#", "source", "page_label").alias("source")] if kind == "pdf" else ["source"]
            chunks = chunking.chunked(found.select(*label, "file_name", F.col("content").alias("text")), embed=self.embed)
        else:
            found = self.repository(path) if kind == "remote" else files.zip_code_files(self.spark, path) if kind == "zip" else files.documents(self.spark, path, kind)
            chunks = chunking.code_chunks(found, code.top_level_parts)
        rows = chunks.where(not_blank(F.col("page_content"))).withColumn("vec_id", F.xxhash64("source", "chunk_no")).withColumn("embedding", self.embed(F.col("page_content")))
        cancellable(self.spark, signal or f"ingest-{name}", lambda: store.save(rows, self.vectors, name))
        return store.load(self.spark, self.vectors, name).count()

    def repository(self, url: str) -> DataFrame:
        """Rows (source, file_name, suffix, content) of the supported files of a repository, by the engine's host callables."""
        if not self.host:
            raise ValueError("no code host: Engine(host=...) takes listing, fetch, default_branch and archive")
        found = remote.repository_files(self.spark, url, **self.host)
        return found.where(is_supported(F.col("path"))).select(F.col("path").alias("source"), file_name(F.col("path")).alias("file_name"), suffix(F.col("path")).alias("suffix"), F.decode("content", "UTF-8").alias("content"))

    def download(self, url: str, folder: str) -> DataFrame:
        """Write a repository's files below a folder: rows (path, size)."""
        return files.written(remote.repository_files(self.spark, url, **self.host).select("path", "content"), folder)

    def say(self, prompts: DataFrame, speak: Callable) -> DataFrame:
        """What a model says to prompts (stream_id, prompt), piece by piece: rows (stream_id, seq, chunk)."""
        return models.deltas(prompts, speak)

    def models(self, bases: DataFrame, get: Callable, prefixes: tuple[str, ...] = ("gpt",)) -> DataFrame:
        """Models that servers list, by prefixes of their names."""
        return models.with_prefix(remote.models(bases, get), prefixes)

    def chat(self, name: str, question: str, history: list[tuple[str, str]] = (), k: int = DEFAULT_K, max_distance: float = MAX_DISTANCE) -> dict:
        """The answer and the contents it drew from."""
        past = "\n".join(f"Human: {q}\nAssistant: {a}" for q, a in history)
        asked = self.spark.createDataFrame([(0, question, past)], "query_id long, question string, history string")
        shelf = store.load(self.spark, self.vectors, name)
        row = answering.answered(asked, shelf, self.model_name, k, max_distance, self.embed, self.speak).first()
        ids = [int(x) for x in row.sources.split(",") if x]
        found = {r.vec_id: r for r in shelf.where(F.col("vec_id").isin(ids)).select("vec_id", "source", "page_content").collect()} if ids else {}
        return {"text": row.answer, "source_documents": [{"page_content": found[i].page_content, "source": found[i].source} for i in ids]}

    def resources(self, documents: DataFrame | None = None) -> DataFrame:
        """Stored resources and documents that are not stored, oldest first."""
        listed = self.spark.createDataFrame([], "dir string, file string, birthtime timestamp")
        if store._rows(self.spark, self.vectors) is not None:
            parts = self.spark.read.parquet(self.vectors).select("resource", "_metadata.file_modification_time").groupBy("resource").agg(F.min("file_modification_time").alias("birthtime"))
            listed = parts.select(F.col("resource").alias("dir"), F.explode(F.array(*map(F.lit, catalog.MARKERS))).alias("file"), "birthtime")
        return catalog.resources(documents if documents is not None else self.spark.createDataFrame([], "filename string, birthtime timestamp"), listed)

    def delete(self, name: str, cache: DataFrame | None = None) -> DataFrame | None:
        """Remove a resource, and its chat from a cache (key, value)."""
        store.delete(self.spark, self.vectors, name)
        return None if cache is None else self.clear_history(name, cache)

    def clear_history(self, name: str, cache: DataFrame) -> DataFrame:
        return cache.where(~F.col("key").eqNullSafe(F.lit(name)))

    def call_graph(self, path: str) -> dict[str, DataFrame]:
        """Definitions, calls, first-met nodes and the graph's text of a file or tree."""
        found = files.code_files(self.spark, path)
        calls = code.code_calls(found)
        return {
            "code": found, "definitions": code.code_definitions(found), "calls": calls, "code_mapping": call_graph.code_mapping(calls), "dot": call_graph.dot(calls, ["ord"], ["filepath"]),
            "places": code.node_places(found), "cross_file": code.cross_file_calls(found),
        }

    def search_calls(self, calls: DataFrame, keyword: str = "", level: int = 1) -> DataFrame:
        """One row (dot): the graph around a keyword; empty if nothing matches or the level is below one."""
        found = call_graph.search_calls(calls, keyword, level)
        return call_graph.dot(found, ["level", "path"])

    def file_content(self, path: str) -> str | None:
        row = files.one_file(self.spark, path).first()
        return row.content if row else None

    def file_tree(self, path: str) -> DataFrame:
        return files.file_tree(files.all_files(self.spark, path).select("source"), "source")

    def suffixes(self, path: str) -> DataFrame:
        return files.all_files(self.spark, path).select("source", suffix(F.col("source")).alias("suffix"))

    def find(self, texts: DataFrame, wanted: str, match_case: bool = False, text: str = "text") -> DataFrame:
        """``texts`` with the positions of each match."""
        return texts.withColumn("positions", find_positions(F.col(text), F.lit(wanted), match_case))

    def set(self, key: str, value: str) -> None:
        """Store a setting; other sessions over the same root read it."""
        changes = self.spark.createDataFrame([(key, value)], "key string, value string").withColumn("key", catalog.prefixed(F.col("key")))
        store.put_settings(self.spark, f"{self.root}/settings", changes)

    def get(self, key: str, default: str = "") -> str:
        row = store.settings(self.spark, f"{self.root}/settings").where(F.col("key") == catalog.prefixed(F.lit(key))).first()
        return row.value if row and row.value else default

    def code_chat(self, messages: DataFrame) -> DataFrame:
        """Answers to conversations (conv_id, turn, role, text) from their last messages, as alternating roles."""
        pairs = answering.role_pairs(answering.last_messages(messages))
        line = F.concat("role", F.lit(": "), F.col("text"))
        prompts = pairs.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("prompt"))
        return prompts.withColumn("answer", self.speak(F.col("prompt")))

    def cancel(self, signal: str) -> list[str]:
        return cancel(self.spark, signal)


def embed_with(function: Callable[[list[str]], list[list[float]]]) -> models.Embedder:
    """An outside embedder for Engine(embed=...)."""
    return models.Embedder(function)


__all__ = ["API_DEFAULT", "Engine", "embed_with", "embedding"]
