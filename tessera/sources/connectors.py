"""Data sources in Python: a tree with a partition a folder, files that appear whole, a stream of model output, a relay that commits."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage

TREE = "folder string, name string, size bigint, content binary"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def hidden(name: str) -> bool:
    return name.startswith((".", "_"))


@dataclass
class Folder(InputPartition):
    folder: str


class TreeReader(DataSourceReader):
    """Lists folders while a query is planned and files in the folders' own tasks. Conditions on ``folder`` (equal, one of, begins with)
    decide which folders are listed at all, an ending of ``name`` which files are read."""

    def __init__(self, path: str, content: bool):
        self.path, self.content = path, content
        self.wanted: set[str] | None = None
        self.prefixes: list[str] = []
        self.endings: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("folder",):
                self.wanted = {f.value} if self.wanted is None else self.wanted & {f.value}
            elif isinstance(f, In) and f.attribute == ("folder",):
                values = {v for v in f.value if v is not None}
                self.wanted = values if self.wanted is None else self.wanted & values
            elif isinstance(f, StringStartsWith) and f.attribute == ("folder",):
                self.prefixes.append(f.value)
            elif isinstance(f, StringEndsWith) and f.attribute == ("name",):
                self.endings.append(f.value)
            else:
                yield f

    def _may_hold(self, folder: str) -> bool:
        """Whether a folder or one below it can satisfy the conditions."""
        below = folder + "/" if folder else ""
        return all(below.startswith(p) or p.startswith(below) or folder.startswith(p) for p in self.prefixes) and (self.wanted is None or any(w == folder or w.startswith(below) for w in self.wanted))

    def _is_wanted(self, folder: str) -> bool:
        return all(folder.startswith(p) for p in self.prefixes) and (self.wanted is None or folder in self.wanted)

    def listed(self, system: fs.FileSystem, root: str, folder: str) -> list[fs.FileInfo]:
        return system.get_file_info(fs.FileSelector(posixpath.join(root, folder), recursive=False))

    def partitions(self) -> list[Folder]:
        system, root = opened(self.path)
        open_folders, found = [""], []
        while open_folders:
            folder = open_folders.pop()
            if self._is_wanted(folder):
                found.append(Folder(folder))
            for item in self.listed(system, root, folder):
                below = posixpath.join(folder, item.base_name)
                if item.type == fs.FileType.Directory and not hidden(item.base_name) and self._may_hold(below):
                    open_folders.append(below)
        return sorted(found, key=lambda x: x.folder)

    def read(self, partition: Folder) -> Iterator[tuple]:
        system, root = opened(self.path)
        for item in self.listed(system, root, partition.folder):
            if item.type != fs.FileType.File or hidden(item.base_name) or not all(item.base_name.endswith(e) for e in self.endings):
                continue
            content = None
            if self.content:
                with system.open_input_stream(item.path) as source:
                    content = source.read()
            yield partition.folder, item.base_name, item.size, content


class TreeSource(DataSource):
    """Rows (folder, name, size, content) of the files below option ``path``; folders are relative to it, the top one is empty. Files
    and folders whose name begins with a dot or underscore are left out. Option ``content`` false reads no file. A file is one row, so it must fit a task."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("content", "true").lower() != "false")


@dataclass
class Placed(WriterCommitMessage):
    files: int
    size: int


class FilesWriter(DataSourceWriter):
    """A task's files are written aside and take their names when all of them are whole. What a task placed is noted aside before, so that
    abort() can take it back, also from tasks whose executor was lost."""

    def __init__(self, path: str):
        self.path, self.job = path, f".pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Placed:
        system, root = opened(self.path)
        own, names, size = f"{root}/{self.job}/{uuid.uuid4().hex}", [], 0
        for row in iterator:
            name = posixpath.normpath("/" + (row.path or ""))[1:]
            if not name or ".." in (row.path or "").split("/"):
                raise ValueError(f"no path inside the folder: {row.path!r}")
            system.create_dir(posixpath.dirname(f"{own}/files/{name}"), recursive=True)
            with system.open_output_stream(f"{own}/files/{name}") as out:
                out.write(row.content or b"")
            names.append(name)
            size += len(row.content or b"")
        if names:
            with system.open_output_stream(f"{own}/names") as out:
                out.write(json.dumps(names).encode())
        for name in dict.fromkeys(names):
            system.create_dir(posixpath.dirname(f"{root}/{name}"), recursive=True)
            system.move(f"{own}/files/{name}", f"{root}/{name}")
        return Placed(len(names), size)

    def commit(self, messages: list) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        if system.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.job}")
        done = [m for m in messages if m is not None]
        with system.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "size": sum(m.size for m in done)}).encode())

    def abort(self, messages: list) -> None:
        system, root = opened(self.path)
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.NotFound:
            return
        for attempt in system.get_file_info(fs.FileSelector(f"{root}/{self.job}")):
            if system.get_file_info(f"{attempt.path}/names").type == fs.FileType.File:
                with system.open_input_stream(f"{attempt.path}/names") as source:
                    for name in json.loads(source.read()):
                        if system.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                            system.delete_file(f"{root}/{name}")
        system.delete_dir(f"{root}/{self.job}")


class WholeFiles(DataSource):
    """Writes rows (path, content) as files below option ``path``. A file has its name only when it is whole, ``_SUCCESS`` with the number
    of files and bytes only when all tasks are done; a job that fails takes its files back. Files of the same path are replaced; which
    of two rows of one path stays is not defined. Null contents are empty files; a path that leaves the folder raises."""

    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


@dataclass
class Prompts(InputPartition):
    path: str


class ModelReader(DataSourceStreamReader):
    """Offsets are names of prompt files, which must come in ascending order; a file is a partition."""

    def __init__(self, path: str, model: Callable[[str], Iterable[str]]):
        self.path, self.model = path, model

    def _names(self) -> list[str]:
        system, root = opened(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return sorted(i.path[len(root) :].lstrip("/") for i in found if i.type == fs.FileType.File and not any(hidden(p) for p in i.path[len(root) :].split("/")))

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(self._names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Prompts]:
        return [Prompts(n) for n in self._names() if start["after"] < n <= end["after"]]

    def read(self, partition: Prompts) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        system, root = opened(self.path)
        with system.open_input_file(f"{root}/{partition.path}") as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=["stream_id", "prompt"]):
                for name, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    seq, held = 0, None
                    for piece in self.model(prompt or ""):
                        if held is not None:
                            yield name, seq, held, False
                            seq += 1
                        held = piece
                    yield name, seq, held, True  # an answer without pieces has one null piece


def model_source(model: Callable[[str], Iterable[str]]) -> type[DataSource]:
    """A stream source ``model_deltas`` of rows (stream_id, seq, chunk, last): what a model says, piece by piece, to the prompts in the Parquet
    files (stream_id, prompt) below option ``path``. A batch that is repeated asks the model again, so a model that varies needs a sink
    that commits (relay). Null prompts are empty ones."""

    class ModelSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "model_deltas"

        def schema(self) -> str:
            return "stream_id string, seq bigint, chunk string, last boolean"

        def streamReader(self, schema) -> ModelReader:
            return ModelReader(self.options["path"], model)

    return ModelSource


PENDING = ".pending"  # where a relay's tasks write


@dataclass
class Part(WriterCommitMessage):
    path: str | None


class RelayWriter(DataSourceStreamWriter):
    """A task writes one file aside; commit() moves the batch's files, one a task, to a folder of the batch's number and marks it. A commit
    that breaks off fails its batch, which is computed anew after a restart. Files that a killed query left aside stay there; readers skip
    the folder."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Part:
        system, root = opened(self.path)
        row = next(iterator, None)
        if row is None:
            return Part(None)
        name = f"{PENDING}/{uuid.uuid4().hex}.json"
        system.create_dir(f"{root}/{PENDING}", recursive=True)
        with system.open_output_stream(f"{root}/{name}") as out:
            while row is not None:
                out.write((json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n").encode())
                row = next(iterator, None)
        return Part(name)

    def commit(self, messages: list, batchId: int) -> None:
        system, root = opened(self.path)
        batch, parts = f"{root}/batch={batchId:09d}", [m.path for m in messages if m is not None and m.path]
        if system.get_file_info(f"{batch}/_SUCCESS").type == fs.FileType.File:  # the batch was committed before a restart
            for part in parts:
                system.delete_file(f"{root}/{part}")
            return
        if system.get_file_info(batch).type == fs.FileType.Directory:  # a commit that broke off
            system.delete_dir(batch)
        system.create_dir(batch, recursive=True)
        for part in parts:
            system.move(f"{root}/{part}", f"{batch}/{posixpath.basename(part)}")
        with system.open_output_stream(f"{batch}/_SUCCESS"):
            pass

    def abort(self, messages: list, batchId: int) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m is not None and m.path and system.get_file_info(f"{root}/{m.path}").type == fs.FileType.File:
                system.delete_file(f"{root}/{m.path}")


class Relay(DataSource):
    """A stream sink of JSON lines below option ``path``, a folder a batch. A batch counts when its folder holds ``_SUCCESS``; one that is
    repeated after a restart changes nothing."""

    @classmethod
    def name(cls) -> str:
        return "relay"

    def streamWriter(self, schema, overwrite: bool) -> RelayWriter:
        return RelayWriter(self.options["path"])


def register(spark: SparkSession, model: Callable[[str], Iterable[str]] | None = None) -> None:
    """Make the sources known to a session and let conditions reach them."""
    spark.conf.set(PUSHDOWN, True)
    for source in (TreeSource, WholeFiles, Relay, *([model_source(model)] if model else [])):
        spark.dataSource.register(source)
