"""Novels as a data source of their own, ``spark.read.format("novels")`` and ``spark.readStream``.

Files are found and read through Arrow's file systems, so a path may be a local
folder or a URI.  A batch is cut into partitions of about ``bytesPerPartition``;
one file is read by one task.  The stream's offset is the set of files seen, with
their times: a file that is new or changed since is read in the next batch.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .files import decode_bytes, finished

SCHEMA = "path string, file_name string, file_size long, modified_ms long, sha256 string, raw string"
BYTES = 64 << 20


@dataclass
class Files(InputPartition):
    """Files (URI, size, time) that one task reads."""

    files: list[tuple[str, int, int]]


def _listed(path: str, recursive: bool) -> list[tuple[str, int, int]]:
    """(URI or path, size, time in ms) of the .txt files, by path."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    at = store.get_file_info(root)
    found = [at] if at.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=recursive))
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    return sorted((prefix + f.path, f.size, int(f.mtime.timestamp() * 1000)) for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(".txt"))


def _dealt(files: list[tuple[str, int, int]], most: int) -> list[Files]:
    parts: list[list[tuple[str, int, int]]] = []
    held = most
    for file in files:
        if held + file[1] > most:
            parts.append([])
            held = 0
        parts[-1].append(file)
        held += file[1]
    return [Files(p) for p in parts]


def _rows(part: Files) -> Iterator[tuple]:
    from pyarrow import fs

    for path, size, modified in part.files:
        store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with store.open_input_stream(at) as file:
            content = file.read()
        yield path, path.rsplit("/", 1)[-1], size, modified, hashlib.sha256(content).hexdigest(), decode_bytes(content)


class _Reader(DataSourceReader):
    def __init__(self, path: str, recursive: bool, most: int):
        self.path, self.recursive, self.most = path, recursive, most

    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.path, self.recursive), self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, recursive: bool, most: int):
        self.path, self.recursive, self.most = path, recursive, most

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        return {"files": json.dumps({path: [size, at] for path, size, at in _listed(self.path, self.recursive)}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        seen, now = json.loads(start["files"]), json.loads(end["files"])
        return _dealt([(path, *own) for path, own in sorted(now.items()) if seen.get(path) != own], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        pass


class NovelSource(DataSource):
    """Options: path, recursive (true), bytesPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "novels"

    def schema(self) -> str:
        return SCHEMA

    def _own(self) -> tuple[str, bool, int]:
        return self.options["path"], self.options.get("recursive", "true").lower() == "true", int(self.options.get("bytesPerPartition", BYTES))

    def reader(self, schema) -> _Reader:
        return _Reader(*self._own())

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(*self._own())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NovelSource)


def load_novels(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows of ``files.read_novels`` through the data source."""
    register(spark)
    return finished(spark.read.format("novels").options(**options).load(path))


def stream_novels(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of those rows: every batch has the files that are new or changed."""
    register(spark)
    return finished(spark.readStream.format("novels").options(**options).load(path))
