"""Manifests as one pretty-printed, ordered JSON file, written by all tasks and committed at once.

Every task writes its rows, in order, to a part beside the target.  The commit
joins the parts, by their first row, into a new file, one row at a time, and
only then moves it onto the target; an aborted write deletes the parts and leaves
the old manifest as it was.  With ``by``, rows go to one manifest for each value of a
column; all new files are complete before the first is moved.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "manifest"


@dataclass
class Part(WriterCommitMessage):
    """Where a task's rows are: (manifest, part, first row's key)."""

    parts: list[tuple[str, str, list]]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _key(value) -> list:
    """A value as something that sorts, nulls first."""
    return [value is not None, value if value is not None else 0]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.field, self.head = options["path"], options.get("field", ""), json.loads(options.get("head", "{}"))
        self.order, self.by, self.names = json.loads(options.get("order", "[]")), options.get("by"), names
        self.work = f"{self.path.rstrip('/')}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        store, work = _store(self.work)
        store.create_dir(work, recursive=True)
        open_: dict[str, tuple] = {}
        for row in iterator:
            own = row.asDict(recursive=True)
            name = str(own.pop(self.by)) if self.by else ""
            if name not in open_:
                part = f"{work}/{uuid.uuid4().hex}"
                open_[name] = (part, [_key(own[c]) for c in self.order], store.open_output_stream(part))
            line = json.dumps([[_key(own[c]) for c in self.order], own], ensure_ascii=False, default=str)
            open_[name][2].write(line.encode() + b"\n")
        for _, _, file in open_.values():
            file.close()
        return Part([(name, part, first) for name, (part, first, _) in open_.items()])

    def commit(self, messages: list[Part | None]) -> None:
        store, target = _store(self.path)
        work = _store(self.work)[1]
        store.create_dir(work, recursive=True)
        parts = [p for m in messages if m for p in m.parts]
        names = sorted({name for name, _, _ in parts}) if self.by else [""]
        made = []
        for k, name in enumerate(names):
            fresh = f"{work}/manifest-{k}"
            with store.open_output_stream(fresh) as out:
                for text in self._text(store, [part for own, part, _ in sorted(parts, key=lambda x: x[2]) if own == name]):
                    out.write(text.encode())
            made.append((fresh, f"{target.rstrip('/')}/{name}.json" if self.by else target))
        if self.by:
            store.create_dir(target, recursive=True)
        for fresh, final in made:
            store.move(fresh, final)
        store.delete_dir(work)

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        store, work = _store(self.work)
        if store.get_file_info(work).type != fs.FileType.NotFound:
            store.delete_dir(work)

    def _text(self, store, parts: list[str]) -> Iterator[str]:
        """The manifest, row after row; sorted parts are merged, one row of each held."""
        def rows(part: str) -> Iterator[list]:
            with store.open_input_stream(part) as file:
                rest = b""
                while chunk := file.read(1 << 20):
                    *lines, rest = (rest + chunk).split(b"\n")
                    yield from map(json.loads, lines)

        indent = "    " if self.field else "  "
        start = "[" if not self.field else "{" + "".join(f"\n  {json.dumps(k, ensure_ascii=False)}: {_pretty(v, '  ')}," for k, v in self.head.items()) + f"\n  {json.dumps(self.field)}: ["
        yield start
        first = True
        for _, own in heapq.merge(*map(rows, parts), key=lambda x: x[0]):
            yield ("\n" if first else ",\n") + indent + _pretty(own, indent)
            first = False
        close = "]" if first else f"\n{indent[2:]}]"
        yield close + ("\n}\n" if self.field else "\n")


def _pretty(value, indent: str) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2, default=str).replace("\n", "\n" + indent)


class ManifestSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> _Writer:
        if not overwrite:
            raise ValueError("a manifest is written as a whole: use mode overwrite")
        return _Writer(dict(self.options), schema.names)


def write_manifest(rows: DataFrame, path: str, order: list[str], *, field: str = "", head: dict | None = None, by: str | None = None) -> None:
    """Writes rows as one JSON array in ``order``; with ``field``, as that field of an object that begins with ``head``."""
    rows.sparkSession.dataSource.register(ManifestSink)
    options = {"order": json.dumps(order), "field": field, "head": json.dumps(head or {}, ensure_ascii=False)} | ({"by": by} if by else {})
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.write.format(FORMAT).options(**options).mode("overwrite").save(path)
