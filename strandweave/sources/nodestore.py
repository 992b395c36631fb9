"""A store of node files as a data source to write to: ``df.write.format("nodestore").option("path", root).mode("append").save()``.

Rows are (path, content); each is one file below the root.  A file is written beside its place and moved there when it is
whole, so readers see the old or the new text and never half of one; a task that runs again writes the same files again,
and those that hold their text already are left alone.  When all tasks have ended, the counts that they report are
written to ``_committed.json``.  The root is a path that all executors see.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME, DONE = "nodestore", "_committed.json"


@dataclass
class Written(WriterCommitMessage):
    written: int
    unchanged: int
    size: int


class NodeStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a store is added to; files go one by one, as tombstones")
        missing = {"path", "content"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return NodeWriter(self.options["path"])


def relative(path: str | None) -> str:
    """``path`` in its plain form; refused if it leaves the root or names none of its files."""
    plain = posixpath.normpath((path or "").replace("\\", "/"))
    if plain in ("", ".") or plain.startswith(("/", "../")) or plain == ".." or not plain.endswith(".md"):
        raise ValueError(f"no file of a store: {path!r}")
    return plain


class NodeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def write(self, iterator: Iterator) -> Written:
        from pyarrow import fs

        store, root = self._place()
        done = Written(0, 0, 0)
        for row in iterator:
            if row["content"] is None:
                continue
            target, data = f"{root}/{relative(row['path'])}", row["content"].encode()
            info = store.get_file_info(target)
            if info.type == fs.FileType.File and info.size == len(data):
                with store.open_input_stream(target) as file:
                    if file.read() == data:
                        done.unchanged += 1
                        continue
            folder, name = posixpath.split(target)
            store.create_dir(folder, recursive=True)
            beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
            try:
                with store.open_output_stream(beside) as file:
                    file.write(data)
                store.move(beside, target)
            except BaseException:
                if store.get_file_info(beside).type == fs.FileType.File:
                    store.delete_file(beside)
                raise
            done.written += 1
            done.size += len(data)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._place()
        own = [m for m in messages if m is not None]
        total = {"written": sum(m.written for m in own), "unchanged": sum(m.unchanged for m in own), "bytes": sum(m.size for m in own)}
        store.create_dir(root, recursive=True)
        beside = f"{root}/.{DONE}.{uuid.uuid4().hex}"
        with store.open_output_stream(beside) as file:
            file.write(json.dumps(total).encode())
        store.move(beside, f"{root}/{DONE}")

    def abort(self, messages: list[Written | None]) -> None:
        """Files that were moved into place are whole; the next run finds them unchanged."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NodeStore)
