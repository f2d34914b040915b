"""Whole files as rows: a data source that writes one file for each row, and commits them together.

Stores are reached by Arrow's file systems (local, shared mounts, HDFS, S3, GCS),
from the executors that hold the rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from slotweave.sources.local import spread

FORMAT = "named_files"
#: Rows that a task reads at once, and the bytes of them at which it stops sooner.
BATCH_FILES, BATCH_BYTES = 500, 4 << 20


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or a plain path."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return fs.LocalFileSystem(), path


@dataclass
class Written(WriterCommitMessage):
    """A task attempt's folder and the files in it."""

    folder: str
    files: tuple[str, ...]


class NamedFiles(DataSource):
    """``df.write.format("named_files")`` of (file, document): each row becomes a file of that name in the folder, text or bytes.

    Option ``suffix``: with ``mode("overwrite")``, older files with that ending go
    when the new ones are in place; without it a folder that has such files is refused.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, document string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return NamedFileWriter(self.options["path"], self.options.get("suffix", ""), overwrite)


def _names_in(store: fs.FileSystem, at: str, suffix: str, missing: bool) -> list[str]:
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=missing))
    return [f.base_name for f in found if f.is_file and f.base_name.endswith(suffix) and not f.base_name.startswith((".", "_"))]


class NamedFileWriter(DataSourceWriter):
    """Attempts write to folders of their own below a staging folder; only the commit moves files to their place.

    A task that is repeated or run twice leaves nothing in the folder, since only
    the attempt whose message arrives is moved; a job that fails leaves nothing at all.
    """

    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite = path.rstrip("/"), suffix, overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        context = TaskContext.get()
        folder = f"{self.staging}/{context.taskAttemptId() if context else uuid.uuid4().hex}"
        store, at = open_store(folder)
        store.create_dir(at, recursive=True)
        files: list[str] = []
        for row in iterator:
            if not row["file"] or "/" in row["file"] or row["file"].startswith((".", "_")):
                raise ValueError(f"not a file name: {row['file']!r}")
            with store.open_output_stream(f"{at}/{row['file']}") as out:
                document = row["document"] or b""
                out.write(document.encode() if isinstance(document, str) else bytes(document))
            files.append(row["file"])
        return Written(folder, tuple(files))

    def _there(self, store: fs.FileSystem, at: str) -> set[str]:
        return set(_names_in(store, at, self.suffix, True))

    def commit(self, messages: list[Written | None]) -> None:
        store, at = open_store(self.path)
        done = [m for m in messages if m is not None]
        names = [f for m in done for f in m.files]
        before = self._there(store, at)
        twice = [f for f, n in Counter(names).items() if n > 1]
        if twice or (before and not self.overwrite):
            self.abort(messages)
            raise ValueError(f"several rows for one file: {twice[0]}" if twice else f"{self.path} has files; write with mode('overwrite')")
        for m in done:
            _, held = open_store(m.folder)
            for f in m.files:
                store.move(f"{held}/{f}", f"{at}/{f}")
        for old in before - set(names):
            store.delete_file(f"{at}/{old}")
        self._clear(store)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(open_store(self.path)[0])

    def _clear(self, store: fs.FileSystem) -> None:
        _, at = open_store(self.staging)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


def write_named(files: DataFrame, path: str, suffix: str = "", overwrite: bool = True) -> None:
    """Write rows of (file, document) as files of a folder."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("file", "document").write.format(FORMAT).option("suffix", suffix).mode("overwrite" if overwrite else "append").save(path)


def read_named(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(file, document) of a folder's files: one task lists the folder, all read its files."""
    path = path.rstrip("/")

    def listed(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(_names_in(*open_store(path), suffix, False))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["file"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = open_store(path)
        for batch in batches:
            files, texts, size = [], [], 0
            for f in batch.column(0).to_pylist():
                with store.open_input_stream(f"{at}/{f}") as held:
                    texts.append(held.read().decode())
                files.append(f)
                size += len(texts[-1])
                if len(files) == BATCH_FILES or size > BATCH_BYTES:
                    yield _documents(files, texts)
                    files, texts, size = [], [], 0
            yield _documents(files, texts)

    return spread(spark.range(1).coalesce(1).mapInArrow(listed, "file string")).mapInArrow(read, "file string, document string")


def _documents(files: list[str], texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(texts, pa.string())], ["file", "document"])
