"""Trajectory text as a data source of its own, for tables and for streams.

``spark.dataSource.register(TrajectoryText)`` adds the format ``trajectory_text``: a
folder of files with a trajectory to each line, ``x,y;x,y``. Reading gives
(file, line, traj): lines are numbered from 0 within their file, an empty line is
an empty trajectory. A file is a task; names that begin with ``_`` or ``.`` are
left out, and so are the files of a stream's batch that isn't committed.

* *Stream source.* Files arrive under ascending names, whole. An offset is the
  last name that was taken, so a restarted query plans just the files between
  two offsets again, whatever has arrived since.
* *Sinks.* Tasks write under hidden names; the commit on the driver gives them
  their own. A stream's batch is marked when all its files are in place: a batch
  that comes again after a restart finds the mark and leaves no second copy, and
  what an unmarked attempt left is deleted first.

Folders are reached through Arrow's file systems (local paths, ``hdfs://``, ..);
the driver lists names, rows are read and written by the tasks.
"""

from __future__ import annotations

import io
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamArrowWriter,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

SCHEMA = "file string, line long, traj array<array<double>>"
ROWS = 4096
OF_BATCH = re.compile(r"batch-(\d+)-")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path))


def names(path: str) -> list[str]:
    """The files of a folder that stand for rows, in order."""
    system, root = opened(path)
    found = {f.base_name for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File}
    marked = lambda n: not (m := OF_BATCH.match(n)) or f"_batch-{m[1]}" in found
    return sorted(n for n in found if n[0] not in "_." and marked(n))


def parse_line(text: str) -> list[list[float]]:
    return [[float(c) for c in p.split(",")] for p in text.split(";") if p.strip()]


def lines(path: str, name: str) -> Iterator[pa.RecordBatch]:
    system, root = opened(path)
    with io.TextIOWrapper(system.open_input_stream(f"{root}/{name}"), encoding="utf-8", newline="\n") as f:
        held: list[list[list[float]]] = []
        at = 0

        def batch() -> pa.RecordBatch:
            numbers = pa.array(range(at - len(held), at), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([name] * len(held)), numbers, pa.array(held, pa.list_(pa.list_(pa.float64())))], ["file", "line", "traj"])

        for text in f:
            try:
                held.append(parse_line(text.rstrip("\r\n")))
            except ValueError as error:
                raise ValueError(f"line {at} of {name}: {error}") from None
            at += 1
            if len(held) == ROWS:
                yield batch()
                held.clear()
        if held:
            yield batch()


@dataclass
class File(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    hidden: str | None


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        return [File(n) for n in names(self.path)] or [File("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.name:
            yield from lines(self.path, partition.name)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"name": ""}

    def latestOffset(self) -> dict:
        return {"name": max(names(self.path), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [File(n) for n in names(self.path) if start["name"] < n <= end["name"]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from lines(self.path, partition.name)


def write_hidden(path: str, batches: Iterator[pa.RecordBatch]) -> Written:
    """A task's rows (their column ``traj``) under a hidden name."""
    system, root = opened(path)
    name, out = f".{uuid.uuid4().hex}", None
    for batch in batches:
        if out is None:
            system.create_dir(root, recursive=True)
            out = system.open_output_stream(f"{root}/{name}")
        column = batch.column(batch.schema.get_field_index("traj")).to_pylist()
        out.write("".join(";".join(",".join(map(repr, p)) for p in t or []) + "\n" for t in column).encode())
    if out is not None:
        out.close()
    return Written(name if out is not None else None)


def give_names(path: str, written: list[WriterCommitMessage | None], prefix: str) -> None:
    system, root = opened(path)
    for k, w in enumerate(w for w in written if w is not None and w.hidden):
        system.move(f"{root}/{w.hidden}", f"{root}/{prefix}{k:05d}.txt")


def take_back(path: str, written: list[WriterCommitMessage | None]) -> None:
    system, root = opened(path)
    for w in written:
        if w is not None and w.hidden:
            system.delete_file(f"{root}/{w.hidden}")


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return write_hidden(self.path, iterator)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite:
            system, root = opened(self.path)
            for n in names(self.path):
                system.delete_file(f"{root}/{n}")
        give_names(self.path, messages, f"part-{len(names(self.path)):05d}-")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        take_back(self.path, messages)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return write_hidden(self.path, iterator)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        prefix, mark = f"batch-{batchId:010d}-", f"{root}/_batch-{batchId:010d}"
        if system.get_file_info(mark).type == fs.FileType.File:
            take_back(self.path, messages)
            return
        for f in system.get_file_info(fs.FileSelector(root)):
            if f.base_name.startswith(prefix):
                system.delete_file(f.path)
        give_names(self.path, messages, prefix)
        system.open_output_stream(mark).close()

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        take_back(self.path, messages)


class TrajectoryText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trajectory_text"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        return StreamWriter(self.options["path"])
