"""Length-prefixed integer files: int32 length, then so many int32 values, little-endian, to the end of the file.

A Python data source, `spark.read.format("corpus_bin").load(path)`: (file, ordinal, tokens). A record's place is known only
from those before it, so a bare file is one partition of the read. Files that are written here, one for each task, have a hidden companion
(".name.marks") with the place of every MARK-th record, and are read in partitions of about SPLIT bytes. Files and folders whose names begin
with "." or "_" are skipped. Paths may be URIs of shared storage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from spanloom.sources.files import exists, list_files, resolve

SCHEMA = "file string, ordinal long, tokens array<int>"
MARK = 256
SPLIT = 64 << 20
_CHUNK = 1 << 24


def read_records(path: str, begin: int = 0, end: int | None = None) -> Iterator[np.ndarray]:
    """Arrays of a file, or of the bytes begin to end - 1, read in chunks; a record that the end cuts off is an error."""
    system, at_path = resolve(path)
    with system.open_input_file(at_path) as f:
        left = (f.size() if end is None else end) - begin
        f.seek(begin)
        rest = b""
        while left > 0:
            data = f.read(min(_CHUNK, left))
            left -= len(data)
            rest += data
            at = 0
            while len(rest) - at >= 4:
                n = int.from_bytes(rest[at : at + 4], "little", signed=True)
                if n < 0:
                    raise ValueError(f"{path}: a record of length {n}")
                if len(rest) - at < 4 + 4 * n:
                    break
                yield np.frombuffer(rest, "<i4", n, at + 4)
                at += 4 + 4 * n
            rest = rest[at:]
        if rest:
            raise ValueError(f"{path}: the last record is cut off")


def record(tokens) -> bytes:
    a = np.asarray(tokens, "<i4")
    return len(a).to_bytes(4, "little") + a.tobytes()


def _marks(path: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/.{name}.marks"


@dataclass
class _Part(InputPartition):
    path: str
    ordinal: int
    begin: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, size in list_files(self.path):
            begin = ordinal = 0
            if size > self.split and exists(_marks(path)):
                system, at = resolve(_marks(path))
                with system.open_input_file(at) as f:
                    marks = np.frombuffer(f.read(), "<i8")
                for k, place in enumerate(marks.tolist()):
                    if place - begin >= self.split:
                        out.append(_Part(path, ordinal, begin, place))
                        begin, ordinal = place, k * MARK
            out.append(_Part(path, ordinal, begin, size))
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        for i, tokens in enumerate(read_records(partition.path, partition.begin, partition.end)):
            yield partition.path, partition.ordinal + i, tokens.tolist()


@dataclass
class _Done(WriterCommitMessage):
    temporary: str | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, column: int):
        self.path, self.overwrite, self.column = path.rstrip("/"), overwrite, column

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, folder = resolve(self.path)
        system.create_dir(folder, recursive=True)
        name = f"{folder}/_{uuid.uuid4().hex}.bin"
        marks, n = [], 0
        with system.open_output_stream(name) as f:
            for row in rows:
                if row[self.column] is not None:
                    if n % MARK == 0:
                        marks.append(f.tell())
                    f.write(record(row[self.column]))
                    n += 1
        if not n:
            system.delete_file(name)
            return _Done(None)
        with system.open_output_stream(f"{name}.marks") as f:
            f.write(np.array(marks, "<i8").tobytes())
        return _Done(name)

    def commit(self, messages: list) -> None:
        system, folder = resolve(self.path)
        old = [p for p, _ in list_files(self.path)] if self.overwrite and exists(self.path) else []
        for i, m in enumerate(m for m in messages if m and m.temporary):
            final = f"{folder}/part-{i:05d}-{m.temporary.rpartition('/')[2][1:]}"
            system.move(f"{m.temporary}.marks", _marks(final))
            system.move(m.temporary, final)
        for p in old:
            system.delete_file(p)
            if exists(_marks(p)):
                system.delete_file(_marks(p))

    def abort(self, messages: list) -> None:
        system, _ = resolve(self.path)
        for m in messages:
            for p in (m.temporary, f"{m.temporary}.marks") if m and m.temporary else ():
                if exists(p):
                    system.delete_file(p)


class CorpusBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_bin"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite, schema.fieldNames().index("tokens"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CorpusBin)
