"""Bundles of documents: NAME has the int32 tokens of all its documents one after another, NAME.offsets as many byte offsets, NAME.split the
begins of the documents in both (one more than documents, counted in tokens), NAME.files their names, one on each line.

A Python data source, `spark.read.format("doc_bundle").load(path)`: (bundle, name, tokens, offsets). The split makes any range of documents
readable by itself, so a bundle is read in partitions of about `split` tokens. A task writes one bundle from (name, tokens, offsets).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from spanloom.sources.files import list_files, resolve

SCHEMA = "bundle string, name string, tokens array<int>, offsets array<int>"
SPLIT = 16 << 20
_SIDES = (".offsets", ".split", ".files")


def read_ints(path: str, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Values begin to end - 1 of a file of int32, read by range."""
    system, at = resolve(path)
    with system.open_input_file(at) as f:
        last = f.size() // 4 if end is None else end
        return np.frombuffer(f.read_at(4 * (last - begin), 4 * begin), "<i4")


def bundle_names(path: str) -> list[str]:
    """The names of a bundle's documents alone."""
    system, at = resolve(f"{path}.files")
    with system.open_input_file(at) as f:
        return f.read().decode().split("\n")[:-1]


@dataclass
class _Part(InputPartition):
    path: str
    first: int
    last: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.size = path, split

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, _ in list_files(self.path):
            if path.endswith(_SIDES):
                continue
            split = read_ints(f"{path}.split")
            first = 0
            for k in range(1, len(split)):
                if split[k] - split[first] >= self.size or k == len(split) - 1:
                    out.append(_Part(path, first, k))
                    first = k
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        p = partition
        split = read_ints(f"{p.path}.split", p.first, p.last + 1)
        tokens, offsets = (read_ints(p.path + side, int(split[0]), int(split[-1])) for side in ("", ".offsets"))
        names, at = bundle_names(p.path)[p.first : p.last], (split - split[0]).tolist()
        for name, a, b in zip(names, at, at[1:]):
            yield p.path, name, tokens[a:b].tolist(), offsets[a:b].tolist()


@dataclass
class _Done(WriterCommitMessage):
    temporary: str | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str, columns: list[int]):
        self.path, self.columns = path.rstrip("/"), columns

    def write(self, rows: Iterator) -> WriterCommitMessage:
        system, folder = resolve(self.path)
        system.create_dir(folder, recursive=True)
        name, split = f"{folder}/_{uuid.uuid4().hex}", [0]
        with system.open_output_stream(name) as body, system.open_output_stream(f"{name}.offsets") as offs, system.open_output_stream(f"{name}.files") as files:
            for row in rows:
                title, tokens, offsets = (row[c] for c in self.columns)
                if title is None or tokens is None:
                    continue
                if "\n" in title or len(offsets or []) != len(tokens):
                    raise ValueError(f"{title!r}: a name is one line, and every token has an offset")
                body.write(np.asarray(tokens, "<i4").tobytes())
                offs.write(np.asarray(offsets, "<i4").tobytes())
                files.write(title.encode() + b"\n")
                split.append(split[-1] + len(tokens))
        with system.open_output_stream(f"{name}.split") as f:
            f.write(np.array(split, "<i4").tobytes())
        return _Done(name)

    def commit(self, messages: list) -> None:
        system, folder = resolve(self.path)
        for i, m in enumerate(m for m in messages if m and m.temporary):
            final = f"{folder}/bundle-{i:05d}-{m.temporary.rpartition('/')[2][1:]}"
            for side in (*_SIDES, ""):  # the bundle itself last: without it none is seen
                system.move(m.temporary + side, final + side)

    def abort(self, messages: list) -> None:
        system, _ = resolve(self.path)
        for m in messages:
            for side in (*_SIDES, "") if m and m.temporary else ():
                try:
                    system.delete_file(m.temporary + side)
                except OSError:
                    pass


class DocBundle(DataSource):
    @classmethod
    def name(cls) -> str:
        return "doc_bundle"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        names = schema.fieldNames()
        return _Writer(self.options["path"], [names.index(c) for c in ("name", "tokens", "offsets")])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocBundle)
