"""Windows as Parquet, written where they are made: a segment has the windows of some documents of one task, in a file for each function (h=H/NAME) or,
for epochs, one file for all of them (epoch=E/NAME), sorted by (h, token, doc_id, c, l). So storing shuffles and sorts nothing but a segment, and a document's
windows are all in one segment. A scan for a list skips what it doesn't need by folder and by the minima and maxima of row groups.

Tasks write into a hidden folder; what those that succeeded wrote is moved into place at the end.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.hashing import family
from spanloom.operators.windows import Counts, Docs, read_docs, sum_counts
from spanloom.session import materialise
from spanloom.sources.files import resolve

#: Tokens of a segment, and rows of a row group.
SEGMENT = 1 << 22
GROUP = 1 << 16
_WROTE = f"{Counts.SCHEMA}, segment string"


def _sorted(parts: list[tuple[Docs, tuple]]) -> list[np.ndarray]:
    """(token, doc_id, l, c, r) of one function in order of (token, doc_id, c); parts are in order of (doc_id, c)."""
    token = np.concatenate([w[0] for _, w in parts])
    bits = max(len(token), 1).bit_length()
    order = np.sort((token << bits) | np.arange(len(token))) & ((1 << bits) - 1)
    doc = np.concatenate([d.ids[w[1]] for d, w in parts])
    return [x[order] for x in (token, doc, *(np.concatenate([w[i] for _, w in parts]) for i in (2, 3, 4)))]


def _table(columns: list[np.ndarray], h: np.ndarray | None = None) -> pa.Table:
    names, types = ["token", "doc_id", "l", "c", "r"], [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    table = pa.table([pa.array(x.astype(t.to_pandas_dtype())) for x, t in zip(columns, types)], names)
    return table if h is None else table.add_column(0, "h", pa.array(h.astype(np.int32)))


def _put(table: pa.Table, path: str) -> None:
    system, at = resolve(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    encoding = {c: "DELTA_BINARY_PACKED" for c in ("doc_id", "l", "c", "r")}
    pq.write_table(table, at, filesystem=system, row_group_size=GROUP, compression="snappy", use_dictionary=[c for c in ("h", "token") if c in table.column_names], column_encoding=encoding)


def _in_order(batches: Iterator[pa.RecordBatch], t: int, stop: np.ndarray, size: int) -> Iterator[list[Docs]]:
    """Documents of a segment, in order of id, in batches."""

    def cut(held: list[Docs]) -> list[Docs]:
        own = sorted(((int(i), d.tokens[s : s + n]) for d in held for i, s, n in zip(d.ids, d.starts, np.diff(np.append(d.starts, len(d.tokens))) - 1)), key=lambda x: x[0])
        out, ids, arrays, tokens = [], [], [], 0
        for i, a in own:
            ids.append(i)
            arrays.append(a)
            tokens += len(a)
            if tokens >= 1 << 17:
                out.append(Docs(ids, arrays, stop))
                ids, arrays, tokens = [], [], 0
        return [*out, Docs(ids, arrays, stop)] if ids else out

    held, tokens = [], 0
    for docs in read_docs(batches, t, np.zeros(0, np.int64), min(size, 1 << 17)):
        held.append(docs)
        tokens += len(docs.tokens)
        if tokens >= size:
            yield cut(held)
            held, tokens = [], 0
    if held:
        yield cut(held)


def write(docs: DataFrame, k: int, t: int, path: str, stopwords: list[int] | None = None, first_seed: int = 1, segment: int = SEGMENT) -> DataFrame:
    """Stores the windows of documents (doc_id, tokens) with different ids; (h, token, n, n_docs) of their lists. What path had is replaced."""
    spark = docs.sparkSession
    functions, stop = family(k, first_seed), np.array(sorted(stopwords or []), np.int64)
    staging = f"{path.rstrip('/')}/_{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _in_order(batches, t, stop, segment):
            name, counts = f"{uuid.uuid4().hex}.parquet", Counts()
            for h, a, b in functions:
                parts = [(d, d.windows(a, b, t)) for d in own]
                for d, w in parts:
                    counts.add(h, w[0], w[1])
                columns = _sorted(parts)
                if len(columns[0]):
                    _put(_table(columns), f"{staging}/h={h}/{name}")
            for batch in counts.sums():
                yield batch.append_column("segment", pa.nulls(batch.num_rows, pa.string()))
            yield pa.RecordBatch.from_pylist([{"segment": name}], pa.schema([("h", pa.int32()), ("token", pa.int32()), ("n", pa.int64()), ("n_docs", pa.int64()), ("segment", pa.string())]))

    wrote = materialise(docs.selectExpr("cast(doc_id as long)", "cast(tokens as array<int>)").mapInArrow(run, _WROTE), "wrote")
    names = [r[0] for r in wrote.where("segment is not null").select("segment").collect()]
    _move(path, staging, [f"h={h}/{name}" for h in range(k) for name in names], None)
    return sum_counts(wrote.where("segment is null"))


def write_epochs(docs: DataFrame, k: int, t: int, path: str, stopwords: list[int] | None = None, first_seed: int = 1) -> None:
    """Stores the windows of documents (epoch, doc_id, tokens), each epoch by itself, all in one job. An epoch that is written again replaces itself."""
    functions, stop = family(k, first_seed), np.array(sorted(stopwords or []), np.int64)
    staging = f"{path.rstrip('/')}/_{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def store(epoch: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own in _in_order(iter(held), t, stop, SEGMENT):
                each = [(h, _sorted([(d, d.windows(a, b, t)) for d in own])) for h, a, b in functions]
                name = f"epoch={epoch}/{uuid.uuid4().hex}.parquet"
                _put(_table([np.concatenate(x) for x in zip(*(w for _, w in each))], np.repeat([h for h, _ in each], [len(w[0]) for _, w in each])), f"{staging}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["segment"])

        now, held = None, []
        for batch in batches:
            epochs = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(np.diff(epochs)) + 1).tolist(), len(epochs)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and epochs[a] != now:
                        yield from store(now, held)
                        held = []
                    now = int(epochs[a])
                    held.append(batch.slice(a, b - a).select(["doc_id", "tokens"]))
        if held:
            yield from store(now, held)

    ordered = docs.where("epoch is not null").selectExpr("epoch", "cast(doc_id as long)", "cast(tokens as array<int>)").repartition("epoch").sortWithinPartitions("epoch")
    names = [r[0] for r in materialise(ordered.mapInArrow(run, "segment string"), "wrote").collect()]
    _move(path, staging, names, {x.partition("/")[0] for x in names})


def _move(path: str, staging: str, names: list[str], replaced: set[str] | None) -> None:
    """Files from the hidden folder into place. replaced: folders whose files are replaced; None: all of path."""
    system, at = resolve(path.rstrip("/"))
    hidden = resolve(staging)[1]
    system.create_dir(at, recursive=True)
    old = [i.path for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.Directory and "=" in i.base_name and (replaced is None or i.base_name in replaced)]
    for folder in old:
        system.delete_dir(folder)
    there = {i.path for i in system.get_file_info(fs.FileSelector(hidden, recursive=True, allow_not_found=True)) if i.type == fs.FileType.File}
    own = [x for x in names if f"{hidden}/{x}" in there]
    for folder in {x.rpartition("/")[0] for x in own}:
        system.create_dir(f"{at}/{folder}", recursive=True)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda x: system.move(f"{hidden}/{x}", f"{at}/{x}"), own))
    if system.get_file_info(hidden).type == fs.FileType.Directory:
        system.delete_dir(hidden)


def chosen(windows: DataFrame, lists: DataFrame, most: int = 2000) -> DataFrame:
    """Stored windows of lists (h, token): up to `most` lists as a predicate that reaches folders and row groups, more by a join."""
    own = lists.select("h", "token").distinct().limit(most + 1).collect()
    if len(own) > most:
        return windows.join(lists.select("h", "token").distinct(), ["h", "token"], "left_semi")
    by: dict[int, list[int]] = {}
    for h, token in own:
        by.setdefault(h, []).append(token)
    where = F.lit(False)
    for h, tokens in sorted(by.items()):
        where = where | ((F.col("h") == h) & F.col("token").isin(sorted(tokens)))
    return windows.where(where)
