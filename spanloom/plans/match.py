"""The search document by document: all windows of a document are in one task anyway, so nothing but results leaves it.

A task holds the lists of the queries (k numbers for each query) and, of a batch of documents, the windows of those lists. It counts the lists in which a
document and a query meet, and sweeps the windows of those pairs alone that meet in enough of them. No window is joined with a query before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from spanloom.functions.hashing import family
from spanloom.operators.sweep import covers, rectangles
from spanloom.operators.windows import read_docs
from spanloom.sources.files import list_files, resolve

#: Numbers of lists of queries that fit a task. More queries are searched by joins (plans.search.exhaustive).
MOST_LISTS = 1 << 20
#: Windows of pairs that are swept at once, and pairs that are counted in a table.
SWEPT = 1 << 18
_TABLE = 1 << 23


@dataclass(frozen=True)
class Queries:
    """ids of queries; for each function the sorted tokens of lists and the number of its first list; for each list its queries, by their
    places in ids, and whether the list is one that the query reads first."""

    ids: np.ndarray
    tokens: dict[int, np.ndarray]
    first: dict[int, int]
    begins: np.ndarray
    of: np.ndarray
    prefix: np.ndarray

    @classmethod
    def collect(cls, lists: DataFrame, prefix: int | None = None) -> Queries:
        """Of lists (query_id, h, token [, place]); prefix: the greatest place that is read first, or all."""
        columns = ["query_id", "h", "token", *(["place"] if prefix is not None else [])]
        table = lists.select(*columns).where("query_id is not null and token is not null").toArrow().combine_chunks()
        q, h, token, *place = (np.asarray(table[c]).astype(np.int64) for c in columns)
        ids, own = np.unique(q, return_inverse=True)
        order = np.lexsort((own, token, h))
        h, token, own = h[order], token[order], own[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (token[1:] != token[:-1])])[: len(h)]
        begins = np.append(np.flatnonzero(new), len(h))
        at, tokens, first = h[new], token[new], {}
        for x in np.unique(at).tolist():
            first[x] = int(np.searchsorted(at, x))
        return cls(ids, {x: tokens[at == x] for x in first}, first, begins, own, place[0][order] <= prefix if place else np.ones(len(h), bool))


Windows = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # list, document, l, c, r


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)


def pairs(q: Queries, windows: Windows, n_docs: int, least: int, prefix: bool = False) -> tuple[np.ndarray, np.ndarray, Callable[[], Iterator[tuple]]]:
    """Pairs document * len(q.ids) + query that meet in at least `least` lists, or lists read first; in how many they do; and a function for
    their windows: (pair by its number, l, c, r), whole pairs at a time."""
    lists, doc, *places = windows
    n_lists, n_q = len(q.begins) - 1, len(q.ids)
    order = np.argsort(doc * n_lists + lists, kind="stable")
    keys = (doc * n_lists + lists)[order]
    begin = np.flatnonzero(np.diff(keys, prepend=-1))  # of the windows of a document in a list
    size = np.diff(np.append(begin, len(keys)))
    hit_doc, hit_list = np.divmod(keys[begin], n_lists)
    n = np.diff(q.begins)[hit_list]
    entry = _ranges(q.begins[hit_list], n)
    hit = np.repeat(np.arange(len(n)), n)
    if prefix:
        hit, entry = hit[q.prefix[entry]], entry[q.prefix[entry]]
    pair = hit_doc[hit] * n_q + q.of[entry]
    if n_docs * n_q <= _TABLE:
        count = np.bincount(pair, minlength=n_docs * n_q)
        good = np.flatnonzero(count >= least)
        met = count[good]
    else:
        good, met = np.unique(pair, return_counts=True)
        good, met = good[met >= least], met[met >= least]

    def own() -> Iterator[tuple]:
        if not len(good):
            return
        if n_docs * n_q <= _TABLE:
            number = np.full(n_docs * n_q, -1)
            number[good] = np.arange(len(good))
            number = number[pair]
        else:
            number = np.minimum(np.searchsorted(good, pair), len(good) - 1)
            number[good[number] != pair] = -1
        some = np.flatnonzero(number >= 0)
        some = some[np.argsort(number[some], kind="stable")]
        number, sizes, begins = number[some], size[hit[some]], begin[hit[some]]
        total = np.cumsum(sizes)
        at = 0
        while at < len(some):
            # whole pairs, of about SWEPT windows
            end = int(np.searchsorted(total, (total[at - 1] if at else 0) + SWEPT))
            last = number[min(end, len(some) - 1)]
            end = len(some) if end >= len(some) else int(np.searchsorted(number, last))
            if end <= at:
                end = int(np.searchsorted(number, number[at], side="right"))
            window = order[_ranges(begins[at:end], sizes[at:end])]
            yield np.repeat(number[at:end], sizes[at:end]), *(x[window] for x in places)
            at = end

    return good, met, own


def _of_batch(batch, functions: list[tuple[int, int, int]], t: int, q: Queries) -> Windows:
    parts = []
    for h, a, b in functions:
        if h in q.tokens:
            token, *places = batch.windows(a, b, t, q.tokens[h])
            parts.append((q.first[h] + np.searchsorted(q.tokens[h], token), *places))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.zeros(0, np.int64) for _ in range(5))


#: What a search gives: columns and their types, and the rows of one batch from (queries, windows, ids of documents).
Kind = tuple[list[tuple[str, str]], Callable[[Queries, Windows, np.ndarray], Iterator[tuple]]]
_ARROW = {"long": pa.int64(), "int": pa.int32()}


def _swept(q: Queries, windows: Windows, ids: np.ndarray, least: int, sweep: Callable) -> Iterator[tuple]:
    good, _, own = pairs(q, windows, len(ids), least)
    doc, query = np.divmod(good, len(q.ids))
    for group, *places in own():
        low = group[0]
        at, *rest = sweep(group - low, *places, least)
        at = at + low
        yield q.ids[query[at]], ids[doc[at]], *rest


def best_covers(least: int) -> Kind:
    """max_cover of pairs that meet in at least `least` lists."""
    columns = [("query_id", "long"), ("doc_id", "long"), ("l", "int"), ("n_collide", "int"), ("r", "int")]
    return columns, lambda q, windows, ids: _swept(q, windows, ids, least, covers)


def all_rectangles(least: int) -> Kind:
    columns = [("query_id", "long"), ("doc_id", "long"), ("l", "int"), ("r", "int"), ("n_collide", "int"), ("area", "long")]
    return columns, lambda q, windows, ids: _swept(q, windows, ids, least, rectangles)


def best_of_prefix(least: int) -> Kind:
    """(query_id, doc_id, n_prefix): the best cover of a pair in the lists that are read first, where it's at least `least`."""

    def rows(q: Queries, windows: Windows, ids: np.ndarray) -> Iterator[tuple]:
        good, _, own = pairs(q, windows, len(ids), least, prefix=True)
        doc, query = np.divmod(good, len(q.ids))
        for group, *places in own():
            at, _, n, _ = covers(group - group[0], *places, least)
            best = np.zeros(int(group[-1] - group[0]) + 1, np.int64)
            np.maximum.at(best, at, n)
            at = np.flatnonzero(best)
            yield q.ids[query[at + group[0]]], ids[doc[at + group[0]]], best[at]

    return [("query_id", "long"), ("doc_id", "long"), ("n_prefix", "int")], rows


def in_lists(least: int) -> Kind:
    """(query_id, doc_id, n_lists): pairs that meet in at least `least` of the lists that are read first."""

    def rows(q: Queries, windows: Windows, ids: np.ndarray) -> Iterator[tuple]:
        good, met, _ = pairs(q, windows, len(ids), least, prefix=True)
        doc, query = np.divmod(good, len(q.ids))
        yield q.ids[query], ids[doc], met

    return [("query_id", "long"), ("doc_id", "long"), ("n_lists", "long")], rows


def _batches(kind: Kind, q: Queries, source: Iterable[tuple[Windows, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    columns, rows = kind
    for windows, ids in source:
        for part in rows(q, windows, ids) if len(windows[0]) else ():
            if len(part[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, _ARROW[t]) for x, (_, t) in zip(part, columns)], [n for n, _ in columns])


def schema(kind: Kind) -> str:
    return ", ".join(f"{n} {t}" for n, t in kind[0])


def search_documents(docs: DataFrame, q: Queries, k: int, t: int, kind: Kind, first_seed: int = 1) -> DataFrame:
    """Of documents (doc_id, tokens) with different ids."""
    functions, lists = family(k, first_seed), docs.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lists.value
        yield from _batches(kind, own, ((_of_batch(b, functions, t, own), b.ids) for b in read_docs(batches, t, np.zeros(0, np.int64))))

    return docs.selectExpr("cast(doc_id as long)", "cast(tokens as array<int>)").mapInArrow(run, schema(kind))


def search_segments(spark: SparkSession, path: str, q: Queries, kind: Kind) -> DataFrame:
    """Of windows stored by sources.segments.write, a segment in a task: each has all windows of its documents."""
    lists = spark.sparkContext.broadcast(q)
    by: dict[str, list[str]] = {}
    for file, _ in list_files(path):
        folder, _, name = file.rpartition("/")
        by.setdefault(name, []).append(f"{path.rstrip('/')}/{folder.rpartition('/')[2]}/{name}")

    def read(files: list[str], own: Queries) -> Iterator[tuple[Windows, np.ndarray]]:
        parts = []
        for file in files:
            h = int(file.rpartition("/")[0].rpartition("h=")[2])
            wanted = own.tokens.get(h)
            if wanted is None:
                continue
            system, at = resolve(file)
            with system.open_input_file(at) as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=["token", "doc_id", "l", "c", "r"]):
                    token, *rest = (np.asarray(c).astype(np.int64) for c in batch.columns)
                    place = np.minimum(np.searchsorted(wanted, token), len(wanted) - 1)
                    mine = np.flatnonzero(wanted[place] == token)
                    if len(mine):
                        parts.append((own.first[h] + place[mine], *(x[mine] for x in rest)))
        if not parts:
            return
        found, doc, *places = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(doc, kind="stable")
        begin = np.flatnonzero(np.diff(doc[order], prepend=np.iinfo(np.int64).min))
        at = 0
        while at < len(begin):
            # whole documents, of about SWEPT windows
            last = max(at + 1, int(np.searchsorted(begin, begin[at] + SWEPT)))
            some = order[begin[at] : begin[last] if last < len(begin) else len(order)]
            ids, number = np.unique(doc[some], return_inverse=True)
            yield (found[some], number, *(x[some] for x in places)), ids
            at = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lists.value
        for batch in batches:
            for files in batch.column(0).to_pylist():
                yield from _batches(kind, own, read(files, own))

    names = spark.createDataFrame([(x,) for x in by.values()], "files array<string>")
    return names.repartition(max(1, len(by))).mapInArrow(run, schema(kind))
