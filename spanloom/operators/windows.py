"""Compact windows of token sequences.

For a center c with hash v[c]: l is the place after the last p < c with v[p] <= v[c], r the place before the first p > c with
v[p] < v[c] (so of equal hashes the leftmost is the least), and the window is kept if r - l > t. Stopwords never are centers
but keep their places. Documents of a batch are handled at once in numpy. A center is the least of some t + 2 hashes that follow each other, and so
are the hashes that end its window, so both ends are looked for among those alone, by doubling steps over minima of spans of powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.hashing import STOP_HASH, family, linear_hash_array

SCHEMA = "h int, token int, doc_id long, l int, c int, r int"
_BATCH = 1 << 17
#: Windows of which a task holds the tokens before it sums them up.
HELD = 1 << 23
MOST_WANTED = 1_000_000


def spans(values: np.ndarray, centers: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(l, r) of centers in concatenated sequences; values has one sentinel, less than all, before, between and after them."""
    levels = [values]
    while (1 << len(levels)) <= longest:
        half, low = 1 << (len(levels) - 1), levels[-1]
        up = low.copy()
        up[:-half] = np.minimum(low[:-half], low[half:])
        levels.append(up)
    own = values[centers]
    left, right = centers.copy(), centers + 1
    for j in range(len(levels) - 1, -1, -1):
        step, low = 1 << j, levels[j]
        at = left - step
        ok = (at >= 0) & (low[np.maximum(at, 0)] > own)
        left[ok] = at[ok]
        ok = right + step <= len(values)
        ok &= low[np.minimum(right, len(values) - 1)] >= own
        right[ok] += step
    return left, right - 1


class Docs:
    """Documents of one batch one after another, with a gap before, between and after them: tokens, whether a place is inside, its document."""

    def __init__(self, ids: list[int], arrays: list[np.ndarray], stopwords: np.ndarray):
        sizes = np.array([len(a) for a in arrays], np.int64)
        self.ids = np.array(ids, np.int64)
        self.starts = np.cumsum(np.concatenate([[1], sizes[:-1] + 1]))
        n = int(sizes.sum() + len(sizes) + 1)
        self.inside = np.ones(n, bool)
        self.inside[np.append(0, self.starts + sizes)] = False
        self.tokens = np.zeros(n, np.int64)
        self.tokens[self.inside] = np.concatenate(arrays)
        self.doc = np.cumsum(~self.inside) - 1
        self.stop = np.isin(self.tokens, stopwords) & self.inside if len(stopwords) else None

    def windows(self, a: int, b: int, t: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(token, document by its number in the batch, l, c, r) of a function, in order of (document, c); wanted: sorted tokens, only their windows."""
        none = np.zeros(0, np.int64)
        if wanted is not None and not len(wanted):
            return none, none, none, none, none
        values = linear_hash_array(self.tokens, a, b)
        if self.stop is not None:
            values[self.stop] = STOP_HASH
        n = len(values)
        # distinct keys, of equal hashes that of the leftmost the least; gaps are less than all
        bits = n.bit_length()
        values[~self.inside] = -(1 << 31) - 1
        keys = (values << bits) | np.arange(n)
        low, span, width = keys, 1, t + 2
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: span - width], low[width - span :])
        at = low & ((1 << bits) - 1)
        at = at[np.flatnonzero(np.diff(at, prepend=-1))]
        mine = self.inside[at] & (values[at] != STOP_HASH)
        if wanted is not None:
            tokens = self.tokens[at]
            mine &= wanted[np.minimum(np.searchsorted(wanted, tokens), len(wanted) - 1)] == tokens
        centers = np.flatnonzero(mine)
        if not len(centers):
            return none, none, none, none, none
        gaps = np.flatnonzero(~self.inside[at])
        l, r = spans(keys[at], centers, int(np.diff(gaps).max()))  # noqa: E741
        c = at[centers]
        doc = self.doc[c]
        base = self.starts[doc]
        return self.tokens[c], doc, at[l - 1] + 1 - base, c - base, at[r + 1] - 1 - base


def read_docs(batches: Iterator[pa.RecordBatch], t: int, stopwords: np.ndarray, size: int = _BATCH) -> Iterator[Docs]:
    """Batches of (id, tokens) in larger or smaller ones of about `size` tokens; null ids and documents without a window are left out."""
    ids: list[int] = []
    arrays: list[np.ndarray] = []
    held = 0
    for batch in batches:
        column = batch.column(1)
        flat, at = np.asarray(column.flatten()), np.asarray(column.value_lengths().fill_null(0)).cumsum()
        for i, (doc, end) in enumerate(zip(batch.column(0).to_pylist(), at.tolist())):
            tokens = flat[at[i - 1] if i else 0 : end]
            if doc is None or len(tokens) < t + 2:
                continue
            ids.append(doc)
            arrays.append(tokens)
            held += len(tokens)
            if held >= size:
                yield Docs(ids, arrays, stopwords)
                ids, arrays, held = [], [], 0
    if ids:
        yield Docs(ids, arrays, stopwords)


def _generate(k: int, t: int, first_seed: int, stopwords: np.ndarray, wanted: dict[int, np.ndarray] | None):
    functions = family(k, first_seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in read_docs(batches, t, stopwords):
            for h, a, b in functions:
                token, doc, *places = docs.windows(a, b, t, None if wanted is None else wanted.get(h, np.zeros(0, np.int64)))
                if len(token):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), h, np.int32)), pa.array(token.astype(np.int32)), pa.array(docs.ids[doc]), *(pa.array(x.astype(np.int32)) for x in places)], ["h", "token", "doc_id", "l", "c", "r"])

    return run


def _of_docs(docs: DataFrame, run, schema: str, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    return docs.select(F.col(id_col).cast("long"), F.col(tokens_col).cast("array<int>")).mapInArrow(run, schema)


def list_counts(docs: DataFrame, k: int, t: int, stopwords: list[int] | None = None, first_seed: int = 1, wanted: DataFrame | None = None) -> DataFrame:
    """(h, token, n, n_docs): windows and documents of each list, of documents (doc_id, tokens) with different ids; only sums leave a task.
    wanted (h, token): of these lists alone."""
    functions, stop, lists = family(k, first_seed), np.array(sorted(stopwords or []), np.int64), None if wanted is None else wanted_lists(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = Counts(), 0
        for batch in read_docs(batches, t, stop):
            for h, a, b in functions:
                token, doc, *_ = batch.windows(a, b, t, None if lists is None else lists.get(h, np.zeros(0, np.int64)))
                held.add(h, token, doc)
                size += len(token)
            if size >= HELD:
                yield from held.sums()
                size = 0
        yield from held.sums()

    return sum_counts(_of_docs(docs, run, Counts.SCHEMA))


class Counts:
    """Windows and documents of lists, summed up within a task."""

    SCHEMA = "h int, token int, n long, n_docs long"

    def __init__(self):
        self.windows: dict[int, list[np.ndarray]] = {}
        self.documents: dict[int, list[np.ndarray]] = {}

    def add(self, h: int, token: np.ndarray, doc: np.ndarray) -> None:
        """Windows of whole documents."""
        if len(token):
            pairs = np.sort((token << 32) | doc)
            self.windows.setdefault(h, []).append((pairs >> 32).astype(np.int32))
            self.documents.setdefault(h, []).append((pairs[np.flatnonzero(np.diff(pairs, prepend=-1))] >> 32).astype(np.int32))

    def sums(self) -> Iterator[pa.RecordBatch]:
        for h, parts in self.windows.items():
            token, n = np.unique(np.concatenate(parts), return_counts=True)
            _, n_docs = np.unique(np.concatenate(self.documents[h]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(token), h, np.int32)), pa.array(token), pa.array(n.astype(np.int64)), pa.array(n_docs.astype(np.int64))], ["h", "token", "n", "n_docs"])
        self.windows, self.documents = {}, {}


def sum_counts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("h", "token").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def width_counts(docs: DataFrame, k: int, t: int) -> DataFrame:
    """(h, width, n) of the windows of documents, width r - l + 1; only sums leave a task."""
    functions, stop = family(k), np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in read_docs(batches, t, stop):
            for h, a, b in functions:
                _, _, l, _, r = batch.windows(a, b, t)  # noqa: E741
                n = np.bincount(r - l + 1)
                own = sums.get(h, np.zeros(0, np.int64))
                if len(n) > len(own):
                    n, own = own, n
                own[: len(n)] += n
                sums[h] = own
        for h, n in sums.items():
            width = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(width), h, np.int32)), pa.array(width.astype(np.int32)), pa.array(n[width].astype(np.int64))], ["h", "width", "n"])

    return _of_docs(docs, run, "h int, width int, n long").groupBy("h", "width").agg(F.sum("n").alias("n"))


def list_document_counts(docs: DataFrame, k: int, t: int, wanted: DataFrame | None = None) -> DataFrame:
    """(h, token, doc_id, n): windows of each document in each list (wanted: in these lists alone), of documents with different ids."""
    functions, stop, lists = family(k), np.zeros(0, np.int64), None if wanted is None else wanted_lists(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read_docs(batches, t, stop):
            for h, a, b in functions:
                token, doc, *_ = batch.windows(a, b, t, None if lists is None else lists.get(h, np.zeros(0, np.int64)))
                pairs, n = np.unique((token << 32) | doc, return_counts=True)
                if len(n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), h, np.int32)), pa.array((pairs >> 32).astype(np.int32)), pa.array(batch.ids[pairs & 0xFFFFFFFF]), pa.array(n.astype(np.int64))], ["h", "token", "doc_id", "n"])

    return _of_docs(docs, run, "h int, token int, doc_id long, n long")


def following_pairs(docs: DataFrame, k: int, t: int) -> DataFrame:
    """(h, token, doc_id, c, l0, r0, l, r): windows of a list and document with the one before by center, of documents with different ids."""
    functions, stop = family(k), np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in read_docs(batches, t, stop):
            for h, a, b in functions:
                token, doc, l, c, r = batch.windows(a, b, t)  # noqa: E741
                keys = token * len(batch.ids) + doc
                order = np.argsort(keys, kind="stable")
                later = np.flatnonzero(np.diff(keys[order]) == 0) + 1
                if len(later):
                    own, before = order[later], order[later - 1]
                    columns = [np.full(len(own), h), token[own], c[own], l[before], r[before], l[own], r[own]]
                    arrays = [pa.array(x.astype(np.int32)) for x in columns]
                    yield pa.RecordBatch.from_arrays([*arrays[:2], pa.array(batch.ids[doc[own]]), *arrays[2:]], ["h", "token", "doc_id", "c", "l0", "r0", "l", "r"])

    return _of_docs(docs, run, "h int, token int, doc_id long, c int, l0 int, r0 int, l int, r int")


def wanted_lists(wanted: DataFrame) -> dict[int, np.ndarray]:
    """Sorted tokens of lists (h, token) by function."""
    lists: dict[int, list[int]] = {}
    for h, token in wanted.select("h", "token").distinct().collect():
        lists.setdefault(h, []).append(token)
    return {h: np.array(sorted(x), np.int64) for h, x in lists.items()}


def compact_windows(docs: DataFrame, k: int, t: int, stopwords: list[int] | None = None, first_seed: int = 1, wanted: DataFrame | None = None, id_col: str = "doc_id", tokens_col: str = "tokens", most_wanted: int = MOST_WANTED) -> DataFrame:
    """(h, token, doc_id, l, c, r) of documents (id, tokens ARRAY<INT>).

    wanted (h, token): only windows of these lists, for searches without a stored index. Up to MOST_WANTED lists are looked up
    in the generator; more are joined to its output. Null ids and null arrays have no windows.
    """
    lists = None
    if wanted is not None:
        wanted = wanted.select("h", "token").distinct()
        if wanted.count() > most_wanted:
            every = compact_windows(docs, k, t, stopwords, first_seed, None, id_col, tokens_col)
            return every.join(wanted, ["h", "token"], "left_semi").select(*every.columns)
        lists = wanted_lists(wanted)
    run = _generate(k, t, first_seed, np.array(sorted(stopwords or []), np.int64), lists)
    return _of_docs(docs, run, SCHEMA, id_col, tokens_col)


def compact_windows_sql(placed: DataFrame, functions: DataFrame, t: int, stopwords: DataFrame | None = None) -> DataFrame:
    """The same from (doc_id, pos, token) by a self-join: quadratic in a document's length, for checks and short texts."""
    stop = placed.withColumn("stop", F.lit(False)) if stopwords is None else placed.join(stopwords.select("token").distinct().withColumn("stop", F.lit(True)), "token", "left")
    raw = F.pmod(F.col("a") * F.col("token") + F.col("b") + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    hashed = stop.crossJoin(F.broadcast(functions)).select("doc_id", "pos", "token", "h", F.when(F.coalesce("stop", F.lit(False)), F.lit(STOP_HASH)).otherwise(raw).alias("v"))
    other = hashed.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), F.col("pos").alias("p"), F.col("v").alias("w"))
    n = placed.groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = hashed.where(F.col("v") != STOP_HASH).join(other, (F.col("doc_id") == F.col("d2")) & (F.col("h") == F.col("h2")))
    ends = joined.groupBy("h", "token", "doc_id", "pos").agg(F.max(F.when((F.col("p") < F.col("pos")) & (F.col("w") <= F.col("v")), F.col("p"))).alias("before"), F.min(F.when((F.col("p") > F.col("pos")) & (F.col("w") < F.col("v")), F.col("p"))).alias("after"))
    out = ends.join(n, "doc_id").select("h", "token", "doc_id", F.coalesce(F.col("before") + 1, F.lit(0)).cast("int").alias("l"), F.col("pos").alias("c"), F.coalesce(F.col("after") - 1, F.col("n") - 1).cast("int").alias("r"))
    return out.where(F.col("l") + t < F.col("r"))


def intersects(l1, r1, l2, r2):
    """Whether two closed intervals meet."""
    return (l1 <= r2) & (l2 <= r1)


def merged(l1, r1, l2, r2):
    """The least interval over two."""
    return F.least(l1, l2), F.greatest(r1, r2)


def stopword_violations(windows: DataFrame, stopwords: DataFrame) -> int:
    """Windows of stopwords: there must be none."""
    return windows.join(stopwords.select("token").distinct(), "token", "left_semi").count()


def checked(windows: DataFrame, stopwords: DataFrame) -> DataFrame:
    if n := stopword_violations(windows, stopwords):
        raise ValueError(f"{n} windows have a stopword as center")
    return windows
