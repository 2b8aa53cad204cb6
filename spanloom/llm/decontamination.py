"""Benchmark decontamination by Wu-Manber search for many n-grams of benchmark items at once.

Texts and items are normalised alike (lower case, runs of anything but letters and digits become one space, a space at both
ends). The patterns are all windows of `ngram` words of every item; an item with fewer words is one pattern if it has
`least_words`. A table over hashed blocks of BLOCK bytes says how far the search may shift; at shift 0 the bucket of the
suffix's hash holds the patterns to compare directly. Many positions of a batch advance at once in numpy.

Patterns are built on the driver in shards of up to `shard_bytes`, each searched in its own pass; a usual benchmark is one
shard. Documents are read once per shard and never shuffled.

Defined results: null or empty texts and null ids match nothing; null items and items of too few words hold no pattern; a gram that
several items share counts for each; repeated rows of a document or an item count once; very long texts are searched whole; other columns are
ignored, whatever their names; an empty table of documents or items matches nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import pieces, trimmed, unused, utf8

NGRAM = 10
LEAST_WORDS = 5
SHARD_BYTES = 64 << 20
BLOCK = 8
_BITS = 20
_HASH = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def grams(text: str, ngram: int = NGRAM, least_words: int = LEAST_WORDS) -> list[str]:
    """The patterns of one normalised item."""
    words = text.split()
    if len(words) < least_words:
        return []
    return sorted({" " + " ".join(words[i : i + ngram]) + " " for i in range(max(1, len(words) - ngram + 1))})


class WuManber:
    """The tables, for patterns of at least BLOCK bytes (padded words always are, for least_words >= 4)."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = sorted(set(patterns))
        self.least = m = min(map(len, self.patterns))
        if m < BLOCK:
            raise ValueError(f"patterns must have {BLOCK} bytes")
        default = min(m - BLOCK + 1, 255)
        self.shift = np.full(1 << _BITS, default, np.uint8)
        heads = np.frombuffer(b"".join(p[:m] for p in self.patterns), np.uint8).reshape(-1, m)
        for q in range(BLOCK, m + 1):
            block = np.ascontiguousarray(heads[:, q - BLOCK : q]).view("<u8").ravel()
            np.minimum.at(self.shift, self._slot(block), min(m - q, 255))
        self.buckets: dict[int, list[int]] = defaultdict(list)
        for i, b in enumerate(np.ascontiguousarray(heads[:, m - BLOCK :]).view("<u8").ravel().tolist()):
            self.buckets[b].append(i)
        self.suffixes = np.array(sorted(self.buckets), np.uint64)

    @staticmethod
    def _slot(block: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (block * _HASH) >> np.uint64(64 - _BITS)

    def search(self, text: np.ndarray) -> Iterator[tuple[int, int]]:
        """(begin, pattern number) of every occurrence in these bytes."""
        m, n = self.least, len(text)
        if n < m:
            return
        raw = text.tobytes()
        blocks = np.ndarray(n - BLOCK + 1, "<u8", raw, strides=(1,))
        lane = 2048
        at = np.arange(m, n + 1, lane, dtype=np.int64)  # ends of the windows
        last = np.minimum(at + lane, n + 1)
        found = []
        while len(at):
            block = blocks[at - BLOCK]
            step = self.shift[self._slot(block)]
            zero = step == 0
            if zero.any():
                ends, suffix = at[zero], block[zero]
                known = self.suffixes[np.minimum(np.searchsorted(self.suffixes, suffix), len(self.suffixes) - 1)] == suffix
                found.append((ends[known], suffix[known]))
            at = at + np.maximum(step, 1)
            go = at < last
            at, last = at[go], last[go]
        for ends, suffix in found:
            for end, s in zip(ends.tolist(), suffix.tolist()):
                begin = end - m
                for i in self.buckets[s]:
                    if raw.startswith(self.patterns[i], begin):
                        yield begin, i


def _searcher(items: list[tuple[int, str]], ngram: int, least_words: int, shard_bytes: int) -> list[tuple[WuManber, list[list[int]]]]:
    """Shards of (tables, item ids of each pattern)."""
    if least_words < 4:
        raise ValueError(f"least_words must be at least 4, or a pattern may have fewer than {BLOCK} bytes")
    owners: dict[bytes, set[int]] = defaultdict(set)
    for item, text in items:
        for g in grams(text, ngram, least_words):
            owners[g.encode()].add(item)
    shards, now, size = [], [], 0
    for p in sorted(owners):
        if now and size + len(p) > shard_bytes:
            shards.append(now)
            now, size = [], 0
        now.append(p)
        size += len(p)
    if now:
        shards.append(now)
    return [(w := WuManber(s), [sorted(owners[p]) for p in w.patterns]) for s in shards]


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> list[tuple[int, str]]:
    rows = benchmark.select(F.col(id_col).alias("i"), normalised(F.col(text_col)).alias("t")).where("i is not null and t is not null").distinct()
    return [(r[0], r[1]) for r in rows.toLocalIterator()]


def _hits(column: pa.Array, searcher: WuManber) -> Iterator[tuple[int, int, int]]:
    """(row, pattern, begin) of every occurrence in a column of normalised texts."""
    text, offsets = utf8(column)
    for begin, pattern in searcher.search(text):
        row = int(np.searchsorted(offsets, begin, "right")) - 1
        if begin + len(searcher.patterns[pattern]) <= offsets[row + 1]:
            yield row, pattern, begin


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, least_words: int = LEAST_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Rows (doc_id, item_id, n_grams): how many different patterns of the item occur in the document."""
    texts = docs.select(F.col(id_col).cast("long").alias("i"), normalised(F.col(text_col)).alias("t")).where("i is not null and t is not null")
    out = None
    for searcher, owners in _searcher(_items(benchmark, item_col, item_text_col), ngram, least_words, shard_bytes):

        def run(batches: Iterator[pa.RecordBatch], searcher=searcher, owners=owners) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, 1024):
                ids = batch.column(0).to_pylist()
                rows = {(ids[row], item, pattern) for row, pattern, _ in _hits(batch.column(1), searcher) for item in owners[pattern]}
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*sorted(rows))], ["doc_id", "item_id", "pattern"])

        part = texts.mapInArrow(trimmed(run), "doc_id long, item_id long, pattern long")
        # within one document an item's pattern is counted once, also where rows of a document repeat
        part = part.groupBy("doc_id", "item_id").agg(F.count_distinct("pattern").alias("n_grams"))
        out = part if out is None else out.unionAll(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_grams long")
    return out.groupBy("doc_id", "item_id").agg(F.sum("n_grams").alias("n_grams"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", ngram: int = NGRAM, least_words: int = LEAST_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs without the rows whose text holds any pattern; rows are judged one by one and never shuffled. Null texts stay."""
    key = unused(docs, "normalised_text")
    for searcher, _ in _searcher(_items(benchmark, item_col, item_text_col), ngram, least_words, shard_bytes):

        def run(batches: Iterator[pa.RecordBatch], searcher=searcher) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, 1024):
                keep = np.ones(batch.num_rows, bool)
                for row, _, _ in _hits(batch.column(batch.num_columns - 1), searcher):
                    keep[row] = False
                yield batch.filter(pa.array(keep)).select(range(batch.num_columns - 1))

        docs = docs.withColumn(key, F.coalesce(normalised(F.col(text_col)), F.lit(""))).mapInArrow(trimmed(run), docs.schema)
    return docs
