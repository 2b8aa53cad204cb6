"""Words and tokens of whole texts, in numpy over Arrow batches: the words of text.words without a row for each.

A corpus becomes sequences in two reads. The first counts words, the second looks up the HEAD_WORDS most frequent ones in each task; only the others,
some percent of all, are shuffled by word to meet the dictionary, and again by text to fill their places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text
from spanloom.session import materialise

HEAD_WORDS = 1 << 18
_MOST_N = 1 << 16
_TEXT = 1 << 24  # bytes of texts that are handled at once
_HELD = 1 << 22  # words that are counted at once
_DELIMITER = np.zeros(256, bool)
_DELIMITER[list(b"\t\n\r\x0b\f !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words of all texts, the number of words of each); null texts have none."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends -= ends[0]
    inside = ~_DELIMITER[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][np.diff(ends) > 0]
    first[begins] = inside[begins]
    at, before = np.flatnonzero(first), np.cumsum(inside)
    offsets = np.append(before[at] - 1, before[-1:] if len(before) else [0]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]]))
    return words, np.diff(np.searchsorted(at, ends))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= _TEXT:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def word_counts(*tables: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of the different words of the texts of tables."""

    def counted(held: list[pa.Array]) -> pa.RecordBatch:
        x = pc.value_counts(pa.concat_arrays(held))
        return pa.RecordBatch.from_arrays([x.field("values"), x.field("counts")], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            words, _ = split_words(batch.column(0))
            held.append(words)
            size += len(words)
            if size >= _HELD:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    parts = tables[0].select(text_col).mapInArrow(run, "word string, n long")
    for t in tables[1:]:
        parts = parts.unionAll(t.select(text_col).mapInArrow(run, "word string, n long"))
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _least_of_head(dictionary: DataFrame, most: int) -> int:
    """The least number such that at most `most` words are as frequent."""
    rows = dictionary.groupBy(F.least("n", F.lit(_MOST_N)).alias("n")).agg(F.count("*").alias("words")).collect()
    so_far, least = 0, 1 << 62
    for n, words in sorted(map(tuple, rows), reverse=True):
        so_far += words
        if so_far > most:
            break
        least = n
    return least


def sequences(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """(doc_id, tokens) of texts that have a word: tokens by the dictionary (word, token, n), which has all words. Texts of one id, null
    included, are one sequence in order of (position, token)."""
    spark = docs.sparkSession
    least = _least_of_head(dictionary, head_words)
    known = dictionary.where(F.col("n") >= least).select("word", "token").toArrow().combine_chunks()
    head = spark.sparkContext.broadcast((known["word"].cast(pa.string()).combine_chunks(), np.asarray(known["token"]).astype(np.int32)))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        own, tokens = head.value
        own, tokens = (pa.concat_arrays(own.chunks) if isinstance(own, pa.ChunkedArray) else own), np.append(tokens, np.int32(-1))
        for batch in _gathered(batches):
            words, n = split_words(batch.column(1))
            flat = tokens[pc.index_in(words, value_set=own).fill_null(-1).to_numpy()]
            missing = flat < 0
            ends = np.concatenate([[0], np.cumsum(n)])
            rare = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(missing)])[ends].astype(np.int32), words.filter(pa.array(missing)))
            whole = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(flat))
            out = pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), batch.column(0), whole, rare], ["row", "doc_id", "tokens", "rare"])
            row += len(n)
            yield out.filter(pa.array(n > 0))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            flat, rare = np.array(column.flatten()), np.asarray(batch.column(2).flatten())
            missing = flat < 0
            if np.count_nonzero(missing) != len(rare):
                raise ValueError("the dictionary lacks words of the texts")
            flat[missing] = rare
            ends = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths()))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))], ["doc_id", "tokens"])

    first = materialise(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(look_up, "row long, doc_id long, tokens array<int>, rare array<string>"), "tokens")
    rest = dictionary.where(F.col("n") < least).select("word", "token")
    rare = first.where(F.size("rare") > 0).select("row", F.posexplode("rare").alias("at", "word")).join(rest, "word")
    fills = rare.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("fills"))
    filled = first.select("row", "doc_id", "tokens").join(fills, "row", "left").select("doc_id", "tokens", F.coalesce("fills", F.array().cast("array<int>")).alias("fills"))
    out = materialise(filled.mapInArrow(fill, "doc_id long, tokens array<int>"), "sequences")
    again = [r[0] for r in first.groupBy("doc_id").agg(F.count("*").alias("m")).where("m > 1").limit(1).collect()]
    if not again:
        return out
    # ids with several texts
    many = materialise(first.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("m")).where("m > 1").select("id"), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col("id"))
    merged = text.sequences(out.join(many, same, "left_semi").select("doc_id", F.posexplode("tokens").alias("pos", "token")))
    return materialise(out.join(many, same, "left_anti").unionByName(merged), "sequences")


def by_way_of_texts(docs: DataFrame, without: int) -> DataFrame:
    """(doc_id, pos, token) of documents (doc_id, tokens) whose tokens are written as a text of integers that spaces separate, parsed, and each
    value taken as 4 bytes, the least first, and back; without one value, positions counted without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pc.binary_join(part.column(1).cast(pa.list_(pa.string())), " ")
                words = pc.split_pattern(texts, " ")
                n = np.asarray(words.value_lengths().fill_null(0)).astype(np.int64)
                parsed = words.flatten()
                parsed = np.asarray(parsed.filter(pc.not_equal(parsed, "")).cast(pa.int32()))
                values = np.frombuffer(parsed.astype("<i4").tobytes(), "<i4")
                doc = np.repeat(np.arange(len(n)), n)
                if len(values) != len(doc):  # an empty array's text has no value
                    doc = np.repeat(np.arange(len(n)), np.asarray(part.column(1).value_lengths().fill_null(0)))
                keep = values != without
                doc, values = doc[keep], values[keep]
                size = np.bincount(doc, minlength=len(n))
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(pos), pa.array(values.astype(np.int32))], ["doc_id", "pos", "token"])

    return docs.select("doc_id", "tokens").mapInArrow(run, "doc_id long, pos long, token int")
