"""Statistics over the window relation: list index, document counts, longest lists, zone maps, sortedness."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.session import materialise

ROW_BYTES = 16
#: Tokens of a block, within which the lists of a function are put in order.
BLOCK = 1 << 16


def list_index(windows: DataFrame) -> DataFrame:
    """(h, token, n, offset): windows of each list, and the bytes of the lists before it in the file of its function."""
    return with_offsets(windows.groupBy("h", "token").agg(F.count("*").alias("n")))


def with_offsets(counts: DataFrame) -> DataFrame:
    """list_index of lists and their windows (h, token, n)."""
    return _by_blocks(counts, None).select("h", "token", "n", "offset")


def full_list_index(windows: DataFrame, vocabulary: int, k: int) -> DataFrame:
    """list_index with a row for each token of the vocabulary, empty lists included."""
    return full_with_offsets(windows.groupBy("h", "token").agg(F.count("*").alias("n")), vocabulary, k)


def full_with_offsets(counts: DataFrame, vocabulary: int, k: int) -> DataFrame:
    return _by_blocks(counts, (vocabulary, k)).select("h", "token", "n", "offset")


def _by_blocks(counts: DataFrame, domain: tuple[int, int] | None) -> DataFrame:
    """(h, token, n, offset) of lists (h, token, n); domain (vocabulary, k): with a row for each token of the vocabulary in each function.

    Lists are put in order within blocks of BLOCK tokens, side by side; only sums of blocks are summed up along a function.
    """
    spark = counts.sparkSession
    counts = materialise(counts.select("h", "token", "n"), "counts")
    block = F.floor(F.col("token") / BLOCK).cast("int")
    if domain is not None:
        vocabulary, k = domain
        counts = counts.where(F.col("h").between(0, k - 1) & F.col("token").between(0, vocabulary - 1))
    before = Window.partitionBy("h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.groupBy("h", block.alias("block")).agg(F.sum("n").alias("sum"))
    if domain is not None:
        every = spark.range(k).select(F.col("id").cast("int").alias("h")).crossJoin(spark.range(-(-vocabulary // BLOCK)).select(F.col("id").cast("int").alias("block")))
        sums = every.join(sums, ["h", "block"], "left").withColumn("sum", F.coalesce("sum", F.lit(0)))
    bases = sums.select("h", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("before"))
    lists = counts.groupBy("h", block.alias("block")).agg(F.collect_list("token").alias("tokens"), F.collect_list("n").alias("ns"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                h, at, passed = (batch.column(j)[i].as_py() for j in (0, 1, 2))
                tokens, n = (np.asarray(x.values if x.is_valid else pa.array([], pa.int64())).astype(np.int64) for x in (batch.column(3)[i], batch.column(4)[i]))
                if domain is None:
                    order = np.argsort(tokens)
                    tokens, n = tokens[order], n[order]
                else:
                    own = np.zeros(min(BLOCK, domain[0] - at * BLOCK), np.int64)
                    own[tokens - at * BLOCK] = n
                    tokens, n = np.arange(at * BLOCK, at * BLOCK + len(own)), own
                offsets = (passed + np.cumsum(n) - n) * ROW_BYTES
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), h, np.int32)), pa.array(tokens.astype(np.int32)), pa.array(n), pa.array(offsets)], ["h", "token", "n", "offset"])

    return bases.join(lists, ["h", "block"], "left").select("h", "block", "before", "tokens", "ns").mapInArrow(place, "h int, token int, n long, offset long")


def doc_index(windows: DataFrame) -> DataFrame:
    """(h, token, n_docs): documents with a window in each list."""
    return windows.groupBy("h", "token").agg(F.count_distinct("doc_id").alias("n_docs"))


def list_documents(windows: DataFrame, lists: DataFrame) -> DataFrame:
    """(h, token, doc_id) of the documents in the given lists (h, token)."""
    return windows.join(lists.select("h", "token").distinct(), ["h", "token"], "left_semi").select("h", "token", "doc_id").distinct()


def scan_lists(windows: DataFrame, lists: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Windows of the given lists (h, token), of the given documents (doc_id) only if there are any."""
    out = windows.join(lists.select("h", "token").distinct(), ["h", "token"], "left_semi")
    return out if docs is None else out.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def ordered_lists(index: DataFrame) -> DataFrame:
    """index with place, the rank of each list of a function by length, then token (from 0)."""
    return index.withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("n", "token")) - 1)


def longest_lists(index: DataFrame, count: int) -> DataFrame:
    """The `count` longest lists of each function; of equally long ones those of greater tokens."""
    rank = F.row_number().over(Window.partitionBy("h").orderBy(F.desc("n"), F.desc("token")))
    return index.withColumn("rank", rank).where(F.col("rank") <= count).drop("rank")


def zone_map(windows: DataFrame, interval: int, lists: DataFrame | None = None) -> DataFrame:
    """(h, token, zone, doc_id, offset): in each list a zone begins at its first window, and at the first window of a document
    once `interval` windows have passed since the zone began. offset is in bytes within the list.

    The rule looks back to the zone before, so each list is walked in order; only window counts by document are.
    """
    own = windows if lists is None else windows.join(lists.select("h", "token").distinct(), ["h", "token"], "left_semi")
    return zones_of_counts(own.groupBy("h", "token", "doc_id").agg(F.count("*").alias("n")), interval)


def zones_of_counts(counts: DataFrame, interval: int) -> DataFrame:
    """zone_map of windows of documents in lists (h, token, doc_id, n). Lists whose zone is never full are done all at once."""

    def zones(h: np.ndarray, token: np.ndarray, doc: np.ndarray, n: np.ndarray, state: dict) -> pa.RecordBatch:
        key = np.stack([h, token])
        new = np.concatenate([[state.get("key") != (h[0], token[0])], (key[:, 1:] != key[:, :-1]).any(axis=0)])
        begin = np.flatnonzero(new)
        goes_on = not len(begin) or begin[0] > 0
        begin = np.append(0, begin) if goes_on else begin
        end = np.append(begin[1:], len(h))
        total = np.cumsum(n)
        passed = total - n  # before each row
        passed -= np.repeat(passed[begin], end - begin)
        if goes_on:
            passed[: end[0]] += state["passed"]
        full = passed[end - 1] >= interval
        if goes_on:
            full[0] = True
        at, zone = [begin[~full]], [np.zeros(np.count_nonzero(~full), np.int64)]
        last = (0, 0)
        for i in np.flatnonzero(full).tolist():
            a, own = int(begin[i]), passed[begin[i] : end[i]]
            if i == 0 and goes_on:
                number, begun = state["zone"], state["begun"]
                k = int(np.searchsorted(own, begun + interval))
            else:
                number, begun, k = -1, 0, 0
            found = []
            while k < len(own):
                number, begun = number + 1, int(own[k])
                found.append(k)
                k = int(np.searchsorted(own, begun + interval))
            at.append(np.array(found, np.int64) + a)
            zone.append(np.arange(number - len(found) + 1, number + 1))
            last = (number, begun)
        if not full[-1]:
            last = (0, 0)
        state.update(key=(h[-1], token[-1]), passed=int(passed[-1] + n[-1]), zone=last[0], begun=last[1])
        at, zone = np.concatenate(at), np.concatenate(zone)
        return pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(token[at]), pa.array(zone.astype(np.int32)), pa.array(doc[at]), pa.array(passed[at] * ROW_BYTES)], ["h", "token", "zone", "doc_id", "offset"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            if batch.num_rows:
                yield zones(*(np.asarray(batch.column(i)) for i in range(4)), state)

    ordered = counts.select("h", "token", "doc_id", "n").repartition("h", "token").sortWithinPartitions("h", "token", "doc_id")
    return ordered.mapInArrow(walk, "h int, token int, zone int, doc_id long, offset long")


def zone_of(zones: DataFrame, places: DataFrame) -> DataFrame:
    """places(h, token, doc_id) with the offset of the zone that may hold the document: the last that begins at or before it."""
    # one pass along each list, not every place against every zone: a zone comes before the places of its first document
    starts = zones.select("h", "token", "doc_id", F.lit(0).alias("place"), "offset")
    asked = places.select("h", "token", "doc_id").distinct().select("*", F.lit(1).alias("place"), F.lit(None).cast("long").alias("offset"))
    last = F.last("offset", ignorenulls=True).over(Window.partitionBy("h", "token").orderBy("doc_id", "place").rowsBetween(Window.unboundedPreceding, 0))
    return starts.unionByName(asked).withColumn("offset", last).where("place = 1 and offset is not null").select("h", "token", "doc_id", "offset")


def doc_offsets(windows: DataFrame, lists: DataFrame) -> DataFrame:
    """(h, token, doc_id, n, offset): in each of the lists (h, token) the windows of a document, and the bytes before them in the list."""
    counts = scan_lists(windows, lists).groupBy("h", "token", "doc_id").agg(F.count("*").alias("n"))
    before = Window.partitionBy("h", "token").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) * ROW_BYTES)


def full_doc_index(windows: DataFrame, vocabulary: int, k: int) -> DataFrame:
    """doc_index with a row for each token of the vocabulary, empty lists included."""
    return full_doc_counts(doc_index(windows), vocabulary, k)


def full_doc_counts(counts: DataFrame, vocabulary: int, k: int) -> DataFrame:
    """The same of documents of lists (h, token, n_docs)."""
    return _by_blocks(counts.select("h", "token", F.col("n_docs").alias("n")), (vocabulary, k)).select("h", "token", F.col("n").alias("n_docs"))


def in_zone_map(zones: DataFrame, lists: DataFrame) -> DataFrame:
    """lists (h, token) with zoned: whether the list has a zone map."""
    have = zones.select("h", "token").distinct().withColumn("has", F.lit(True))
    return lists.select("h", "token").distinct().join(have, ["h", "token"], "left").select("h", "token", F.col("has").isNotNull().alias("zoned"))


def order_violations(spark: SparkSession, path: str) -> DataFrame:
    """(violations, windows) of a stored table of windows: rows that come before their predecessor in the same file, after the order
    (token, doc_id, c, l) within a function that stored lists have; places of rows are those that the files themselves tell."""
    source = spark.read.schema("h int, token int, doc_id long, l int, c int, r int").parquet(path)
    rows = source.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), "h", "token", "doc_id", "c", "l")
    names = ["file", "h", "row", "token", "doc_id", "c", "l", "end_token", "end_doc_id", "end_c", "end_l", "violations", "windows"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one file and function that follow each other: the first, the last, violations within, how many."""
        for batch in batches:
            if not batch.num_rows:
                continue
            file, row, h, *keys = (np.asarray(c).astype(np.int64) for c in batch.columns)
            together = (file[1:] == file[:-1]) & (h[1:] == h[:-1]) & (row[1:] == row[:-1] + 1)
            less, same = np.zeros(len(together), bool), np.ones(len(together), bool)
            for x in keys:
                less |= same & (x[1:] < x[:-1])
                same &= x[1:] == x[:-1]
            begin = np.append(0, np.flatnonzero(~together) + 1)
            end = np.append(begin[1:], len(file)) - 1
            bad = np.cumsum(np.append(0, less & together))
            columns = [file[begin], h[begin], row[begin], *(x[begin] for x in keys), *(x[end] for x in keys), bad[end] - bad[begin], end - begin + 1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    own = rows.mapInArrow(runs, ", ".join(f"{n} long" for n in names))
    # only where runs meet is anything shuffled
    before = F.lag(F.struct("end_token", "end_doc_id", "end_c", "end_l")).over(Window.partitionBy("file", "h").orderBy("row"))
    meet = own.withColumn("previous", before).withColumn("key", F.struct(*(F.col(x).alias(f"end_{x}") for x in ("token", "doc_id", "c", "l"))))
    return meet.agg((F.coalesce(F.sum("violations"), F.lit(0)) + F.count_if(F.col("previous") > F.col("key"))).alias("violations"), F.coalesce(F.sum("windows"), F.lit(0)).alias("windows"))
