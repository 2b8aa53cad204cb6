"""Indexes that are built once, stored, and searched as often as one likes.

A stored index is a folder: windows (segments of documents by function, sorted by token and document within a file), lists and documents (windows and documents of each
list), zones (zone maps of the `zone_lists` longest lists of each function), config (the parameters). A search reads each segment in one task, which has
all windows of its documents.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import BuildConfig, SearchConfig
from spanloom.operators import index
from spanloom.operators.windows import compact_windows
from spanloom.plans import match, search
from spanloom.session import materialise
from spanloom.sources import segments, tables


@dataclass(frozen=True)
class StoredIndex:
    """windows (h, token, doc_id, l, c, r), lists (h, token, n, offset), documents (h, token, n_docs), zones (h, token, zone, doc_id, offset)."""

    path: str
    config: BuildConfig
    windows: DataFrame
    lists: DataFrame
    documents: DataFrame
    zones: DataFrame


def build(docs: DataFrame, config: BuildConfig, path: str, stopwords: list[int] | None = None) -> StoredIndex:
    """Builds and stores the index of documents (doc_id, tokens); with a doc_limit only of those with ids below it."""
    spark = docs.sparkSession
    own = docs if config.doc_limit is None else docs.where(F.col("doc_id") < config.doc_limit)
    counts = materialise(segments.write(own, config.k, config.t, f"{path}/windows", stopwords, config.first_seed), "counts")
    index.with_offsets(counts).write.mode("overwrite").parquet(f"{path}/lists")
    counts.select("h", "token", "n_docs").write.mode("overwrite").parquet(f"{path}/documents")
    longest = index.longest_lists(spark.read.parquet(f"{path}/lists"), config.zone_lists)
    index.zone_map(segments.chosen(tables.read_windows(spark, f"{path}/windows"), longest), config.zone_interval).write.mode("overwrite").parquet(f"{path}/zones")
    # written last: a folder without it is no whole index
    spark.createDataFrame([asdict(config)], BuildConfig.SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> StoredIndex:
    config = BuildConfig(**spark.read.parquet(f"{path}/config").first().asDict())
    return StoredIndex(path, config, tables.read_windows(spark, f"{path}/windows"), *(spark.read.parquet(f"{path}/{n}") for n in ("lists", "documents", "zones")))


def search_stored(stored: StoredIndex, placed: DataFrame, config: SearchConfig, id_col: str = "item_id") -> search.Found:
    """All matches of the chunks of queries (id, pos, token): those of the sample that config names, if it does."""
    if (config.k, config.t) != (stored.config.k, stored.config.t):
        raise ValueError("a search has the k and t of its index")
    chunks = search.query_chunks(search.sampled(placed, config, id_col), config.chunk, id_col)
    signatures = search.least_tokens(chunks, config.k, first_seed=stored.config.first_seed)
    signatures = materialise(signatures, "signatures")
    if signatures.count() > match.MOST_LISTS:
        return search.exhaustive(signatures, stored.windows, config, stored.lists)
    config = config.effective()
    q = match.Queries.collect(search.ranked_lists(signatures, stored.lists), config.prefix)
    found, prefix = (match.search_segments(stored.windows.sparkSession, f"{stored.path}/windows", q, kind) for kind in (match.best_covers(config.matches), match.best_of_prefix(config.prefix_matches)))
    return search.Found(found, prefix)


def grid(docs: DataFrame, doc_limits: list[int | None], ks: list[int], ts: list[int]) -> DataFrame:
    """(doc_limit, k, t, n_windows) of every setting of an experiment: the windows of the greatest k and least t hold those of all others."""
    windows = compact_windows(docs, max(ks), min(ts))
    cells = [(d, k, t) for d in doc_limits for k in ks for t in ts]
    counts = windows.agg(*(F.count_if((F.col("h") < k) & (F.col("l") + t < F.col("r")) & (F.lit(True) if d is None else F.col("doc_id") < d)).alias(f"n{i}") for i, (d, k, t) in enumerate(cells)))
    rows = F.array(*(F.struct(F.lit(d).cast("long").alias("doc_limit"), F.lit(k).alias("k"), F.lit(t).alias("t"), F.col(f"n{i}").alias("n_windows")) for i, (d, k, t) in enumerate(cells)))
    return counts.select(F.explode(rows).alias("x")).select("x.*")
