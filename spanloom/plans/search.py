"""Search of many query sequences at once: chunks, least tokens, list order, prefix filter, sweep, both result modes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.config import SearchConfig
from spanloom.functions.hashing import family_table, linear_hash
from spanloom.operators.sweep import max_cover
from spanloom.session import materialise


def query_chunks(placed: DataFrame, length: int, id_col: str = "item_id") -> DataFrame:
    """(id, chunk, query_id, pos, token): whole chunks of `length` tokens; what is left at the end is dropped.

    query_id numbers chunks as id * 2**20 + chunk. placed must be numbered without gaps (renumber() after stopwords are deleted).
    """
    cut = placed.withColumn("chunk", F.floor(F.col("pos") / length).cast("int"))
    full = cut.groupBy(id_col, "chunk").agg(F.count("*").alias("n")).where(F.col("n") == length).drop("n")
    return cut.join(full, [id_col, "chunk"]).select(id_col, "chunk", (F.col(id_col) * (1 << 20) + F.col("chunk")).alias("query_id"), (F.col("pos") - F.col("chunk") * length).cast("int").alias("pos"), "token")


def sampled(placed: DataFrame, config: SearchConfig, id_col: str = "item_id") -> DataFrame:
    """Queries from number sample_start on, sample_count of them, of those with a whole chunk."""
    if config.sample_count is not None:
        placed = placed.where(F.col(id_col).between(config.sample_start, config.sample_start + config.sample_count - 1))
    elif config.sample_start:
        placed = placed.where(F.col(id_col) >= config.sample_start)
    long_enough = placed.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") >= config.chunk).select(id_col)
    return placed.join(long_enough, id_col, "left_semi")


def least_tokens(placed: DataFrame, k: int, id_col: str = "query_id", first_seed: int = 1) -> DataFrame:
    """(id, h, token): for each function the token of least hash, the first of several."""
    hashed = placed.crossJoin(F.broadcast(family_table(placed.sparkSession, k, first_seed)))
    best = F.min(F.struct(linear_hash(F.col("token"), F.col("a"), F.col("b")).alias("v"), "pos", "token"))
    return hashed.groupBy(id_col, "h").agg(best.alias("m")).select(id_col, "h", F.col("m.token").alias("token"))


def ranked_lists(signatures: DataFrame, index: DataFrame, count: str = "n") -> DataFrame:
    """(query_id, h, token, n, place): a query's lists from the shortest on, missing ones as of length 0; place from 1.

    index: (h, token, n [, offset]); with count="n_docs" lists are ordered by documents. Ties: offset if there is one, then h.
    """
    has_offset = "offset" in index.columns
    stats = index.select("h", "token", F.col(count).alias("m"), *(["offset"] if has_offset else []))
    joined = signatures.join(stats, ["h", "token"], "left").withColumn("n", F.coalesce("m", F.lit(0)))
    order = ["n", *([F.coalesce("offset", F.lit(0))] if has_offset else []), "h"]
    return joined.select("query_id", "h", "token", "n", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("place"))


def met(lists: DataFrame, windows: DataFrame) -> DataFrame:
    return windows.join(lists, ["h", "token"]).select("query_id", "h", "doc_id", "l", "c", "r")


def candidates(lists: DataFrame, windows: DataFrame, least: int) -> DataFrame:
    """(query_id, doc_id, n_lists): documents in at least `least` different lists of a query."""
    return met(lists, windows).groupBy("query_id", "doc_id").agg(F.count_distinct("h").alias("n_lists")).where(F.col("n_lists") >= least)


def kept(found: DataFrame, least: int) -> DataFrame:
    good = found.groupBy("query_id", "doc_id").agg(F.count_distinct("h").alias("lists")).where(F.col("lists") >= least).select("query_id", "doc_id")
    return found.join(good, ["query_id", "doc_id"], "left_semi")


@dataclass(frozen=True)
class Found:
    """matches: (query_id, doc_id, l, n_collide, r); prefix: (query_id, doc_id, n_prefix), candidates and their best cover in the prefix lists."""

    matches: DataFrame
    prefix: DataFrame


def exhaustive(signatures: DataFrame, windows: DataFrame, config: SearchConfig, index: DataFrame | None = None, count: str = "n") -> Found:
    """All matches. With prefix_ratio < 1 the shortest lists are read first, and the rest only for documents that may still match."""
    config = config.effective()
    index = windows.groupBy("h", "token").agg(F.count("*").alias("n")) if index is None else index
    ranked = materialise(ranked_lists(signatures, index, count), "lists")
    first = materialise(met(ranked.where(F.col("place") <= config.prefix).select("query_id", "h", "token"), windows), "prefix")
    covers = max_cover(first, config.prefix_matches).groupBy("query_id", "doc_id").agg(F.max("n_collide").alias("n_prefix"))
    if config.prefix >= config.k:
        own = first
    else:
        covers = materialise(covers, "candidates")
        # one read of all lists, for candidates alone: lists and documents of candidates meet windows, so no other window meets a query
        asked = ranked.select("query_id", "h", "token").join(covers.select("query_id", "doc_id"), "query_id")
        own = windows.join(asked, ["h", "token", "doc_id"]).select("query_id", "h", "doc_id", "l", "c", "r")
    return Found(max_cover(own, config.matches), covers)


def once(found: Found) -> DataFrame:
    """Matches that a search reports which tries candidates from the best prefix cover down (then from the greatest id) and, once
    one has matched, goes on only with those whose cover equals the very best."""
    matches, prefix = materialise(found.matches, "matches"), materialise(found.prefix, "prefix")
    # no order of all candidates is needed: only the greatest cover of a query, and its best candidate that matched
    hit = matches.select("query_id", "doc_id").distinct().join(prefix, ["query_id", "doc_id"])
    first = hit.groupBy("query_id").agg(F.max(F.struct("n_prefix", "doc_id")).alias("first"))
    top = prefix.groupBy("query_id").agg(F.max("n_prefix").alias("top"))
    chosen = hit.join(first, "query_id").join(top, "query_id").where("n_prefix = top or (n_prefix = first.n_prefix and doc_id = first.doc_id)").select("query_id", "doc_id")
    return matches.join(chosen, ["query_id", "doc_id"], "left_semi")


def search(signatures: DataFrame, windows: DataFrame, config: SearchConfig, index: DataFrame | None = None, count: str = "n") -> DataFrame:
    """(query_id, doc_id, l, n_collide, r) in the mode that config.once names."""
    found = exhaustive(signatures, windows, config, index, count)
    return once(found) if config.once else found.matches


def guarded(signatures: DataFrame, index: DataFrame, most_windows: int) -> DataFrame:
    """(query_id, windows, allowed): whether a query's lists hold at most so many windows; nothing is cut, callers decide."""
    return ranked_lists(signatures, index).groupBy("query_id").agg(F.sum("n").alias("windows")).withColumn("allowed", F.col("windows") <= most_windows)
