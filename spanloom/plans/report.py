"""Reports over matches (query_id, doc_id, l, n_collide, r)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import passage


def passages(matches: DataFrame) -> DataFrame:
    """(query_id, doc_id, island, l, r): matches of a document that meet, merged."""
    order = Window.partitionBy("query_id", "doc_id").orderBy("l", "r")
    ended = F.max("r").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = matches.withColumn("new", F.when(ended.isNull() | (F.col("l") > ended), 1).otherwise(0)).withColumn("island", F.sum("new").over(order))
    return marked.groupBy("query_id", "doc_id", "island").agg(F.min("l").alias("l"), F.max("r").alias("r"))


def passage_count(matches: DataFrame) -> DataFrame:
    """(query_id, n_passages)."""
    return passages(matches).groupBy("query_id").agg(F.count("*").alias("n_passages"))


def passage_histogram(matches: DataFrame) -> DataFrame:
    """(n_passages, n_queries)."""
    return passage_count(matches).groupBy("n_passages").agg(F.count("*").alias("n_queries"))


def similarity_buckets(matches: DataFrame, k: int, levels: list[float]) -> DataFrame:
    """(level, n_queries): queries whose best match reaches each level; any match counts for the least."""
    best = matches.groupBy("query_id").agg(F.max("n_collide").alias("best"))
    counts = best.agg(*(F.count_if((F.col("best") / F.lit(float(k)) >= v) if i else F.lit(True)).alias(f"n{i}") for i, v in enumerate(levels)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.col(f"n{i}").alias("n_queries")) for i, v in enumerate(levels)))).alias("x")).select("x.level", "x.n_queries")


def longest_match(matches: DataFrame) -> DataFrame:
    """(query_id, doc_id, l, r): the longest span of each query; of equals that of the greatest (doc_id, l)."""
    best = F.max_by(F.struct("doc_id", "l", "r"), F.struct(F.col("r") - F.col("l"), "doc_id", "l"))
    return matches.groupBy("query_id").agg(best.alias("m")).select("query_id", "m.doc_id", "m.l", "m.r")


def match_passages(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans(…, doc_id, l, r) with the tokens they hold, both ends included."""
    return spans.join(docs.select("doc_id", "tokens"), "doc_id").withColumn("passage", passage(F.col("tokens"), F.col("l"), F.col("r"))).drop("tokens")


def totals(matches: DataFrame, queries: DataFrame) -> DataFrame:
    """(n_queries, n_found, n_matches, n_passages): distinct query_id of queries, those with a match, match rows, and their passages."""
    found = matches.agg(F.count_distinct("query_id").alias("n_found"), F.count("*").alias("n_matches"))
    every = passages(matches).agg(F.count("*").alias("n_passages"))
    return queries.select("query_id").distinct().agg(F.count("*").alias("n_queries")).crossJoin(found).crossJoin(every)


def width_histogram(windows: DataFrame) -> DataFrame:
    """(h, width, n)."""
    return windows.groupBy("h", (F.col("r") - F.col("l") + 1).alias("width")).agg(F.count("*").alias("n"))
