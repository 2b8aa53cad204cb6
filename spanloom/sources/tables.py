"""The window relation and its companions as Parquet, by function and epoch, and small text inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_windows(windows: DataFrame, path: str, epoch: int | None = None, mode: str = "append") -> None:
    """Sorted by (token, doc_id, c, l) within a function: a scan for a list or a document skips what it doesn't need by
    partition and by the minima and maxima of row groups. Files are ranges of (h, token)."""
    columns = ["h"] if epoch is None else ["epoch", "h"]
    out = windows if epoch is None else windows.withColumn("epoch", F.lit(epoch))
    ordered = out.repartitionByRange("h", "token", "doc_id").sortWithinPartitions("h", "token", "doc_id", "c", "l")
    # an epoch that is written again replaces itself, so an ingest can be repeated after a crash
    ordered.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """All functions and epochs: reading is the merge, since epochs hold different documents."""
    return spark.read.schema("h int, token int, doc_id long, l int, c int, r int").parquet(path).select("h", "token", "doc_id", "l", "c", "r")


def compact_epochs(spark: SparkSession, path: str, out: str) -> None:
    """Rewrites the epochs as one table, sorted through."""
    write_windows(read_windows(spark, path), out, mode="overwrite")


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """(word): one on each line of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def write_stopword_tokens(tokens: DataFrame, path: str) -> None:
    """(token) as a file of one length-prefixed array."""
    tokens.agg(F.sort_array(F.collect_set("token")).alias("tokens")).write.format("corpus_bin").mode("overwrite").save(path)


def read_stopword_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(token) of stopword files; the source corpus_bin must be registered."""
    return spark.read.format("corpus_bin").load(path).select(F.explode("tokens").alias("token")).distinct()


def random_access(docs: DataFrame, ids: list[int], id_col: str = "doc_id") -> DataFrame:
    """Documents by id; the predicate reaches the scan."""
    return docs.where(F.col(id_col).isin(ids))
