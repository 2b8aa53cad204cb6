"""Ingest of a growing corpus: each micro-batch is an epoch of windows, appended to one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from spanloom.sources import segments


def epochs(docs: DataFrame, size: int, id_col: str = "doc_id") -> DataFrame:
    """docs with epoch: ranges of `size` ids."""
    from pyspark.sql import functions as F

    return docs.withColumn("epoch", F.floor(F.col(id_col) / size).cast("int"))


def ingest(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, k: int, t: int, stopwords: list[int] | None = None) -> StreamingQuery:
    """Windows of a stream of (doc_id, tokens), one epoch for each micro-batch. A batch that is tried again overwrites its epoch.

    Window generation needs nothing but its document, so there is no state and no watermark, and windows are stored where they are made.
    """

    def append(batch: DataFrame, number: int) -> None:
        segments.write(batch, k, t, f"{path}/epoch={number}", stopwords)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
