"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns those it keeps with all their columns, whatever these are;
the last adds `copies` (and replaces a column of that name). Defined results: rows with a null id or text pass the first four stages, unless they are
contaminated; those with a null id are not in the mixture. Repeated rows of an id and text are one after exact dedup. Of equal texts, and of near
duplicates, the smallest id stays. Very long texts are treated whole; an empty table passes as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontamination, exact_dedup, mixing, simhash, toxicity
from spanloom.session import delete, fresh_path, scratch, ship


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixed(docs)


STAGES = [("toxicity", toxic_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: SQL expresses neither the nearest examples nor the hash balls; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and their copies; each stage is written to the shared folder and read again.

    What a stage stores on its way is deleted when its documents are written, those when the next stage's are.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
