"""Words of texts, dictionaries of words, and texts as integer sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.session import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELIMITERS = "[\\t\\n\\r\\x0B\\f\\p{Punct} ]+"
NON_DELIMITERS = "[^\\t\\n\\r\\x0B\\f\\p{Punct} ]+"


def words(text: Column) -> Column:
    """Array of words: runs between ASCII white space and punctuation, with ASCII capitals lowered and other letters as they are."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), DELIMITERS), lambda x: x != "")


def positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, word) of every word, pos from 0."""
    return docs.select(F.col(id_col), F.posexplode(words(F.col(text_col))).alias("pos", "word"))


def byte_offsets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, byte_offset): where each word begins in the UTF-8 text."""
    parts = docs.select(F.col(id_col), F.col(text_col).alias("t"), F.regexp_extract_all(text_col, F.lit(NON_DELIMITERS), 0).alias("w"), F.regexp_extract_all(text_col, F.lit(DELIMITERS), 0).alias("d"))
    # word i comes after i words and the delimiters before it, one more if the text begins with one
    lead = F.when(F.regexp_like("t", F.lit("\\A" + DELIMITERS)), 1).otherwise(0)
    one = parts.withColumn("lead", lead).select(id_col, "d", "lead", F.posexplode("w").alias("pos", "word"), (F.element_at("d", 1)).alias("first"))
    gap = F.when(F.col("lead") + F.col("pos") >= 1, F.octet_length(F.get("d", F.col("pos") + F.col("lead") - 1))).otherwise(0)
    before = Window.partitionBy(id_col).orderBy("pos")
    return one.withColumn("gap", gap).select(id_col, "pos", (F.sum(F.col("gap") + F.octet_length("word")).over(before) - F.octet_length("word")).cast("long").alias("byte_offset"))


#: A word with more than this share of all words is frequent; there can't be more than HEAD of them.
HEAD = 10_000


def dictionary(*word_tables: DataFrame) -> DataFrame:
    """(word, token, n) of the different words of tables with a word column: their ranks in binary order, from 0, and their numbers.

    Ranked by range partitions side by side and shifted by the sizes of those before, so no task sorts the whole vocabulary.
    """
    every = word_tables[0].select("word")
    for t in word_tables[1:]:
        every = every.unionAll(t.select("word"))
    return ranked(every.groupBy("word").agg(F.count("*").alias("n")))


def ranked(counts: DataFrame) -> DataFrame:
    """The dictionary of different words and their numbers (word, n)."""
    ordered = counts.where("word is not null").repartitionByRange("word").select("word", F.col("n").alias("many"), F.spark_partition_id().alias("part"))
    ordered = materialise(ordered, "words")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    shifts = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("word")) - 1
    return ordered.withColumn("rank", rank).join(F.broadcast(shifts), "part").select("word", (F.col("rank") + F.col("shift")).cast("int").alias("token"), F.col("many").alias("n"))


def encode(placed: DataFrame, words_to_tokens: DataFrame, stopwords: DataFrame | None = None) -> DataFrame:
    """(…, word) -> (…, token). Words of `stopwords` are left out and positions keep their gaps; see renumber().

    With a dictionary that has numbers (n), words of more than 1 / HEAD of all, at most HEAD of them, are looked up in a broadcast table
    and never shuffled; no other word is so frequent that the shuffle of the rest would be skewed.
    """
    if stopwords is not None:
        placed = placed.join(stopwords.select("word"), "word", "left_anti")
    if "n" not in words_to_tokens.columns:
        return placed.join(words_to_tokens, "word").drop("word")
    least = (words_to_tokens.agg(F.sum("n")).first()[0] or 0) / HEAD
    head = words_to_tokens.where(F.col("n") > least).select("word", "token")
    rest = words_to_tokens.where(F.col("n") <= least).select("word", "token")
    known = placed.join(F.broadcast(head), "word").drop("word")
    return known.unionByName(placed.join(F.broadcast(head), "word", "left_anti").join(rest, "word").drop("word"))


def renumber(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """pos counted anew from 0 within each id, after words or tokens were left out."""
    return placed.withColumn("pos", (F.row_number().over(Window.partitionBy(id_col).orderBy("pos")) - 1).cast("int"))


def sequences(placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, pos, token) -> (id, tokens): one array for each id, in order."""
    return placed.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))


def frequent_words(placed: DataFrame, n: int) -> DataFrame:
    """(word) of the n most frequent; ties go to the first in binary order."""
    return placed.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n).select("word")


def parse_ints(text: Column) -> Column:
    """Array of the integers of a text that separates them by spaces."""
    return F.transform(F.filter(F.split(text, " +"), lambda x: x != ""), lambda x: x.cast("int"))


def int_bytes(value: Column) -> Column:
    """A 32-bit integer as 4 bytes, the least first."""
    h = F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.unhex(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def bytes_int(data: Column) -> Column:
    h = F.hex(data)
    value = F.conv(F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)), 16, 10).cast("long")
    return F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value).cast("int")


def passage(tokens: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """Tokens l to r, both included."""
    return F.slice(tokens, l + 1, r - l + 1)


def without_value(tokens: Column, value: int) -> Column:
    return F.array_remove(tokens, value)
