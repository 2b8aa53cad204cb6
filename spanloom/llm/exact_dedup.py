"""Exact dedup: group by 128-bit content hash, keep the smallest id, compare bytes inside groups.

Digests and ids are shuffled for all documents; texts only for those whose digest occurs more than once, and combined on the
map side, so that a text with a million copies is sent once per map task. Two texts of one digest that differ (a collision)
stay apart: the comparison is that of Spark's grouping on the text itself.

Defined results: a null text has no content and is never a copy; a null id can't be named and is left out; empty texts are
copies of each other; among equal ids there is nothing to choose, so repeated rows of one id yield no pair; columns besides
id and text don't count, whatever their names; very long texts are digested and compared whole. An empty table yields no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import small, store, unused


def _groups(members: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(digest, keep_id, copies) of the repeated contents, and (digest, content, keep_id) of digests that several contents share."""
    repeated = store(members.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1").select("digest"), "digests")
    known = small(repeated, repeated.count())
    contents = texts.join(known, "digest", "left_semi").groupBy("digest", "content").agg(F.min("id").alias("keep_id"), F.count("*").alias("copies"))
    groups = store(contents.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("copies").alias("copies"), F.count("*").alias("contents")), "groups")
    if groups.where("contents > 1").isEmpty():
        return groups, None
    collided = groups.where("contents > 1").select("digest")
    return groups, store(contents.join(collided, "digest", "left_semi"), "collided")


def _pairs(docs: DataFrame, id_col: str, text_col: str, digest) -> tuple[DataFrame, DataFrame, bool]:
    """(id, keep_id, digest) of the copies, the texts they come from, and whether any digest is shared by different texts."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("content")).where("id is not null and content is not null").withColumn("digest", digest(F.col("content")))
    members = texts.select("digest", "id")
    groups, collided = _groups(members, texts)
    single = groups.where("contents = 1 and copies > 1")
    pairs = members.join(single.select("digest", "keep_id"), "digest").select("id", "keep_id", "digest")
    if collided is not None:
        pairs = pairs.unionAll(texts.join(collided, ["digest", "content"]).select("id", "keep_id", "digest"))
    return pairs.where("id <> keep_id").distinct(), texts, collided is not None


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=F.md5) -> DataFrame:
    """Rows (doc_id, keep_id): each document that is a byte-for-byte copy, and the smallest id with its text."""
    return _pairs(docs, id_col, text_col, digest)[0].select(F.col("id").alias("doc_id"), "keep_id").distinct()


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=F.md5) -> DataFrame:
    """docs with one row for each text: that of the smallest id. Rows with a null id or text stay. All columns are kept.

    Repeated rows of one id and text are reduced to one of them (the least by their other columns).
    """
    key = unused(docs, "content_digest")
    keyed = docs.withColumn(key, digest(F.col(text_col)))
    found, texts, collided = _pairs(docs, id_col, text_col, digest)
    pairs = store(found, "copies")
    rows = pairs.count()
    twice = store(texts.groupBy("digest", "id").agg(F.count("*").alias("n")).where("n > 1").select("digest", "id"), "twice")
    again = twice.count()
    if not again and not collided:
        # an id may also carry other texts, so a row goes by id and digest
        out = pairs.select(F.col("id").alias(id_col), F.col("digest").alias(key)).distinct()
        return keyed.join(small(out, rows), [id_col, key], "left_anti").select(*docs.columns)
    keep = _first_of_copies(keyed, pairs, twice, id_col, text_col, key, again, rows)
    return keep.select(*docs.columns)


def _first_of_copies(keyed: DataFrame, pairs: DataFrame, twice: DataFrame, id_col: str, text_col: str, key: str, again: int, rows: int) -> DataFrame:
    """Where ids repeat or digests collide: the ids concerned go through a window over their texts, all other rows through the anti join."""
    from pyspark.sql import Window

    ids = store(twice.select("id").unionAll(pairs.select("id")).unionAll(pairs.select("keep_id")).distinct(), "ids").select(F.col("id").alias(id_col))
    n = again + 2 * rows
    rest = keyed.join(small(ids, n), id_col, "left_anti")
    own = keyed.join(small(ids, n), id_col, "left_semi")
    rank = unused(keyed, "copy_rank")
    order = [F.col(id_col), *[F.to_json(F.struct(F.col(c).alias("x"))) for c in keyed.columns if c not in (id_col, text_col, key)]]
    first = own.where(F.col(text_col).isNotNull()).withColumn(rank, F.row_number().over(Window.partitionBy(key, text_col).orderBy(*order))).where(F.col(rank) == 1).drop(rank)
    return rest.unionByName(first).unionByName(own.where(F.col(text_col).isNull()))
