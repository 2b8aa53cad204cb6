"""Secret scans with multipart credential linking.

Parts are found by pattern: access identifiers, secrets and endpoints, each at an interval of characters of its document.
A scope is the whole document (`document_secrets`), where distances rank the company, or a stretch of `reach` characters around a
secret (`linked_secrets`): an interval join on document and buckets of `reach` characters brings together the parts whose intervals
are within one scope. A strong secret (whose form alone tells, such as a private key
block) is always reported; a weak one (a random-looking string) only when an identifier or an endpoint is in its scope.
Of several, the nearest is named (before wins a tie) and all are counted.

Defined results: null ids and texts hold nothing; repeated rows of an id are scanned once for each different part; a place that
several rules match belongs to the first rule, strong ones first; overlapping parts of different kinds are linked (distance 0);
parts of any length and very long texts are scanned whole; other columns are ignored, whatever their names; an empty table has no rows. The secret is reported as a digest, never in clear.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import store, trimmed

REACH = 200
LEAST_ENTROPY = 3.0

#: A name goes on after its keyword (SECRET_KEY, passwordHash), or begins anew before it (DB_USER, db.user, dbUser).
_AFTER = r"[A-Za-z0-9_.-]{0,40}"
_BEFORE = r"(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))"

#: (kind, rule, strong, pattern, signs): group "v" or else the whole match is the part; any text that matches has one of the signs.
RULES = [
    # with its headers and to its END line; of a block that is cut off, the lines of a key that are there
    ("secret", "private_key", True, re.compile(r"-----BEGIN [A-Z0-9 ]*+(?<=PRIVATE KEY)-----(?:\s*+[A-Za-z][\w-]*+:[^\n]*+)*+(?:[A-Za-z0-9+/=\s]*-----END [A-Z0-9 ]*+(?<=PRIVATE KEY)-----|(?:\s*[A-Za-z0-9+/=]{16,})*)"), ("PRIVATE KEY-----",)),
    ("secret", "github_token", True, re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("secret", "slack_token", True, re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}"), ("xox",)),
    ("secret", "google_key", True, re.compile(r"\bAIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), ("AIza",)),
    ("secret", "stripe_key", True, re.compile(r"\b[rs]k_live_[0-9A-Za-z]{16,}\b"), ("k_live_",)),
    ("secret", "jwt", True, re.compile(r"\beyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}"), ("eyJ",)),
    ("secret", "url_password", True, re.compile(r"://[^\s/:@\"'<>]*+:(?P<v>[^\s/@\"'<>]++)@(?=[\w\[])"), ("://",)),
    ("secret", "assigned", False, re.compile(rf"(?:(?i:secret(?!ar|ion|ive)|token(?!i[sz])|password|passwd|pwd|api[_-]?key){_AFTER}|{_BEFORE}(?i:auth)(?![A-Za-z]))[\"']?\s{{0,3}}[:=]\s{{0,3}}[\"']?(?P<v>[^\s\"',;]{{8,}})"), ("=", ":")),
    ("secret", "random_string", False, re.compile(r"(?<![\w/+-])(?P<v>(?=[\w/+-]*[0-9])(?=[\w/+-]*[A-Za-z])[A-Za-z0-9/+_-]{32,}+={0,2})(?![\w/+=-])"), "0123456789"),
    ("identifier", "aws_access_key_id", False, re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"), ("AKIA", "ASIA")),
    ("identifier", "oauth_client", False, re.compile(r"\b[0-9]{6,}-[a-z0-9]{20,}\.apps\.[a-z]+\.com\b"), (".apps.",)),
    ("identifier", "account", False, re.compile(_BEFORE + r"(?i:(?:user(?:name)?|login|client[_-]?id|account[_-]?id|access[_-]?key[_-]?id)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?P<v>[^\s\"',;]{3,})"), ("=", ":")),
    ("identifier", "email", False, re.compile(r"\b[\w.+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,4}\b"), ("@",)),
    ("endpoint", "url", False, re.compile(r"\b(?:https?|wss?|ftp|jdbc:\w+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp)://[^\s\"'<>]{3,}"), ("://",)),
    ("endpoint", "host", False, re.compile(_BEFORE + r"(?i:(?:host(?:name)?|endpoint|server|base[_-]?url)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?P<v>[^\s\"',;]{3,})"), ("=", ":")),
    ("endpoint", "address", False, re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?(?![\w.])"), "0123456789"),
]


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


def parts_of(text: str, least_entropy: float = LEAST_ENTROPY) -> list[tuple[str, str, bool, int, int, str]]:
    """(kind, rule, strong, begin, end, digest) of the parts in a text; of one kind none overlaps another."""
    out: list[tuple[str, str, bool, int, int, str]] = []
    for kind, rule, strong, pattern, signs in RULES:
        if not any(x in text for x in signs):
            continue
        for m in pattern.finditer(text):
            begin, end = m.span("v") if "v" in pattern.groupindex else m.span()
            value = text[begin:end]
            if kind == "secret" and not strong and entropy(value) < least_entropy:
                continue
            if not any(k == kind and b < end and begin < e for k, _, _, b, e, _ in out):
                out.append((kind, rule, strong, begin, end, hashlib.sha256(value.encode()).hexdigest()[:16]))
    return out


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_entropy: float = LEAST_ENTROPY) -> DataFrame:
    """Rows (id, kind, rule, strong, begin, end, digest), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("rule", pa.string()), ("strong", pa.bool_()), ("begin", pa.int32()), ("end", pa.int32()), ("digest", pa.string())])
        for batch in batches:
            rows = [(i, *p) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for p in parts_of(text, least_entropy)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    # scanned once: the sides of a join each read what is stored
    return store(texts.mapInArrow(trimmed(run), "id long, kind string, rule string, strong boolean, begin int, end int, digest string").distinct(), "parts")


def linked_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, least_entropy: float = LEAST_ENTROPY) -> DataFrame:
    """Rows (doc_id, begin, end, rule, strong, digest, identifiers, identifier_rule, identifier_begin, endpoints, endpoint_rule, endpoint_begin)."""
    found = parts(docs, id_col, text_col, least_entropy)
    secret = found.where("kind = 'secret'").drop("kind")
    # an interval may span buckets: each side is listed in every bucket it touches, the secrets with their reach
    size = F.lit(reach)
    near = secret.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("begin") - size) / size), F.floor((F.col("end") + size) / size))))
    other = found.where("kind <> 'secret'").select("id", "kind", F.col("rule").alias("o_rule"), F.col("begin").alias("o_begin"), F.col("end").alias("o_end"))
    other = other.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("o_begin") / size), F.floor(F.col("o_end") / size))))
    distance = F.greatest(F.col("o_begin") - F.col("end"), F.col("begin") - F.col("o_end"), F.lit(0))
    met = near.join(other, ["id", "bucket"]).where(distance <= size).select("id", "begin", "end", "rule", "kind", "o_rule", "o_begin", distance.alias("distance")).distinct()
    one = lambda kind: (F.count(F.when(F.col("kind") == kind, 1)), F.min(F.when(F.col("kind") == kind, F.struct("distance", "o_begin", "o_rule"))))
    (ni, i), (ne, e) = one("identifier"), one("endpoint")
    links = met.groupBy("id", "begin", "end", "rule").agg(ni.alias("identifiers"), i.alias("i"), ne.alias("endpoints"), e.alias("e"))
    out = secret.join(links, ["id", "begin", "end", "rule"], "left").where("strong or identifiers > 0 or endpoints > 0")
    return out.select(
        F.col("id").alias("doc_id"), "begin", "end", "rule", "strong", "digest",
        F.coalesce("identifiers", F.lit(0)).alias("identifiers"), F.col("i.o_rule").alias("identifier_rule"), F.col("i.o_begin").alias("identifier_begin"),
        F.coalesce("endpoints", F.lit(0)).alias("endpoints"), F.col("e.o_rule").alias("endpoint_rule"), F.col("e.o_begin").alias("endpoint_begin"),
    )


def document_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_entropy: float = LEAST_ENTROPY) -> DataFrame:
    """Rows as linked_secrets has them, with identifier_distance and endpoint_distance; the scope of a secret is its whole document.

    The parts of a document come together as one row, so a document of m secrets and n others costs no m * n rows.
    """
    place = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.struct("begin", "end", "rule")))
    found = parts(docs, id_col, text_col, least_entropy)
    secret = F.collect_set(F.when(F.col("kind") == "secret", F.struct("begin", "end", "rule", "strong", "digest")))
    each = found.groupBy("id").agg(secret.alias("s"), place("identifier").alias("i"), place("endpoint").alias("e")).select("id", F.explode("s").alias("s"), "i", "e").where("s.strong or size(i) > 0 or size(e) > 0")

    def nearest(kind: str):
        distance = lambda o: F.greatest(o["begin"] - F.col("s.end"), F.col("s.begin") - o["end"], F.lit(0))
        return F.array_min(F.transform(kind, lambda o: F.struct(distance(o).alias("distance"), o["begin"].alias("begin"), o["rule"].alias("rule"))))

    out = each.select("id", "s", F.size("i").cast("long").alias("identifiers"), nearest("i").alias("i"), F.size("e").cast("long").alias("endpoints"), nearest("e").alias("e"))
    return out.select(
        F.col("id").alias("doc_id"), "s.begin", "s.end", "s.rule", "s.strong", "s.digest",
        "identifiers", F.col("i.rule").alias("identifier_rule"), F.col("i.begin").alias("identifier_begin"),
        "endpoints", F.col("e.rule").alias("endpoint_rule"), F.col("e.begin").alias("endpoint_begin"),
        F.col("i.distance").alias("identifier_distance"), F.col("e.distance").alias("endpoint_distance"),
    )
