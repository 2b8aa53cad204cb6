import random

import pytest
from pyspark.sql import functions as F

from spanloom.config import CORPORA, BuildConfig, SearchConfig
from spanloom.functions import hashing, text


def test_coefficients():
    assert hashing.family(3) == [(0, 1804289383, 846930886), (1, 1505335290, 1738766719), (2, 1205554746, 483147985)]
    assert hashing.coefficients(0) == hashing.coefficients(1) and hashing.coefficients(16) == (462648444, 192278013)


def test_hash_wraps(spark):
    a, b = hashing.coefficients(1)
    got = spark.range(1).select(hashing.linear_hash(F.lit(50000), F.lit(a), F.lit(b)).alias("x"), hashing.stopword_hash(F.lit(3), F.lit(a), F.lit(b), F.lit(True)).alias("y"), hashing.hash_array(F.array(F.lit(5), F.lit(3)), a, b, [3]).alias("z")).first()
    assert got["x"] == -471971594 and got["y"] == 2147483647 and got["z"] == [1278443209, 2147483647]


def test_sequence_hash(spark):
    def fold(values):
        seed = len(values)
        for v in values:
            x = v
            for _ in range(2):
                x = ((((x >> 16) ^ x) * 0x45D9F3B + 2**31) % 2**32) - 2**31
            x = (x >> 16) ^ x
            seed ^= ((x + 0x9E3779B9) % 2**32 + seed * 64 + seed // 4) % 2**64
        return seed - 2**64 if seed >= 2**63 else seed

    rng = random.Random(1)
    rows = [[], [1], [-5, 7], [rng.randrange(-(2**31), 2**31) for _ in range(50)], None]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<int>").orderBy("i").select(hashing.sequence_hash("a")).collect()]
    assert got == [fold(r) if r is not None else None for r in rows]


@pytest.mark.parametrize("k,theta,ratio,want", [(64, 0.8, 0.4, (52, 26, 14)), (32, 0.8, 0.4, (26, 13, 7)), (16, 0.8, 0.4, (13, 7, 4)), (10, 0.8, 0.4, (8, 4, 2)), (64, 0.5, 0.4, (32, 26, -6)), (5, 0.6, 0.4, (3, 2, 0))])
def test_thresholds(k, theta, ratio, want):
    c = SearchConfig(k=k, theta=theta, prefix_ratio=ratio)
    assert (c.matches, c.prefix, c.prefix_matches) == want
    assert c.effective().prefix_matches > 0 and (c.effective() == c) == (want[2] > 0)


def test_config():
    c = BuildConfig.preset("c4", k=8)
    assert c.doc_limit == CORPORA["c4"] and c.with_(t=7).folder("/x/") == f"/x/c4-k8-t7-v50257-d{CORPORA['c4']}-s1"
    with pytest.raises(ValueError):
        BuildConfig(k=0)


def test_words_offsets_dictionary(spark):
    rows = [(1, "  Été, the THE a-b_c\n\x0bx"), (2, ""), (3, "...") , (4, None), (5, "word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = text.positions(docs)
    got = {(r["doc_id"], r["pos"]): r["word"] for r in placed.collect()}
    assert [got[1, i] for i in range(7)] == ["Été", "the", "the", "a", "b", "c", "x"] and len(got) == 8  # only ASCII letters are lowered
    raw = {i: t.encode() for i, t in rows if t}
    for r in text.byte_offsets(docs).collect():
        word = got[r["doc_id"], r["pos"]].encode()
        assert raw[r["doc_id"]][r["byte_offset"] : r["byte_offset"] + len(word)].lower() == word.lower()
    words = sorted({w for w in got.values()}, key=lambda w: w.encode())
    assert {r["word"]: r["token"] for r in text.dictionary(placed).collect()} == {w: i for i, w in enumerate(words)}
    kept = text.renumber(text.encode(placed, text.dictionary(placed), text.frequent_words(placed, 1)))
    assert sorted((r["doc_id"], r["pos"]) for r in kept.collect()) == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (5, 0)]


def test_small_functions(spark):
    got = spark.range(1).select(
        text.parse_ints(F.lit(" 3 -4  50")).alias("a"), text.bytes_int(text.int_bytes(F.lit(-2))).alias("b"), text.int_bytes(F.lit(258)).alias("c"),
        text.passage(F.array(*map(F.lit, range(9))), F.lit(2), F.lit(4)).alias("d"), text.without_value(F.array(F.lit(220), F.lit(1)), 220).alias("e"),
    ).first()
    assert got["a"] == [3, -4, 50] and got["b"] == -2 and bytes(got["c"]) == b"\x02\x01\0\0" and got["d"] == [2, 3, 4] and got["e"] == [1]


def test_encode_of_frequent_words(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["the", "of", *(f"w{k}" for k in range(300))], [500, 300] + [1] * 300, k=80))) for i in range(60)]
    placed = text.positions(spark.createDataFrame(rows, "doc_id long, text string"))
    words = text.dictionary(placed)
    want = {r["word"]: r["token"] for r in words.collect()}
    for head in (3, 10_000):
        monkeypatch.setattr(text, "HEAD", head)
        got = sorted(map(tuple, text.encode(placed, words).select("doc_id", "pos", "token").collect()))
        assert got == sorted((r.doc_id, r.pos, want[r.word]) for r in placed.collect())
    assert text.encode(placed.where("false"), text.dictionary(placed.where("false"))).count() == 0
