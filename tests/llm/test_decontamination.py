import random
import re

import numpy as np
import pytest

from spanloom.llm import decontamination as d

DOCS = "doc_id long, text string, item_id long, n_grams string"


def test_wu_manber_equals_find():
    rng = random.Random(4)
    for size in (2, 4, 26):
        alphabet = "abcdefghijklmnopqrstuvwxyz"[:size]
        text = "".join(rng.choices(alphabet, k=30_000))
        patterns = {"".join(rng.choices(alphabet, k=rng.randint(8, 30))) for _ in range(30)} | {text[i : i + rng.randint(8, 40)] for i in rng.sample(range(29_000), 30)} | {text[-9:], text[:8]}
        search = d.WuManber([p.encode() for p in patterns])
        got = {(b, search.patterns[i].decode()) for b, i in search.search(np.frombuffer(text.encode(), np.uint8))}
        want = {(m.start(), p) for p in patterns for m in re.finditer(f"(?={p})", text)}
        assert got == want


def corpus():
    rng = random.Random(9)
    words = [f"t{i}é" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 40)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "one two three four"), (None, "x " * 20), (0, items[0][1]), (93, items[3][1])]
    docs = []
    for i in range(60):
        t = rng.choices(words, k=rng.randint(0, 200))
        if i % 3 == 0:
            item = rng.choice(items[:25])[1].split()
            a = rng.randint(0, max(0, len(item) - 10))
            t[5:5] = [w.upper() + rng.choice([",", "!", ""]) for w in item[a : a + rng.randint(8, 20)]]
        docs.append((i, " ".join(t)))
    return [*docs, (70, None), (71, ""), (None, docs[0][1]), (0, docs[0][1])], items


def brute(docs, items):
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    found = {}
    for i, t in docs:
        for item, it in items:
            if i is not None and t is not None and item is not None and it is not None:
                hits = {g for g in d.grams(norm(it)) if g in norm(t)}
                if hits:
                    found[i, item] = len(hits)
    return found


def test_contamination_equals_brute_force(spark):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 10
    for shard in (d.SHARD_BYTES, 600):  # one shard, and many
        assert {(r[0], r[1]): r[2] for r in d.contamination(df, bench, shard_bytes=shard).collect()} == want
        kept = d.drop_contaminated(df, bench, shard_bytes=shard)
        assert kept.columns == df.columns
        bad = {i for i, _ in want}
        assert sorted((str(r[0]), r[1] or "") for r in kept.collect()) == sorted((str(i), t or "") for i, t in docs if i not in bad and not (i is None and 0 in bad))


def test_nothing_to_search(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l", 1, "")], DOCS)
    for items in ([], [(1, "too few words")], [(1, None)]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        assert d.contamination(docs, bench).count() == 0
        assert d.drop_contaminated(docs, bench).count() == 1
    assert d.contamination(docs.where("false"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_matches_do_not_span_documents(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", 1, ""), (2, "delta epsilon zeta", 1, "")], DOCS).coalesce(1)
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    assert d.contamination(docs, bench).count() == 0


@pytest.mark.parametrize("size", [10, 200_000])
def test_long_text(spark, size):
    docs = spark.createDataFrame([(1, "filler " * size + "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10", 1, "")], DOCS)
    bench = spark.createDataFrame([(5, "P1, P2, P3, P4, P5, P6, P7, P8, P9, P10.")], "item_id long, text string")
    assert [tuple(r) for r in d.contamination(docs, bench).collect()] == [(1, 5, 1)]
