import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import toxicity as t

DOCS = "doc_id long, text string, score string, toxic int"


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    common, bad = [f"c{i}" for i in range(40)], [f"bad{i}" for i in range(8)]
    docs, truth = [], {}
    for i in range(n):
        words = rng.choices(common, k=rng.randint(20, 120)) + [f"r{rng.randrange(100000)}" for _ in range(20)]
        truth[i] = int(rng.random() < 0.25)
        if truth[i]:
            words += rng.choices(bad, k=rng.randint(3, 8))
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
    return docs, truth


@pytest.mark.parametrize("k", [1, 8, 100, 1000])
def test_block_max_is_exact(k):
    rng = np.random.default_rng(1)
    dims, n = 60, 500
    dense = np.where(rng.random((n, dims)) < np.linspace(0.01, 0.5, dims), rng.random((n, dims)), 0)  # short lists and rows
    dense[50:60] = dense[50]  # ties
    norms = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, norms, out=np.zeros_like(dense), where=norms > 0).astype(np.float32).astype(float)
    index = t.BlockMax(np.arange(n), np.arange(n) % 2, [(np.flatnonzero(v), v[v > 0]) for v in dense], dims, block=16)
    assert 0 < len(index.rows) < dims
    for q in range(0, n, 3):
        d = np.flatnonzero(dense[q])
        cosines = dense @ dense[q]
        want = [i for i in sorted(range(n), key=lambda i: (-np.round(cosines[i], 9), i)) if cosines[i] > 0 and i != q][:k]
        best, got = index.nearest(d, dense[q][d], k, without=q)
        assert len(best) == len(want) and np.allclose(got, cosines[index.ids[best]], atol=1e-6)
        assert np.allclose(got, cosines[want], atol=2e-6)
        assert all(a == b or abs(cosines[a] - cosines[b]) < 2e-6 for a, b in zip(index.ids[best].tolist(), want))


def test_examples_of_a_language_are_together():
    """The blocks of another language can be left out."""
    rng = np.random.default_rng(2)
    vectors = []
    for i in range(640):
        d = np.unique(np.concatenate([[i % 2], rng.integers(2, 300, 20) + 300 * (i % 2)]))
        vectors.append((d, np.full(len(d), len(d) ** -0.5)))
    index = t.BlockMax(np.arange(640), np.zeros(640), vectors, 700)
    assert all(len(set((index.ids[b * 64 : b * 64 + 64] % 2).tolist())) == 1 for b in range(10))


def test_held_out_accuracy(spark):
    docs, truth = corpus(3, 900)
    df = spark.createDataFrame([(i, x, "", 0) for i, x in docs], DOCS)
    labels = spark.createDataFrame([(i, y) for i, y in truth.items() if i < 600], "doc_id long, toxic int")
    rows = t.toxic_documents(df, labels).collect()
    got = {r["doc_id"] for r in rows}
    held = [i for i in truth if i >= 600]
    assert np.mean([(i in got) == truth[i] for i in held]) > 0.95
    for r in rows:
        assert r["evidence"] and all(e["example_id"] != r["doc_id"] and 0 < e["cosine"] <= 1 + 1e-6 for e in r["evidence"]) and t.THRESHOLD <= r["score"] <= 1
    kept = t.drop_toxic(df, labels)
    assert kept.columns == df.columns and {r[0] for r in kept.collect()} == truth.keys() - got


def test_matches_brute_force(spark):
    """Every document is scored by dense vectors over all words of the examples; those not reported are compared too."""
    docs, truth = corpus(5, 260)
    docs += [(900, docs[3][1]), (901, " ".join(w for w in docs[7][1].split() if w[0] == "r")), (902, "nothing known here")]
    df = spark.createDataFrame([(i, x, "", 0) for i, x in docs], DOCS)
    labels = spark.createDataFrame(list(truth.items())[:180], "doc_id long, toxic int")
    own = [(i, truth[i], x.split()) for i, x in docs[:180]]
    words = sorted({w for _, _, ws in own for w in ws})
    idf = np.array([np.log((1 + len(docs)) / (1 + sum(w in x.split() for _, x in docs))) for w in words]) ** t.IDF_POWER

    def vector(ws, allowed=None):
        c = np.array([ws.count(w) if allowed is None or w in allowed else 0 for w in words], float)
        v = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) * idf
        return v / (np.linalg.norm(v) or 1)

    table = np.array([vector(ws) for _, _, ws in own])
    ids, toxic = np.array([i for i, *_ in own]), np.array([y for _, y, _ in own])

    def near(v, i, k):
        cosines = table @ v
        return sorted((e for e in range(len(own)) if cosines[e] > 0 and ids[e] != i), key=lambda e: (-round(cosines[e], 6), ids[e]))[:k], cosines

    def share(best, cosines):
        w = np.array([1 / (1.02 - min(1, cosines[e])) for e in best])
        return float(w @ toxic[best] / (w.sum() + t.DOUBT)) if best else 0.0

    twice = {w for w in words if sum(w in ws for _, _, ws in own) > 1}
    fits = []
    for k in t.depths(len(own)):
        votes = [share(*near(vector(ws, twice), i, k)) for i, _, ws in own]
        fits.append((*t.calibration(np.array(votes), toxic, toxic.mean()), k))
    slope, offset, _, k = min(fits, key=lambda f: f[2])
    want = {}
    for i, x in docs:
        best, cosines = near(vector(x.split()), i, k)
        p = 1 / (1 + np.exp(-(slope * share(best, cosines) + offset)))
        if best and p >= t.THRESHOLD:
            want[i] = (p, {int(ids[e]) for e in best[: t.EVIDENCE] if cosines[e] > cosines[best[min(len(best), t.EVIDENCE) - 1]] + 1e-5})
    got = {r["doc_id"]: r for r in t.toxic_documents(df, labels).collect()}
    assert got.keys() == want.keys() and len(want) > 20 and 902 not in got
    for i, (p, nearest) in want.items():
        assert abs(got[i]["score"] - p) < 1e-3 and nearest <= {e["example_id"] for e in got[i]["evidence"]}
    # an unlabelled copy of a toxic example has it as evidence
    assert (900 in got) == (3 in got) and all(abs(got[900]["evidence"][0]["cosine"] - 1) < 1e-5 for _ in range(900 in got))


def test_document_frequencies(spark):
    texts = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7 + 1)) + " W0") for i in range(50)] + [(60, "")], "id long, t string").select("id", F.lower("t").alias("t"))
    words = t.Words(np.sort(np.concatenate([h for _, h, _ in t.bags(pa.array([" ".join(f"w{j}" for j in range(9))]))])))
    df, n = t._document_frequencies(texts.repartition(5), words)
    assert n == 51 and sorted(df.tolist()) == sorted([sum(i % 7 >= j for i in range(50)) for j in range(9)])


def test_words_are_found_by_hash():
    rng = np.random.default_rng(4)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 3000, np.uint64), np.arange(40, dtype=np.uint64)]))  # some share their heads
    words = t.Words(hashes)
    asked = np.concatenate([hashes[::7], rng.integers(0, 1 << 63, 500, np.uint64)])
    assert words.find(asked).tolist() == [int(np.searchsorted(hashes, h)) if h in set(hashes.tolist()) else -1 for h in asked.tolist()]
    column = pa.array(["b a b c", "", "zz", "a " * 70_000 + "c"])
    own = t.Words(np.sort(np.concatenate([h for _, h, _ in t.bags(pa.array(["a b c d"]))])))
    name = {int(own.find(h)[0]): w for w in "abcd" for _, h, _ in t.bags(pa.array([w]))}
    assert [(row, {name[d]: c for d, c in zip(dims.tolist(), counts.tolist())}) for row, dims, counts in own.bags(column)] == [(0, {"a": 1, "b": 2, "c": 1}), (3, {"a": 70_000, "c": 1})]


def test_edges(spark):
    docs, truth = corpus(7, 300)
    rows = [*((i, x, "", 0) for i, x in docs), (None, docs[0][1], "", 0), (500, None, "", 0), (501, "", "", 0), (502, "bad1 bad2 bad3 bad1 bad4 " * 40_000, "", 0), (0, docs[0][1], "", 0), (503, "?!", "", 0)]
    df = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([*truth.items(), (None, 1), (3, None), (9999, 1), (500, 1)], "doc_id long, toxic int")
    got = [r["doc_id"] for r in t.toxic_documents(df, labels).collect()]
    assert len(got) == len(set(got)) and 502 in got and not {500, 501, 503, None} & set(got)
    kept = t.drop_toxic(df, labels).collect()
    assert sum(r[0] is None for r in kept) == 1 and {500, 501} <= {r[0] for r in kept}


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1), (2, 1)]])
def test_without_both_classes_nothing_is_toxic(spark, labels):
    df = spark.createDataFrame([(i, "bad word", "", 0) for i in range(4)], DOCS)
    own = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert t.toxic_documents(df, own).count() == 0 and t.drop_toxic(df, own).count() == 4
    assert t.toxic_documents(df.where("false"), own).count() == 0
