import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.config import SearchConfig
from spanloom.functions.hashing import coefficients
from spanloom.operators import index, sweep
from spanloom.operators.windows import compact_windows
from spanloom.plans import report, search

W = "query_id long, doc_id long, l int, c int, r int"


def hashed(tokens, h):
    a, b = coefficients(h + 1)
    return [(a * x + b + 2**31) % 2**32 - 2**31 for x in tokens]


def corpus(seed, n=14):
    rng = random.Random(seed)
    docs = [(i, rng.choices(range(60), k=rng.randint(15, 45))) for i in range(n)]
    queries = []
    for q in range(8):
        source = list(rng.choice(docs)[1])
        a = rng.randrange(len(source) - 11)
        tokens = source[a : a + 12]
        for _ in range(rng.randrange(3)):
            tokens[rng.randrange(12)] = rng.randrange(60)
        queries.append((q, tokens))
    docs.append((100, queries[0][1] * 2))
    return docs, queries


def frames(spark, docs, queries, k, t):
    placed = spark.createDataFrame(queries, "query_id long, tokens array<int>").select("query_id", F.posexplode("tokens").alias("pos", "token"))
    return search.least_tokens(placed, k), compact_windows(spark.createDataFrame(docs, "doc_id long, tokens array<int>"), k, t)


def brute_rows(rects, least):
    """The sweep by definition: strips of begins, the best cover over all ends, its last end."""
    out = []
    points = sorted({x for l, c, r in rects for x in (l, c + 1)})
    for pos in points[:-1]:
        active = [(c, r) for l, c, r in rects if l <= pos <= c]
        best = max(((sum(c <= y <= r for c, r in active), y) for y in range(max([r for _, r in active], default=0) + 1)), default=(0, 0))
        if active and best[0] >= least:
            out.append((pos, best[0], best[1]))
    return out


def test_golden_sweeps(spark):
    w = spark.createDataFrame([(1, 0, 0, 2, 4), (1, 0, 1, 3, 5), (1, 0, 1, 4, 5)], W)
    rows = lambda df, *c: sorted(tuple(r[x] for x in c) for r in df.collect())
    assert rows(sweep.max_cover(w, 2), "l", "n_collide", "r") == [(1, 3, 4), (3, 2, 5)]
    assert rows(sweep.max_cover(w, 3), "l", "n_collide", "r") == [(1, 3, 4)]
    assert rows(sweep.all_rectangles(w, 2), "l", "r") == [(1, 3), (1, 4), (1, 5), (3, 5)]
    assert rows(sweep.all_rectangles(w, 3), "l", "r") == [(1, 4)]
    assert sweep.covered_area(sweep.all_rectangles(w, 2)).first()["spans"] == 8 and sweep.covered_area(sweep.all_rectangles(w, 3)).first()["spans"] == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_sweeps_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for q in range(4):
        for d in range(4):
            for _ in range(rng.randint(1, 12)):
                c = rng.randint(0, 12)
                rows.append((q, d, rng.randint(0, c), c, rng.randint(c, 16)))
    groups = defaultdict(list)
    for q, d, *w in rows:
        groups[q, d].append(tuple(w))
    df = spark.createDataFrame(rows, W)
    for least in (1, 2, 4):
        for one, other in ((sweep.max_cover, sweep.max_cover_sql), (sweep.all_rectangles, sweep.all_rectangles_sql)):
            a, b = one(df, least), other(df, least)
            assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
        got = defaultdict(list)
        for r in sweep.max_cover(df, least).collect():
            got[r["query_id"], r["doc_id"]].append((r["l"], r["n_collide"], r["r"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: b for k, w in groups.items() if (b := brute_rows(w, least))}
        area = {(r["query_id"], r["doc_id"]): r["spans"] for r in sweep.covered_area(sweep.all_rectangles(df, least)).collect()}
        assert area == {k: n for k, w in groups.items() if (n := sum(sum(l <= i <= c and c <= j <= r for l, c, r in w) >= least for i in range(20) for j in range(20)))}


@pytest.mark.parametrize("seed", [3, 4])
def test_search_finds_all_spans_and_prefix_is_lossless(spark, seed):
    docs, queries = corpus(seed)
    config = SearchConfig(k=10, t=4, theta=0.6, prefix_ratio=0.7)
    sig, win = frames(spark, docs, queries, config.k, config.t)
    signatures = {(r["query_id"], r["h"]): r["token"] for r in sig.collect()}
    for q, tokens in queries:
        for h in range(config.k):
            v = hashed(tokens, h)
            assert signatures[q, h] == tokens[v.index(min(v))]
    want = defaultdict(int)  # best collisions over long spans, by definition of the least hash
    for d, tokens in docs:
        table = [hashed(tokens, h) for h in range(config.k)]
        for i in range(len(tokens)):
            for j in range(i + config.t + 1, len(tokens)):
                least = [tokens[min(range(i, j + 1), key=lambda x: (v[x], x))] for v in table]
                for q, _ in queries:
                    n = sum(least[h] == signatures[q, h] for h in range(config.k))
                    if n >= config.matches:
                        want[q, d] = max(want[q, d], n)
    rows = lambda f: sorted(map(tuple, f.matches.select("query_id", "doc_id", "l", "n_collide", "r").collect()))
    full = rows(search.exhaustive(sig, win, SearchConfig(k=10, t=4, theta=0.6, prefix_ratio=1.0)))
    best = defaultdict(int)
    for q, d, _, n, _ in full:
        best[q, d] = max(best[q, d], n)
    assert best.items() >= want.items() and want
    found = search.exhaustive(sig, win, config)
    assert rows(found) == full
    assert rows(search.exhaustive(sig, win, config, index.doc_index(win), "n_docs")) == full
    assert rows(search.exhaustive(sig, win, config, index.list_index(win))) == full
    # once: the loop over candidates, literally
    prefix = defaultdict(list)
    for r in found.prefix.collect():
        prefix[r["query_id"]].append((r["n_prefix"], r["doc_id"]))
    matched, chosen = {(q, d) for q, d, *_ in full}, set()
    for q, cands in prefix.items():
        hit, top = False, max(cands)[0]
        for n, d in sorted(cands, reverse=True):
            if hit and n < top:
                break
            if (q, d) in matched:
                chosen.add((q, d))
                hit = True
    got = search.once(found)
    assert sorted(map(tuple, got.select("query_id", "doc_id", "l", "n_collide", "r").collect())) == [m for m in full if m[:2] in chosen]
    assert {r["query_id"] for r in search.guarded(sig, index.list_index(win), 10**9).where("allowed").collect()} == {q for q, _ in queries}


def test_impossible_prefix_reads_all_lists(spark):
    docs, queries = corpus(5)
    sig, win = frames(spark, docs, queries, 6, 3)
    a = search.search(sig, win, SearchConfig(k=6, t=3, theta=0.5, prefix_ratio=0.3))
    b = search.search(sig, win, SearchConfig(k=6, t=3, theta=0.5, prefix_ratio=1.0))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert search.search(sig, win.where("false"), SearchConfig(k=6, t=3, theta=0.5)).count() == 0


def test_chunks_and_samples(spark):
    rows = [(i, p, p * 10 + i) for i, n in ((1, 9), (2, 3), (3, 8)) for p in range(n)]
    placed = spark.createDataFrame(rows, "item_id long, pos int, token int")
    got = search.query_chunks(placed, 4).collect()
    assert sorted({(r["item_id"], r["chunk"], r["query_id"]) for r in got}) == [(i, c, (i << 20) + c) for i in (1, 3) for c in (0, 1)]
    assert all(r["token"] == (r["chunk"] * 4 + r["pos"]) * 10 + r["item_id"] for r in got)
    ids = lambda c: sorted({r["item_id"] for r in search.sampled(placed, c).collect()})
    assert ids(SearchConfig(chunk=4)) == [1, 3] and ids(SearchConfig(chunk=4, sample_start=2)) == [3] and ids(SearchConfig(chunk=4, sample_start=1, sample_count=2)) == [1]


def test_reports(spark):
    rng = random.Random(1)
    rows = [(q, d, l, rng.randint(8, 10), l + rng.randint(0, 6)) for q in range(6) for d in range(3) for l in sorted(rng.sample(range(40), rng.randint(1, 6)))]  # noqa: E741
    m = spark.createDataFrame(rows, "query_id long, doc_id long, l int, n_collide int, r int")
    islands = defaultdict(int)
    for q in range(6):
        for d in range(3):
            end = None
            for _, _, l, _, r in sorted(x for x in rows if x[:2] == (q, d)):  # noqa: E741
                if end is None or l > end:
                    islands[q] += 1
                    end = r
                end = max(end, r)
    assert dict(map(tuple, report.passage_count(m).collect())) == islands
    assert sum(r["n_queries"] for r in report.passage_histogram(m).collect()) == 6
    levels = SearchConfig(k=10, theta=0.8).levels()
    best = [max(x[3] for x in rows if x[0] == q) for q in range(6)]
    assert [r["n_queries"] for r in report.similarity_buckets(m, 10, levels).orderBy("level").collect()] == [6, sum(b >= 9 for b in best), sum(b == 10 for b in best)]
    longest = {r["query_id"]: (r["doc_id"], r["l"], r["r"]) for r in report.longest_match(m).collect()}
    for q in range(6):
        assert longest[q] == max(((x[1], x[2], x[4]) for x in rows if x[0] == q), key=lambda x: (x[2] - x[1], x[0], x[1]))
    docs = spark.createDataFrame([(d, list(range(100 * d, 100 * d + 60))) for d in range(3)], "doc_id long, tokens array<int>")
    for r in report.match_passages(report.longest_match(m), docs).collect():
        assert r["passage"] == list(range(100 * r["doc_id"] + r["l"], 100 * r["doc_id"] + r["r"] + 1))
    assert tuple(report.totals(m, m).first()) == (6, 6, len(rows))


def test_a_sweep_of_many_windows():
    import numpy as np

    rng = np.random.default_rng(3)
    c = rng.integers(0, 3000, 400)
    l, r = np.maximum(c - rng.integers(0, 300, 400), 0), c + rng.integers(0, 300, 400)  # noqa: E741
    for least in (3, 20):
        assert sweep.best_covers(l, c, r, least) == brute_rows_fast(l, c, r, least)


def brute_rows_fast(l, c, r, least):  # noqa: E741
    out = []
    for pos in sorted({*l.tolist(), *(c + 1).tolist()})[:-1]:
        own = (l <= pos) & (pos <= c)
        best = max(((int(np_sum), y) for y in set(r[own].tolist()) for np_sum in [((c <= y) & (r >= y) & own).sum()]), default=(0, 0))
        if best[0] >= least:
            out.append((pos, *best))
    return out


def test_search_where_plans_mix_kinds_of_join(spark):
    """Adaptive plans that broadcast one side and sort-merge another, over different numbers of partitions."""
    docs, queries = corpus(8, 40)
    config = SearchConfig(k=10, t=4, theta=0.6, prefix_ratio=0.7)
    rows = []
    for threshold, parts in (("10485760", "4"), ("-1", "7"), ("2000", "13")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            sig, win = frames(spark, docs, queries, config.k, config.t)
            found = search.exhaustive(sig, win.repartition(32), config)
            rows.append((sorted(map(tuple, found.matches.collect())), sorted(map(tuple, search.once(found).collect()))))
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1] == rows[2] and rows[0][0]
