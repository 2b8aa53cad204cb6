import random

import pytest
from pyspark.sql import functions as F

from spanloom.config import BuildConfig, SearchConfig
from spanloom.operators import index
from spanloom.operators.windows import compact_windows
from spanloom.plans import search, stored
from spanloom.session import fresh_path

WINDOW = ["h", "token", "doc_id", "l", "c", "r"]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()))


def corpus(spark, n=60):
    rng = random.Random(2)
    docs = [(i, rng.choices(range(50), k=rng.randint(0, 80))) for i in range(n)]
    queries = [(q, docs[q * 7][1][5:29] + [q]) for q in range(8)]
    placed = spark.createDataFrame(queries, "item_id long, tokens array<int>").select("item_id", F.posexplode("tokens").alias("pos", "token"))
    return spark.createDataFrame(docs, "doc_id long, tokens array<int>"), placed


CONFIG = BuildConfig(k=6, t=4, vocabulary=60, zone_interval=5, zone_lists=4, dataset="x")


def test_build_load_search(spark):
    docs, placed = corpus(spark)
    path = CONFIG.folder(fresh_path(spark, "index"))
    built = stored.build(docs, CONFIG, path)
    again = stored.load(spark, path)
    assert again.config == CONFIG and rows(again.windows) == rows(built.windows) == rows(compact_windows(docs, 6, 4))
    assert rows(again.lists) == rows(index.list_index(built.windows)) and rows(again.documents) == rows(index.doc_index(built.windows))
    longest = index.longest_lists(again.lists, 4)
    assert rows(again.zones) == rows(index.zone_map(built.windows, 5, longest))
    assert rows(again.zones.select("h", "token").distinct()) == rows(longest, "h", "token")
    config = SearchConfig(k=6, t=4, theta=0.6, prefix_ratio=0.7, chunk=8)
    found = rows(stored.search_stored(again, placed, config).matches)
    chunks = search.query_chunks(placed, 8)
    assert found == rows(search.exhaustive(search.least_tokens(chunks, 6), compact_windows(docs, 6, 4), config).matches) and found
    some = rows(stored.search_stored(again, placed, SearchConfig(k=6, t=4, theta=0.6, prefix_ratio=0.7, chunk=8, sample_start=2, sample_count=3)).matches)
    assert some == [r for r in found if 2 <= r[0] >> 20 < 5]
    with pytest.raises(ValueError):
        stored.search_stored(again, placed, SearchConfig(k=7, t=4))
    plan = again.windows.where("h = 1 and token = 3 and doc_id = 9")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(h" in plan and "EqualTo(token,3)" in plan and "EqualTo(doc_id,9)" in plan


def test_doc_limit(spark):
    docs, _ = corpus(spark)
    own = stored.build(docs, CONFIG.with_(doc_limit=20), fresh_path(spark, "index"))
    assert rows(own.windows) == rows(compact_windows(docs.where("doc_id < 20"), 6, 4)) and own.config.doc_limit == 20


def test_grid_counts_every_setting(spark):
    docs, _ = corpus(spark)
    got = {(r.doc_limit, r.k, r.t): r.n_windows for r in stored.grid(docs, [None, 30], [1, 4], [3, 10]).collect()}
    assert got == {(d, k, t): compact_windows(docs if d is None else docs.where(F.col("doc_id") < d), k, t).count() for d in (None, 30) for k in (1, 4) for t in (3, 10)}


def test_scans_of_lists(spark):
    docs, _ = corpus(spark)
    w = compact_windows(docs, 3, 4)
    every = rows(w, *WINDOW)
    lists = index.longest_lists(index.list_index(w), 2)
    keys = {(r.h, r.token) for r in lists.collect()}
    assert rows(index.scan_lists(w, lists), *WINDOW) == [r for r in every if r[:2] in keys]
    asked = spark.createDataFrame([(3,), (9,), (9,)], "doc_id long")
    assert rows(index.scan_lists(w, lists, asked), *WINDOW) == [r for r in every if r[:2] in keys and r[2] in (3, 9)]
    for h, token, doc, n, offset in rows(index.doc_offsets(w, lists)):
        own = [r for r in every if r[:2] == (h, token)]
        assert n == sum(r[2] == doc for r in own) and offset == 16 * sum(r[2] < doc for r in own)
    full = rows(index.full_doc_index(w, 60, 3))
    assert len(full) == 180 and all(n == len({r[2] for r in every if r[:2] == (h, token)}) for h, token, n in full)
    zones = index.zone_map(w, 5, lists)
    assert {r[:2] for r in rows(index.in_zone_map(zones, index.list_index(w))) if r[2]} == keys
    places = lists.select("h", "token").crossJoin(asked.distinct())
    starts = rows(zones, "h", "token", "doc_id", "offset")
    want = sorted((h, t, d, max(o for a, b, first, o in starts if (a, b) == (h, t) and first <= d)) for h, t in keys for d in (3, 9) if any((a, b) == (h, t) and first <= d for a, b, first, _ in starts))
    assert rows(index.zone_of(zones, places), "h", "token", "doc_id", "offset") == want
