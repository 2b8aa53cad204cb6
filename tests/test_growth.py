"""Steps whose cost once grew faster than their input, or that moved windows where sums do: the results by other ways, and what plans and folders hold."""

import os
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from spanloom.config import BuildConfig, SearchConfig
from spanloom.functions import text, whole_texts
from spanloom.operators import index, sweep, windows
from spanloom.operators.windows import compact_windows
from spanloom.plans import match, search, stored
from spanloom.session import fresh_path
from spanloom.sources import segments, tables
from spanloom.streaming import ingest

WINDOW = ["h", "token", "doc_id", "l", "c", "r"]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()))


def docs_of(spark, n=60, words=30, longest=90, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.choices(range(words), k=rng.randint(0, longest))) for i in range(n)], "doc_id long, tokens array<int>")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_whole_texts_have_the_words_of_rows(spark):
    odd = ["", None, "  ", "A b\tC-d", "x\x00y ÄB é.f", "one", " lead", "trail ", "a" * 500 + "!b", "日本 語", "q\x0br\fs t"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(odd)] + [(3, "again b"), (None, "null id"), (None, "two")], "doc_id long, text string")
    placed = text.positions(docs)
    words = text.ranked(whole_texts.word_counts(docs))
    assert rows(words) == rows(text.dictionary(placed))
    want = text.sequences(text.encode(placed, words))
    key = lambda df: sorted((str(r[0]), r[1]) for r in df.collect())
    for head in (0, 3, 1000):
        assert key(whole_texts.sequences(docs, words, head_words=head)) == key(want)
    assert "MapInArrow" in plan(whole_texts.word_counts(docs)) and "Generate" not in plan(whole_texts.word_counts(docs))


def test_sums_of_windows_equal_the_windows(spark):
    docs = docs_of(spark)
    w = compact_windows(docs, 3, 4)
    counts = windows.list_counts(docs, 3, 4)
    assert rows(counts, "h", "token", "n") == rows(w.groupBy("h", "token").count()) and rows(counts, "h", "token", "n_docs") == rows(index.doc_index(w))
    assert rows(windows.width_counts(docs, 3, 4)) == rows(w.groupBy("h", (F.col("r") - F.col("l") + 1).alias("width")).count())
    lists = index.longest_lists(counts, 2)
    assert rows(windows.list_document_counts(docs, 3, 4, lists)) == rows(index.scan_lists(w, lists).groupBy("h", "token", "doc_id").count())
    by = defaultdict(list)
    for h, token, doc, l, c, r in rows(w, *WINDOW):  # noqa: E741
        by[h, token, doc].append((c, l, r))
    want = [(*k, c, l0, r0, l, r) for k, own in by.items() for (_, l0, r0), (c, l, r) in zip(sorted(own), sorted(own)[1:])]  # noqa: E741
    pairs = windows.following_pairs(docs, 3, 4)
    assert rows(pairs) == sorted(want) and want and "Exchange" not in plan(pairs)


def test_offsets_by_blocks(spark, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(index, "BLOCK", 8)
    lists = {(rng.randrange(3), rng.randrange(50)): rng.randint(1, 9) for _ in range(70)}
    counts = spark.createDataFrame([(*k, n) for k, n in lists.items()], "h int, token int, n long")
    want = [(h, t, lists.get((h, t), 0), 16 * sum(n for (g, s), n in lists.items() if g == h and s < t)) for h in range(3) for t in range(51)]
    assert rows(index.full_with_offsets(counts, 51, 3)) == want
    assert rows(index.with_offsets(counts)) == [x for x in want if x[2]]
    docs = counts.withColumnRenamed("n", "n_docs")
    assert rows(index.full_doc_counts(docs, 51, 3)) == [x[:3] for x in want]


def test_zones_over_many_batches(spark):
    rng = random.Random(4)
    lists = [(h, t, d, rng.randint(1, 4)) for h in range(2) for t in range(30) for d in range(rng.choice([1, 2, 300]))]
    want = []
    for h, t in sorted({x[:2] for x in lists}):
        passed, begun, zone = 0, 0, -1
        for *_, d, n in sorted(x for x in lists if x[:2] == (h, t)):
            if zone < 0 or passed - begun >= 7:
                zone, begun = zone + 1, passed
                want.append((h, t, zone, d, 16 * passed))
            passed += n
    counts = spark.createDataFrame(lists, "h int, token int, doc_id long, n long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "13", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            zones = index.zones_of_counts(counts, 7)
            assert rows(zones) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    places = counts.select("h", "token").distinct().crossJoin(spark.createDataFrame([(0,), (5,), (200,)], "doc_id long"))
    found = index.zone_of(zones, places)
    assert rows(found) == sorted((h, t, d, max(z[4] for z in want if z[:2] == (h, t) and z[3] <= d)) for h, t in {x[:2] for x in lists} for d in (0, 5, 200))
    assert "Join" not in plan(index.zone_of(spark.createDataFrame(want, zones.schema), spark.createDataFrame([(0, 1, 2)], "h int, token int, doc_id long")))


def test_search_by_documents_equals_joins(spark):
    docs, k, t = docs_of(spark, 40, 12, 60), 8, 4
    rng = random.Random(5)
    placed = spark.createDataFrame([(q, p, rng.randrange(12)) for q in range(9) for p in range(10)], "query_id long, pos int, token int")
    sig, config = search.least_tokens(placed, k), SearchConfig(k=k, t=t, theta=0.6, prefix_ratio=0.7)
    win = compact_windows(docs, k, t, wanted=sig)
    met = search.met(sig, win)
    q = match.Queries.collect(sig)
    for least in (2, 5):
        kept = search.kept(met, least)
        one, two = match.search_documents(docs, q, k, t, match.best_covers(least)), match.search_documents(docs, q, k, t, match.all_rectangles(least))
        assert rows(one) == rows(sweep.max_cover_sql(kept, least)) and rows(one)
        assert rows(two) == rows(sweep.all_rectangles_sql(kept, least)) and rows(two)
        assert "Exchange" not in plan(one)
    joined = search.exhaustive(sig, win, config)
    ranked = search.ranked_lists(sig, win.groupBy("h", "token").agg(F.count("*").alias("n")))
    first = match.Queries.collect(ranked, config.prefix)
    assert rows(match.search_documents(docs, first, k, t, match.best_of_prefix(config.prefix_matches))) == rows(joined.prefix)
    assert rows(match.search_documents(docs, first, k, t, match.in_lists(config.prefix_matches))) == rows(search.candidates(ranked.where(F.col("place") <= config.prefix), win, config.prefix_matches))
    # tables too large, and few windows at a time
    for name, value in (("_TABLE", 1), ("SWEPT", 3)):
        setattr(match, name, value)
    try:
        own = windows.Docs([r.doc_id for r in docs.collect() if len(r.tokens) > 5], [np.array(r.tokens) for r in docs.collect() if len(r.tokens) > 5], np.zeros(0, np.int64))
        from spanloom.functions.hashing import family

        got = [x for part in match.best_covers(2)[1](q, match._of_batch(own, family(k), t, q), own.ids) for x in zip(*(c.tolist() for c in part))]
        assert sorted(got) == rows(sweep.max_cover_sql(search.kept(met, 2), 2))
    finally:
        match._TABLE, match.SWEPT = 1 << 23, 1 << 18


def test_segments_are_whole_and_in_order(spark):
    docs, path = docs_of(spark, 80), fresh_path(spark, "segments")
    own = rows(compact_windows(docs, 3, 4), *WINDOW)
    for _ in range(2):  # what was there is replaced
        counts = segments.write(docs.repartition(2), 3, 4, path, segment=500)
    assert rows(tables.read_windows(spark, path)) == own and tuple(index.order_violations(spark, path).first()) == (0, len(own))
    assert rows(counts, "h", "token", "n") == rows(compact_windows(docs, 3, 4).groupBy("h", "token").count())
    folder = path.removeprefix("file://")
    assert sorted(os.listdir(folder)) == ["h=0", "h=1", "h=2"] and len(os.listdir(f"{folder}/h=0")) > 4
    files = [spark.read.parquet(f"{path}/h=0/{x}").select("doc_id").distinct() for x in os.listdir(f"{folder}/h=0")]
    assert sum(f.count() for f in files) == len({r[2] for r in own if r[0] == 0})  # no document is in two segments
    lists = index.longest_lists(counts, 2)
    for most in (1, 100):
        assert rows(segments.chosen(tables.read_windows(spark, path), lists, most), *WINDOW) == rows(index.scan_lists(compact_windows(docs, 3, 4), lists), *WINDOW)
    empty = fresh_path(spark, "segments")
    assert segments.write(docs.where("false"), 3, 4, empty).count() == 0 and tables.read_windows(spark, empty).count() == 0


def test_building_an_index_shuffles_no_windows(spark):
    docs = docs_of(spark, 50, 20)
    config = BuildConfig(k=4, t=4, vocabulary=20, zone_interval=5, zone_lists=3)
    own = stored.build(docs, config, fresh_path(spark, "index"))
    w = compact_windows(docs, 4, 4)
    assert rows(own.lists, "h", "token", "n") == rows(w.groupBy("h", "token").count()) and rows(own.zones) == rows(index.zone_map(w, 5, index.longest_lists(index.list_index(w), 3)))
    queries = spark.createDataFrame([(q, p, (7 * q + p) % 20) for q in range(6) for p in range(8)], "item_id long, pos int, token int")
    found = stored.search_stored(own, queries, SearchConfig(k=4, t=4, theta=0.5, prefix_ratio=1.0, chunk=8))
    assert "SortMergeJoin" not in plan(found.matches) and "BroadcastHashJoin" not in plan(found.matches)


def test_epochs_take_one_job_whatever_their_number(spark):
    docs, path = docs_of(spark, 120), fresh_path(spark, "epochs")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("epochs", "")
    segments.write_epochs(ingest.epochs(docs, 2), 3, 4, path)
    assert len(tracker.getJobIdsForGroup("epochs")) < 10
    spark.sparkContext.setJobGroup("other", "")
    assert rows(tables.read_windows(spark, path), *WINDOW) == rows(compact_windows(docs, 3, 4), *WINDOW)
    assert tuple(index.order_violations(spark, path).first())[0] == 0
    assert len([x for x in os.listdir(path.removeprefix("file://")) if x.startswith("epoch=")]) == docs.where(F.size("tokens") > 5).select(F.floor(F.col("doc_id") / 2)).distinct().count()
    # an epoch that is written again replaces itself
    segments.write_epochs(ingest.epochs(docs.where("doc_id in (4, 5)"), 2), 3, 4, path)
    assert rows(tables.read_windows(spark, path), *WINDOW) == rows(compact_windows(docs, 3, 4), *WINDOW)


def test_sweep_of_many_groups_at_once():
    rng = np.random.default_rng(6)
    group = np.sort(rng.integers(0, 40, 900))
    c = rng.integers(0, 200, 900)
    l, r = np.maximum(c - rng.integers(0, 40, 900), 0), c + rng.integers(0, 40, 900)  # noqa: E741
    for least in (1, 3, 6):
        got = list(zip(*(x.tolist() for x in sweep.covers(group, l, c, r, least))))
        want = []
        for g in range(40):
            own = group == g
            for pos in sorted({*l[own].tolist(), *(c[own] + 1).tolist()})[:-1]:
                on = own & (l <= pos) & (pos <= c)
                best = max(((int((on & (c <= y) & (r >= y)).sum()), y) for y in set(r[on].tolist())), default=(0, 0))
                if best[0] >= least:
                    want.append((g, pos, *best))
        assert got == want


def test_integers_by_way_of_texts(spark):
    docs = spark.createDataFrame([(1, [5, 220, -1, 2**31 - 1]), (2, []), (3, [220]), (4, None), (5, [-(2**31), 0])], "doc_id long, tokens array<int>")
    assert rows(whole_texts.by_way_of_texts(docs, 220)) == [(1, 0, 5), (1, 1, -1), (1, 2, 2**31 - 1), (5, 0, -(2**31)), (5, 1, 0)]
    assert "ArrayTransform" not in plan(whole_texts.by_way_of_texts(docs, 220))
