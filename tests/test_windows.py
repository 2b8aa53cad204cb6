import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions.hashing import STOP_HASH, coefficients, family_table
from spanloom.operators import index
from spanloom.operators.windows import checked, compact_windows, compact_windows_sql, intersects, merged, stopword_violations

TOY = [5, 3, 9, 3, 7, 1, 5, 8, 2, 6]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, tokens array<int>")


def hashes(tokens, h, stop=()):
    a, b = coefficients(h + 1)
    return [STOP_HASH if x in stop else (a * x + b + 2**31) % 2**32 - 2**31 for x in tokens]


def split(tokens, h, t, stop=()):
    """Recursive split at the leftmost least hash."""
    v, out, todo = hashes(tokens, h, stop), [], [(0, len(tokens) - 1)]
    while todo:
        l, r = todo.pop()  # noqa: E741
        if l + t >= r:
            continue
        c = min(range(l, r + 1), key=lambda i: (v[i], i))
        if v[c] == STOP_HASH:
            continue
        out.append((tokens[c], l, c, r))
        todo += [(l, c - 1), (c + 1, r)]
    return sorted(out)


@pytest.mark.parametrize("t", [1, 3])
def test_toy(spark, t):
    got = sorted((r["token"], r["l"], r["c"], r["r"]) for r in compact_windows(docs_of(spark, [(1, TOY)]), 1, t).collect())
    assert got == sorted([(9, 0, 2, 4), (1, 0, 5, 6), (8, 0, 7, 9)])
    stopped = compact_windows(docs_of(spark, [(1, TOY)]), 1, 3, [1, 3])
    assert sorted(tuple(r)[1:2] + tuple(r)[3:] for r in stopped.collect()) == [(8, 0, 7, 9), (9, 0, 2, 6)]


def test_equals_recursion_and_covers_once(spark):
    rng = random.Random(4)
    rows = [(i, rng.choices(range(rng.choice([5, 40, 1000])), k=rng.choice([0, 1, 3, 20, 90]))) for i in range(60)] + [(900, None), (901, rng.choices(range(30), k=1500))]
    for t, stop in ((0, []), (4, []), (10, [0, 1, 2])):
        by = {}
        for r in compact_windows(docs_of(spark, rows), 3, t, stop).collect():
            by.setdefault((r["doc_id"], r["h"]), []).append((r["token"], r["l"], r["c"], r["r"]))
        for i, tokens in rows:
            for h in range(3):
                own = sorted(by.get((i, h), []))
                assert own == split(tokens or [], h, t, stop)
                if tokens and len(tokens) <= 20:
                    for a in range(len(tokens)):
                        for b in range(a + t + 1, len(tokens)):
                            n = sum(l <= a <= c <= b <= r for _, l, c, r in own)
                            assert n == (0 if all(x in stop for x in tokens[a : b + 1]) else 1)


def test_wanted_lists_and_sql_form(spark):
    rng = random.Random(6)
    docs = docs_of(spark, [(i, rng.choices(range(12), k=40)) for i in range(8)])
    every = sorted(map(tuple, compact_windows(docs, 2, 3).collect()))
    wanted = spark.createDataFrame([(0, 3), (1, 7), (1, 99)], "h int, token int")
    assert sorted(map(tuple, compact_windows(docs, 2, 3, wanted=wanted).collect())) == [w for w in every if w[:2] in {(0, 3), (1, 7)}]
    assert sorted(map(tuple, compact_windows(docs, 2, 3, wanted=wanted, most_wanted=1).collect())) == [w for w in every if w[:2] in {(0, 3), (1, 7)}]
    placed = docs.select("doc_id", F.posexplode("tokens").alias("pos", "token"))
    columns = ["h", "token", "doc_id", "l", "c", "r"]
    assert sorted(map(tuple, compact_windows_sql(placed, family_table(spark, 2), 3).select(columns).collect())) == every
    stop = spark.createDataFrame([(1,), (2,)], "token int")
    own = compact_windows(docs, 2, 3, [1, 2])
    assert sorted(map(tuple, compact_windows_sql(placed, family_table(spark, 2), 3, stop).select(columns).collect())) == sorted(map(tuple, own.collect()))
    assert stopword_violations(own, stop) == 0 and checked(own, stop) is own
    with pytest.raises(ValueError):
        checked(compact_windows(docs, 2, 3), stop)


def test_index_relations(spark):
    rng = random.Random(2)
    docs = docs_of(spark, [(i, rng.choices(range(6), k=60)) for i in range(30)])
    w = compact_windows(docs, 2, 5)
    rows = sorted(map(tuple, w.collect()))
    full = {(r["h"], r["token"]): (r["n"], r["offset"]) for r in index.full_list_index(w, 8, 2).collect()}
    for h in range(2):
        at = 0
        for token in range(8):
            n = sum(r[:2] == (h, token) for r in rows)
            assert full[h, token] == (n, at)
            at += 16 * n
    some = {(r["h"], r["token"]): r["n"] for r in index.list_index(w).collect()}
    assert some == {k: n for k, (n, _) in full.items() if n}
    top = {(r["h"], r["token"]) for r in index.longest_lists(index.full_list_index(w, 8, 2), 3).collect()}
    assert top == {x for h in range(2) for x in sorted(((h, t) for t in range(8)), key=lambda x: (-full[x][0], -x[1]))[:3]}
    assert index.order_violations(w).first()[0] == 0
    docs_in = {(r["h"], r["token"]): r["n_docs"] for r in index.doc_index(w).collect()}
    assert docs_in == {k: len({r[2] for r in rows if r[:2] == k}) for k in some}
    lists = spark.createDataFrame([(0, 1), (1, 3)], "h int, token int")
    assert index.scan_lists(w, lists, spark.createDataFrame([(3,)], "doc_id long")).count() == sum(r[:2] in {(0, 1), (1, 3)} and r[2] == 3 for r in rows)
    assert {tuple(r) for r in index.list_documents(w, lists).collect()} == {r[:3] for r in rows if r[:2] in {(0, 1), (1, 3)}}


def test_zone_map_against_a_walk(spark):
    rng = random.Random(5)
    rows = sorted((rng.randrange(2), rng.randrange(3), rng.randrange(40), 0, c, 9) for c in range(900))
    w = spark.createDataFrame(rows, "h int, token int, doc_id long, l int, c int, r int")
    want, now = [], {}
    for n, (h, token, doc, *_) in enumerate(rows):
        state = now.setdefault((h, token), {"seen": 0, "begun": None, "last": None, "zone": -1})
        if state["zone"] < 0 or (doc != state["last"] and state["seen"] - state["begun"] >= 25):
            state["zone"] += 1
            state["begun"] = state["seen"]
            want.append((h, token, state["zone"], doc, 16 * state["seen"]))
        state["seen"] += 1
        state["last"] = doc
    zones = index.zone_map(w, 25)
    assert sorted(map(tuple, zones.collect())) == sorted(want)
    places = w.select("h", "token", "doc_id").distinct()
    for r in index.zone_of(zones, places).collect():
        assert r["offset"] == max(z[4] for z in want if z[:2] == (r["h"], r["token"]) and z[3] <= r["doc_id"])


def test_intervals(spark):
    got = spark.createDataFrame([(0, 3, 3, 5), (0, 3, 4, 5), (2, 9, 4, 5)], "a int, b int, c int, d int")
    lo, hi = merged(*map(F.col, "abcd"))
    assert [tuple(r) for r in got.select(intersects(*map(F.col, "abcd")), lo, hi).collect()] == [(True, 0, 5), (False, 0, 5), (True, 2, 9)]
