"""Exact dedup, SimHash and substring dedup against brute force."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup, queries, simhash, substring_dedup

SCHEMA = "doc_id long, text string, keep_id long, source string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 7, "s") for i, t in rows], SCHEMA)


ROWS = [(1, "a b"), (2, "a b"), (3, None), (None, "a b"), (4, ""), (5, ""), (6, "A b"), (2, "a b"), (7, "x" * 300_000), (8, "x" * 300_000), (9, None), (2, "other")]


def test_exact_pairs(spark):
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs_of(spark, ROWS)).collect())) == [(2, 1), (5, 4), (8, 7)]


def test_exact_drop_keeps_rows_and_columns(spark):
    got = exact_dedup.drop_exact_duplicates(docs_of(spark, ROWS))
    assert got.columns == ["doc_id", "text", "keep_id", "source"]
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted([(1, "a b"), (3, None), (None, "a b"), (4, ""), (6, "A b"), (7, "x" * 300_000), (9, None), (2, "other")], key=str)


def test_exact_collisions_are_told_apart(spark):
    # a digest under which everything collides
    digest = lambda c: F.substring(F.md5(c), 1, 0)
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c")]
    assert sorted(map(tuple, exact_dedup.exact_duplicates(docs_of(spark, rows), digest=digest).collect())) == [(3, 1), (4, 2)]
    assert sorted(r[0] for r in exact_dedup.drop_exact_duplicates(docs_of(spark, rows), digest=digest).collect()) == [1, 2, 5]


def test_exact_repeated_rows_without_copies(spark):
    rows = [(1, "a"), (1, "a"), (2, "b")]
    assert exact_dedup.exact_duplicates(docs_of(spark, rows)).count() == 0
    assert sorted(r[0] for r in exact_dedup.drop_exact_duplicates(docs_of(spark, rows)).collect()) == [1, 2]


def test_exact_drop_goes_by_row_not_by_id(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (4, "c")]
    assert sorted((r[0], r[1]) for r in exact_dedup.drop_exact_duplicates(docs_of(spark, rows)).collect()) == [(1, "a"), (2, "b"), (4, "c")]


@pytest.mark.parametrize("operator", [exact_dedup.exact_duplicates, exact_dedup.drop_exact_duplicates, simhash.near_duplicates, simhash.drop_near_duplicates, substring_dedup.repeats])
def test_empty_table(spark, operator):
    assert operator(docs_of(spark, [])).count() == 0


def near_corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(60, 400))
        rows.append(words)
        for _ in range(rng.choice([0, 0, 1, 3])):
            other = list(words)
            for _ in range(max(1, int(len(words) * rng.uniform(0.01, 0.08)))):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            rows.append(other)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def brute_near(rows, radius=simhash.RADIUS, word_bits=32):
    """All pairs of texts by definition, from fingerprints of its own: hashes of words by blake2b wouldn't do, since a fingerprint is its hash."""
    texts = [(i, t.lower().encode()) for i, t in rows if t]
    data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
    kept, prints = simhash.fingerprints_of(data, np.cumsum([0, *(len(t) for _, t in texts)]))
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    ids = [texts[k][0] for k in kept]
    out = {}
    for (x, a), (y, b) in combinations(enumerate(ids), 2):
        differ = bits[x] != bits[y]
        if a != b and differ.sum() <= radius and differ.reshape(-1, word_bits).sum(axis=1).min() <= simhash.BALL:
            pair = (min(a, b), max(a, b))
            out[pair] = min(int(differ.sum()), out.get(pair, 999))
    return out


def linked(rows, links):
    """All pairs that the rows (representatives, members) stand for, with their distances."""
    texts = [(i, t.lower().encode()) for i, t in rows if t]
    data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
    kept, prints = simhash.fingerprints_of(data, np.cumsum([0, *(len(t) for _, t in texts)]))
    members = defaultdict(set)
    for k, p in zip(kept, prints):
        members[p.tobytes()].add(texts[k][0])
    out = {}
    for key, ids in members.items():
        assert all((min(ids), i) in links and links[min(ids), i] == 0 for i in ids - {min(ids)})
        out.update({p: 0 for p in combinations(sorted(ids), 2)})
    roots = defaultdict(list)
    for ids in members.values():
        roots[min(ids)].append(ids)
    for (a, b), d in links.items():
        for x in roots.get(a, []):
            for y in roots.get(b, []):
                for i in x:
                    for j in y:
                        if i != j:
                            pair = (min(i, j), max(i, j))
                            out[pair] = min(d, out.get(pair, 999))
    return out


@pytest.mark.parametrize("word_bits", [32, 64])
def test_simhash_finds_all_near_duplicates(spark, word_bits):
    rows = near_corpus(5)
    got = {(r[0], r[1]): r[2] for r in simhash.near_duplicates(docs_of(spark, rows), word_bits=word_bits).collect()}
    want = brute_near(rows, word_bits=word_bits)
    assert got == want and len(want) > (40 if word_bits == 32 else 5)


def test_simhash_relation_holds_edited_copies():
    rows = near_corpus(5)
    want = brute_near(rows)
    words = [set(t.split()) for _, t in rows]
    near = {(a, b) for a, b in combinations(range(len(rows)), 2) if len(words[a] & words[b]) >= 0.9 * len(words[a] | words[b])}
    assert len(near & want.keys()) >= 0.95 * len(near) > 20
    assert all(len(words[a] & words[b]) > 0.5 * len(words[a] | words[b]) for a, b in want)


def test_simhash_edges(spark):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(1, text), (2, text.upper()), (3, None), (4, ""), (5, "!!! ..."), (None, text), (1, text), (6, "word " * 50_000), (7, "word"), (9, text)]
    got = sorted(map(tuple, simhash.near_duplicates(docs_of(spark, rows)).collect()))
    assert got == [(1, 2, 0), (1, 9, 0), (6, 7, 0)]
    kept = sorted((r[0] for r in simhash.drop_near_duplicates(docs_of(spark, rows)).collect()), key=str)
    assert kept == sorted([1, 1, 3, 4, 5, 6, None], key=str)


def test_simhash_copies_are_members(spark):
    rng = random.Random(4)
    rows = near_corpus(6, 20)
    rows += [(len(rows) + k, " ".join(rng.sample(t.split(), len(t.split()))).upper()) for k, (_, t) in enumerate(rows * 2)]  # reordered copies: equal fingerprints
    got = {(a, b): d for a, b, d in map(tuple, simhash.near_duplicates(docs_of(spark, rows)).collect())}
    want = brute_near(rows)
    assert linked(rows, got) == want and len(got) < len(want)


def test_simhash_groups_and_links(spark):
    rng = random.Random(8)
    rows = near_corpus(7, 30)
    rows += [(len(rows) + k, " ".join(rng.sample(t.split(), len(t.split()))).upper()) for k, (_, t) in enumerate(rows[:25] * 3)]
    rows += [(9000, None), (9001, ""), (None, rows[0][1]), (rows[3][0], rows[3][1])]
    pairs = brute_near([r for r in rows[:-1] if r[0] is not None])
    links, root = defaultdict(int), {}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = sorted(map(tuple, simhash.near_groups(docs_of(spark, rows)).collect()))
    assert got == sorted((i, root[i], links[i]) for i in links) and len(got) > 60
    assert simhash.near_groups(docs_of(spark, [])).count() == 0


def brute_within(rows, radius=simhash.RADIUS):
    """All pairs of ids whose fingerprints differ in at most radius bits, whatever their words."""
    texts = [(i, t.lower().encode()) for i, t in rows if i is not None and t]
    data = np.frombuffer(b"".join(t for _, t in texts), np.uint8)
    kept, prints = simhash.fingerprints_of(data, np.cumsum([0, *(len(t) for _, t in texts)]))
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    return {(min(a, b), max(a, b)) for (x, a), (y, b) in combinations([(k, texts[k][0]) for k in kept], 2) if a != b and (bits[x] != bits[y]).sum() <= radius}


def groups_of(pairs):
    links, root = defaultdict(int), {}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return sorted((i, root[i], links[i]) for i in links)


@pytest.mark.parametrize("block", [simhash.BLOCK, 30, 1])
def test_simhash_groups_hold_every_pair_within_the_radius(spark, monkeypatch, block):
    rows = near_corpus(31, 12 if block == 1 else 30)
    rows += [(1000 + i, t.upper()) for i, t in rows[:12]]
    pairs, narrow = brute_within(rows), brute_near(rows)
    assert narrow.keys() < pairs  # some pairs within the radius have no word within two bits
    monkeypatch.setattr(simhash, "BLOCK", block)
    assert sorted(map(tuple, simhash.near_groups(docs_of(spark, rows)).collect())) == groups_of(pairs)
    got = {(r[0], r[1]): r[2] for r in simhash.near_duplicates(docs_of(spark, rows), word_bits=None).collect()}
    assert linked(rows, got).keys() == pairs


@pytest.mark.parametrize("radius", [-1, 0, 4, 35, 84, 110, 150])
def test_simhash_search_by_chunks(radius):
    rng = np.random.default_rng(radius + 1)
    prints = rng.integers(0, 1 << 63, (220, 6), dtype=np.uint64) | rng.integers(0, 2, (220, 6), dtype=np.uint64) << np.uint64(63)
    bits = np.unpackbits(prints.view(np.uint8), axis=1)
    for k in range(100):  # pairs about the radius, their differences spread evenly or at random; one chunk in common by many
        n = max(0, radius + k % 3 - 1)
        bits[k + 100] = bits[k]
        bits[k + 100, np.arange(n) * 384 // max(1, n) if k % 2 else rng.choice(384, n, replace=False)] ^= 1
    bits[60:90, :16] = bits[0, :16]
    prints = np.packbits(bits, axis=1).view(np.uint64)
    differ = (bits[:, None] != bits[None]).sum(axis=2)
    for x, y in ((prints, None), (prints[:130], prints[130:]), (prints[:0], prints), (prints, prints[:0])):
        found = [(a, b, d) for share in range(5) for some in simhash._within(x, y, list(range(share, 24, 5)), radius) for a, b, d in zip(*(v.tolist() for v in some))]
        if y is None:
            found = [(min(a, b), max(a, b), d) for a, b, d in found]
        want = [(a, b, differ[a, b]) for a in range(220) for b in range(a + 1, 220) if differ[a, b] <= radius]
        if y is not None:
            want = [(a, b - len(x), d) for a, b, d in want if a < len(x) <= b] if len(x) and len(y) else []
        assert sorted(found) == sorted(want)


def test_simhash_large_buckets():
    groups = np.arange(2 * 1500).reshape(2, 1500)
    assert sum(len(x) for x, _ in simhash._groups_pairs(groups)) == 1500 * 1499


def test_words_never_span_texts():
    data = np.frombuffer(b"abcabc", np.uint8)
    hashes, at = simhash.word_hashes(data, np.array([0, 3, 6]))
    assert at.tolist() == [0, 1, 2] and hashes[0] == hashes[1]
    hashes, at = simhash.word_hashes(data, np.array([0, 0, 3, 3, 3, 6, 6]))
    assert at.tolist() == [0, 0, 1, 1, 1, 2, 2] and hashes[0] == hashes[1] and len(hashes) == 2
    begins, ends, at = substring_dedup.word_ranges(data, np.array([0, 3, 3, 3, 6]))
    assert begins.tolist() == [0, 3] and ends.tolist() == [3, 6] and at.tolist() == [0, 1, 1, 1, 2]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2001 + i) for i in range(50)]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = simhash.components(spark.createDataFrame(pairs, "doc_a long, doc_b long"))
    assert dict(map(tuple, got.collect())) == root


def repeat_corpus(seed):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(80)]
    make = lambda n: rng.choices(words, k=n)
    passages = [make(70), make(52), make(120)]
    rows = []
    for i in range(40):
        t = make(rng.randint(0, 150))
        for p in passages:
            if rng.random() < 0.35:
                k = rng.randint(0, len(t))
                t = t[:k] + p + t[k:]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(t)))
    return rows + [(100, "a " * 200), (101, "b c d " * 60 + "x"), (102, rows[4][1]), (103, None), (104, ""), (None, rows[4][1]), (105, "z " * 49), (102, rows[4][1])]


def brute_cover(rows, least=50):
    texts = {i: (t or "").split() for i, t in rows if i is not None}
    places = defaultdict(set)
    for i, t in texts.items():
        for j in range(len(t) - least + 1):
            places[tuple(t[j : j + least])].add((i, j))
    return texts, {(i, k) for at in places.values() if len(at) > 1 for i, j in at for k in range(j, j + least)}


@pytest.mark.parametrize(("seed", "bits"), [(1, 64), (2, 64), (3, 64), (1, 8), (2, 3), (3, 0)])
def test_repeats_cover_what_brute_force_finds(spark, seed, bits):
    """With few bits of hash, or none, nearly all windows meet others than their equals, and still every repeat is found."""
    rows = repeat_corpus(seed)
    texts, want = brute_cover(rows)
    cover = set()
    for r in substring_dedup.repeats(docs_of(spark, rows), bits=bits).collect():
        a, b = texts[r.doc_id], texts[r.ref_id]
        assert a[r.start : r.start + r.words] == b[r.ref_start : r.ref_start + r.words] and r.words >= 50
        assert (r.doc_id, r.start) != (r.ref_id, r.ref_start)
        # maximal: neither side can be longer
        assert not (r.start and r.ref_start and a[r.start - 1] == b[r.ref_start - 1])
        assert r.start + r.words == len(a) or r.ref_start + r.words == len(b) or a[r.start + r.words] != b[r.ref_start + r.words]
        cover |= {(r.doc_id, r.start + k) for k in range(r.words)}
    assert cover == want


def test_repeats_of_long_texts_and_popular_references(spark):
    rng = random.Random(9)
    make = lambda n: rng.choices([f"u{i}" for i in range(5000)], k=n)
    passage, long = make(60), make(30_000)
    rows = [(0, " ".join(long + passage + make(200))), (1, " ".join(make(40) + long[20_000:] + make(10)))]
    rows += [(i, " ".join(make(20) + passage + make(20))) for i in range(2, 700)]  # more than one group of requests for one reference
    every = substring_dedup.repeats(docs_of(spark, rows)).collect()
    got = [r for r in every if not r.first]
    assert {r.doc_id for r in every if r.first} == {r.ref_id for r in got} and all((r.ref_id, r.ref_start, r.words, r.doc_id, r.start) in {tuple(x)[:5] for x in got} for r in every if r.first)
    assert {r.doc_id for r in got if r.words >= 60 and r.ref_id == 0} == set(range(1, 700))
    assert max(r.words for r in got if r.doc_id == 1) == 10_000
    assert sum(r.ref_id == 0 for r in got) == 699 and len(got) < 3 * 699  # besides, some share the next word by chance


def test_repeats_of_an_id_with_differing_texts(spark):
    text = " ".join(f"v{i}" for i in range(80))
    rows = [(1, text), (1, "zz " + text), (2, text)]
    got = [(r.doc_id, r.ref_id, r.words) for r in substring_dedup.repeats(docs_of(spark, rows)).collect() if not r.first]
    assert got == [(2, 1, 80)]


def test_repeats_needs_room_for_a_block(spark):
    with pytest.raises(ValueError):
        substring_dedup.repeats(docs_of(spark, []), least=40, block=25)
