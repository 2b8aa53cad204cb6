import random
from collections import Counter, defaultdict
from statistics import mean

import pytest
import xxhash

from spanloom.llm import mixing

SCHEMA = "doc_id long, source string, n_chars long, copies string"


def docs_of(spark, n, seed=0):
    rng = random.Random(seed)
    return spark.createDataFrame([(i, rng.choice(["a", "a", "a", "b", "c"]), rng.randint(1, 100), "x") for i in range(n)], SCHEMA)


def test_pivot_keeps_sums_and_expectations():
    rng = random.Random(2)
    for _ in range(50):
        units = [(rng.getrandbits(63), rng.choice([rng.random(), 0.5, 0.25, 0.0, 1.0])) for _ in range(rng.randint(0, 30))]
        out, left = mixing.pivot(units, 1)
        total = sum(f for _, f in units)
        assert abs(sum(x for x in out if x > 0) + (left[1] if left else 0) - total) < 1e-6
        assert out.count(-1) == (left is not None)
    units = [(i * 7919, 0.3) for i in range(10)]
    sums = [mixing.pivot(units, s)[0] for s in range(4000)]
    for k in range(9):
        assert abs(mean(max(x[k], 0) for x in sums) - 0.3) < 0.06


def rates_of(rows, weights, alpha=0.5, total=None):
    """Expected copies of a document of each source, from the definition."""
    size = Counter()
    for _, s, x in rows:
        size[s] += x
    whole = sum(size.values()) if total is None else total
    share = {s: x**alpha for s, x in size.items()} if weights is None else {s: weights.get(s, 0.0) for s in size}
    every = (sum(share.values()) if weights is None else sum(weights.values())) or 1.0
    return {s: share[s] / every * whole / size[s] if size[s] else 0.0 for s in size}


M = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_of(*values):
    """Spark's xxhash64 of numbers (int as 4 bytes if marked) and strings, by another implementation."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed=seed)
    return signed(seed)


def chance(x, y, seed):
    z = (x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9 + 0x27D4EB2F165667C5) & M
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & M
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & M
    return ((z ^ (z >> 31)) >> 11) / 2**53


def fight(a, b, seed):
    """Two units [hash, mass, copies]: mass moves until one has none or one; the one that stays open, or None."""
    total, u = a[1] + b[1], chance(a[0], b[0], seed)
    if abs(total - 1) <= 1e-9:
        winner = a if u * total < a[1] else b
        winner[2] += 1
        return None
    if total < 1:
        keep = a if u * total < a[1] else b
    else:
        done = a if u * (2 - total) < 1 - b[1] else b
        done[2] += 1
        keep, total = (b if done is a else a), total - 1
    keep[1] = total
    return keep


def model(rows, weights, seed, leaf, fan):
    """The whole tree, one unit at a time."""
    rates, many, units = rates_of(rows, weights), Counter(s for _, s, _ in rows), {}
    nodes = defaultdict(list)
    for i, s, _ in rows:
        h = hash_of(i, s, (seed,))
        whole = int(rates[s] // 1)
        units[i] = [h, rates[s] - whole, whole]
        nodes[s, hash_of(h) % -(-many[s] // leaf)].append((h, i))
    depth = 0
    while True:
        depth += 1
        left = {}
        for node, own in nodes.items():
            now = None
            for _, i in sorted(own):
                u = units[i]
                if u[1] <= 1e-9 or u[1] >= 1 - 1e-9:
                    u[2] += u[1] > 0.5
                else:
                    now = i if now is None else next((x for x in (now, i) if units[x] is k), None) if (k := fight(units[now], u, seed + depth - 1)) is not None else None
            if now is not None:
                left[node] = now
        if len(left) <= 1:
            for i in left.values():
                units[i][2] += hash_of(i, (seed + depth,)) % 2**53 / 2**53 < units[i][1]
            return {i: u[2] for i, u in units.items()}
        nodes = defaultdict(list)
        top = max(n for _, n in left)
        for (s, n), i in left.items():
            nodes[(s, n // fan) if top > 0 else (None, hash_of(s) % -(-len(left) // fan) if len(left) > fan else 0)].append((units[i][0], i))


@pytest.mark.parametrize(("weights", "seed"), [({"a": 1.0, "b": 3.0, "c": 0.5}, 7), (None, 8), ({"a": 1.0}, 9)])
def test_result_is_that_of_a_sequential_model(spark, weights, seed):
    df = docs_of(spark, 1500, seed)
    rows = [tuple(r)[:3] for r in df.collect()]
    got = {r["doc_id"]: r["copies"] for r in mixing.mixture(df, weights, seed=seed, leaf=64, fan=4).collect()}
    assert got == model(rows, weights, seed, 64, 4)


def test_counts_meet_their_targets(spark):
    df = docs_of(spark, 3000)
    weights = {"a": 1.0, "b": 3.0, "c": 0.5}
    got = mixing.mixture(df, weights, leaf=64, fan=4).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(3000))
    rows = [tuple(r)[:3] for r in df.collect()]
    rate = rates_of(rows, weights)
    have = Counter()
    for r in got:
        have[r["source"]] += r["copies"]
    many = Counter(s for _, s, _ in rows)
    for s, x in rate.items():
        assert abs(have[s] - many[s] * x) < 1 + 1e-6
    assert abs(sum(have.values()) - sum(many[s] * x for s, x in rate.items())) < 1 + 1e-6
    assert all(rate[r["source"]] - 1 < r["copies"] < rate[r["source"]] + 1 for r in got)


def test_weights_and_sizes_out_of_range(spark):
    df = spark.createDataFrame([(1, "a", 10.0), (2, "a", -5.0), (3, "b", float("nan")), (4, "c", 3.0)], "doc_id long, source string, n_chars double")
    assert all(r["copies"] == 0 for r in mixing.mixture(df, {"a": 0.0, "c": 0.0}).collect()) and mixing.mixture(df, {}).selectExpr("sum(copies)").first()[0] == 0
    got = {r["doc_id"]: r["copies"] for r in mixing.mixture(df, {"a": 1.0, "b": 1.0}, total=40.0).collect()}
    assert got == {1: 2, 2: 2, 3: 0, 4: 0}
    for bad in ({"a": -1.0}, {"a": float("nan")}, {"a": float("inf")}):
        with pytest.raises(ValueError):
            mixing.mixture(df, bad)
    with pytest.raises(Exception, match="infinite"):
        mixing.mixture(spark.createDataFrame([(1, "a", float("inf"))], "doc_id long, source string, n_chars double")).count()


def test_same_result_for_any_partitions(spark):
    df = docs_of(spark, 800)
    a = sorted(map(tuple, mixing.mixture(df, leaf=50, fan=3).collect()))
    b = sorted(map(tuple, mixing.mixture(df.repartition(7), leaf=50, fan=3).collect()))
    assert a == b


def test_expectation_over_seeds(spark):
    df = spark.createDataFrame([(i, "a" if i < 6 else "b", 10, "") for i in range(12)], SCHEMA)
    sums = Counter()
    for seed in range(12):
        for r in mixing.mixture(df, {"a": 1.0, "b": 2.0}, seed=seed, leaf=4, fan=2).collect():
            sums[r["source"]] += r["copies"]
    assert abs(sums["a"] - 12 * 4) <= 12 and abs(sums["b"] - 12 * 8) <= 12


def test_edges(spark):
    df = spark.createDataFrame([(1, "a", 10, ""), (1, "a", 10, ""), (2, None, 10, ""), (3, "z", None, ""), (None, "a", 5, ""), (4, "a", 0, "")], SCHEMA)
    got = {(r[0], r[1]): r[2] for r in mixing.mixture(df).collect()}
    assert got.keys() == {(1, "a"), (2, None), (3, "z"), (4, "a")} and got[3, "z"] == 0
    out = mixing.mixed(df, total=1000.0)
    assert out.columns == ["doc_id", "source", "n_chars", "copies"] and dict(out.dtypes)["copies"] == "bigint"
    assert Counter(r[0] for r in out.collect())[1] == 2  # repeated rows share their copies
    assert mixing.mixture(df.where("false")).count() == 0 and mixing.mixed(df.where("false")).count() == 0


@pytest.mark.parametrize("sources", [1, 200])
def test_many_sources(spark, sources):
    df = spark.createDataFrame([(i, f"s{i % sources}", 1 + i % 13, "") for i in range(1000)], SCHEMA)
    got = mixing.mixture(df, leaf=16, fan=4)
    assert got.count() == 1000
    expected = mixing.target_rates(df.selectExpr("doc_id", "source", "cast(n_chars as double) as size")).selectExpr("sum(documents * rate)").first()[0]
    assert abs(got.selectExpr("sum(copies)").first()[0] - expected) < 1 + 1e-6
