"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree.

Source s is to fill the share w_s of the mixture's size, so each of its documents gets expected copies w_s * total / size_s:
a whole part, and a fraction to be rounded. Pivotal rounding takes two fractions at a time and moves mass between them at
random until one is integral, which keeps every document's expectation and the sum of each set exactly. Leaves of about
`leaf` documents of one source are rounded side by side; each leaves one fraction, which are combined `fan` at a time, first
within their source, then across sources, until one is left for a single draw. Counts of a source so miss their
expectation by less than 1, and so does the total.

All draws come from hashes of ids and the seed: a task that runs again draws the same, whatever the partitions.

Defined results: null ids are left out; a null source is a source of its own; null, negative and NaN sizes count 0, infinite ones are an error, and a source without size
gets no copies; weights are numbers of 0 and more (else an error), all of them 0 give no copies; rows that share id and source are one unit (sizes added) and get the same
copies; units of a leaf are rounded in the order of a hash, equal hashes in that of ids; texts are not read, however long; other columns are ignored, whatever their
names; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import small, store, trimmed, unused

LEAF = 8192
FAN = 64
SEED = 20240501
ALPHA = 0.5
_EPS = 1e-9
_MASK = (1 << 64) - 1


def draw(x: int, y: int, seed: int) -> float:
    """A number in [0, 1) from two hashes and the seed."""
    z = (x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9 + 0x27D4EB2F165667C5) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return ((z ^ (z >> 31)) >> 11) / (1 << 53)


def pivot(units: list[tuple[int, float]], seed: int) -> tuple[list[int], tuple[int, float] | None]:
    """Rounds (hash, fraction) units in order: for each 0, 1 or -1 (not yet decided), and (position, fraction) of the undecided one."""
    out = [0] * len(units)
    at, mass = -1, 0.0
    for i, (h, f) in enumerate(units):
        if f <= _EPS or f >= 1 - _EPS:
            out[i] = int(f > 0.5)
            continue
        if at < 0:
            at, mass = i, f
            continue
        total, u = mass + f, draw(units[at][0], h, seed)
        if total < 1 - _EPS:
            if u * total < mass:  # the mass of the later one goes to the earlier
                out[i], mass = 0, total
            else:
                out[at], at, mass = 0, i, total
        elif total <= 1 + _EPS:
            first = u * total < mass
            out[at], out[i], at = int(first), int(not first), -1
        elif u * (2 - total) < 1 - f:
            out[at], at, mass = 1, i, total - 1
        else:
            out[i], mass = 1, total - 1
    if at < 0:
        return out, None
    out[at] = -1
    return out, (at, mass)


def _round(groups: DataFrame, seed: int) -> DataFrame:
    """groups(source, node, id, whole, h, fraction) -> (source, node, id, h, whole, fraction): rounded by node; fraction is null once decided."""

    def run(batches: pa.Table) -> pa.Table:
        t = batches.sort_by([("h", "ascending"), ("id", "ascending")])
        decided, left = pivot(list(zip(t["h"].to_pylist(), t["fraction"].to_pylist())), seed)
        whole = np.asarray(t["whole"]) + np.maximum(np.array(decided, np.int64), 0)
        fraction = [None] * len(decided)
        if left:
            fraction[left[0]] = left[1]
        return pa.table({"source": t["source"], "node": t["node"], "id": t["id"], "h": t["h"], "whole": pa.array(whole), "fraction": pa.array(fraction, pa.float64())})

    return groups.groupBy("source", "node").applyInArrow(run, "source string, node long, id long, h long, whole long, fraction double")


def target_rates(units: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, total: float | None = None) -> DataFrame:
    """(source, documents, size, rate): rate is the expected copies of each document of the source.

    weights: share of each source (of 1 together, or scaled to it; absent sources get 0); without them, size ** alpha, scaled.
    total: size of the mixture; without it, that of all sources.
    """
    if weights is not None and not all(isinstance(v, (int, float)) and 0 <= v < float("inf") for v in weights.values()):
        raise ValueError("weights must be numbers of 0 and more")
    if total is not None and not 0 <= total < float("inf"):
        raise ValueError("total must be a number of 0 and more")
    sizes = units.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("size"))
    if weights is None:
        share: Column = F.pow(F.col("size"), F.lit(alpha))
        sums = sizes.agg(F.sum("size").alias("all_size"), F.sum(share).alias("all_share"))
    else:
        sum_w = float(sum(weights.values())) or 1.0
        named = sizes.sparkSession.createDataFrame([(k, float(v) / sum_w) for k, v in weights.items()] or [("", 0.0)], "name string, w double")
        sizes = sizes.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name")), "left").drop("name")
        share = F.coalesce("w", F.lit(0.0))
        sums = sizes.agg(F.sum("size").alias("all_size"), F.lit(1.0).alias("all_share"))
    whole = F.lit(float(total)) if total is not None else F.col("all_size")
    rate = F.when(F.col("size") > 0, share / F.col("all_share") * whole / F.col("size")).otherwise(0.0)
    return sizes.crossJoin(F.broadcast(sums)).select("source", "documents", "size", rate.alias("rate"))


def _size(column: Column) -> Column:
    x = F.nanvl(F.coalesce(column.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(x == float("inf"), F.raise_error(F.lit("a size is infinite")).cast("double")).otherwise(F.greatest(x, F.lit(0.0)))


def mixture(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars", alpha: float = ALPHA, total: float | None = None, seed: int = SEED, leaf: int = LEAF, fan: int = FAN) -> DataFrame:
    """Rows (doc_id, source, copies) of every document: how often it is in the mixture, 0 included."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), _size(F.col(size_col)).alias("size")).where("id is not null")
    units = store(rows.groupBy("id", "source").agg(F.sum("size").alias("size")), "units")
    rates = store(target_rates(units, weights, alpha, total).withColumnRenamed("source", "name").drop("size"), "rates")
    rated = units.join(small(rates, rates.count()), F.col("source").eqNullSafe(F.col("name")))
    h = F.xxhash64("id", "source", F.lit(seed))
    nodes = F.ceil(F.col("documents") / F.lit(leaf))
    level = _round(rated.select("source", F.pmod(F.xxhash64(h), nodes).alias("node"), "id", h.alias("h"), F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("fraction")), seed)
    done, depth = [], 0
    while True:
        depth += 1
        level = store(level, "level")
        done.append(level.where("fraction is null").select("id", "source", "whole"))
        left = level.where("fraction is not null")
        open_nodes, most = left.agg(F.count("*"), F.coalesce(F.max("node"), F.lit(0))).first()
        if open_nodes <= 1:
            break
        parent = F.floor(F.col("node") / F.lit(fan))
        if most > 0:  # within each source
            level = _round(left.withColumn("node", parent), seed + depth)
        elif open_nodes > fan:  # across sources, fan of them at a time
            ranks = F.pmod(F.xxhash64("source"), F.lit(-(-open_nodes // fan)))
            level = _joined(left, ranks, seed + depth)
        else:
            level = _joined(left, F.lit(0).cast("long"), seed + depth)
    done.append(left.select("id", "source", (F.col("whole") + F.when(F.pmod(F.xxhash64("id", F.lit(seed + depth)), F.lit(1 << 53)) / F.lit(float(1 << 53)) < F.col("fraction"), 1).otherwise(0)).alias("whole")))
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    return out.select(F.col("id").alias("doc_id"), "source", F.col("whole").alias("copies"))


def _joined(left: DataFrame, node: Column, seed: int) -> DataFrame:
    """_round across sources: the source travels along and the node alone groups."""
    schema = "source string, node long, id long, h long, whole long, fraction double"

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("id", "ascending")])
        decided, rest = pivot(list(zip(t["h"].to_pylist(), t["fraction"].to_pylist())), seed)
        fraction = [None] * len(decided)
        if rest:
            fraction[rest[0]] = rest[1]
        return pa.table({"source": t["source"], "node": pa.array(np.zeros(len(decided), np.int64)), "id": t["id"], "h": t["h"], "whole": pa.array(np.asarray(t["whole"]) + np.maximum(np.array(decided, np.int64), 0)), "fraction": pa.array(fraction, pa.float64())})

    return left.select("source", node.alias("node"), "id", "h", "whole", "fraction").groupBy("node").applyInArrow(run, schema)


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars", **options) -> DataFrame:
    """The documents that are in the mixture at all, with all their columns and how often, as `copies` (which replaces a column of that name)."""
    plan = mixture(docs, weights, id_col, source_col, size_col, **options).where("copies > 0")
    i, s = unused(docs, "unit_id"), unused(docs, "unit_source")
    plan = store(plan.select(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("copies")), "mixture")
    kept = docs.select(*(c for c in docs.columns if c.lower() != "copies"))
    on = (kept[id_col].cast("long") == plan[i]) & kept[source_col].cast("string").eqNullSafe(plan[s])
    return kept.join(small(plan, plan.count()), on).select(*(kept[c] for c in kept.columns), "copies")
