"""Sweeps over rectangles: windows (query_id, doc_id, l, c, r) as [l, c] x [c, r] in (begin, end) space.

A strip is the begins between two that follow each other of all l and c + 1 of a (query, document). All strips of many such groups are swept
at once in numpy: those over which enough windows lie get a column each of a table of their windows, in which ends are compared with all others.
One exchange brings the windows of a group together where they aren't yet. The same as joins and window functions is in
max_cover_sql and all_rectangles_sql, for checks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["query_id", "doc_id"]
#: Cells of a table of strips that are compared at once.
CELLS = 1 << 21
#: Windows that are gathered before they are swept.
GATHERED = 1 << 17
_FAR = np.iinfo(np.int32).max


def _strips(group: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, ...]]:  # noqa: E741
    """(group, begin, next begin, c, r) of strips over which at least `least` windows lie: c and r are tables of (window, strip), where a place
    that has no window holds (_FAR, -1). group: small numbers, of one group or several."""
    if not len(l):
        return
    bits = int(c.max() + 1).bit_length()
    base = group.astype(np.int64) << bits
    points = np.sort(np.concatenate([base | l, base | (c + 1)]))
    points = points[np.flatnonzero(np.diff(points, prepend=-1))]
    begin, end = np.searchsorted(points, base | l), np.searchsorted(points, base | (c + 1))
    active = np.cumsum(np.bincount(begin, minlength=len(points)) - np.bincount(end, minlength=len(points)))
    good = active >= max(least, 1)
    before = np.concatenate([[0], np.cumsum(good)])
    begin, end = before[begin], before[end]
    own = np.flatnonzero(good)
    if not len(own):
        return
    n = end - begin
    window = np.repeat(np.arange(len(l)), n)
    strip = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
    window = window[np.argsort(strip, kind="stable")]
    active = active[own]
    ends = np.cumsum(active)
    by_size = np.argsort(active, kind="stable")
    at = 0
    while at < len(own):
        # strips of about as many windows
        most = int(active[by_size[at]])
        last = int(np.searchsorted(active[by_size], most + most // 8, side="right"))
        some = by_size[at : min(last, at + max(1, CELLS // most))]
        at += len(some)
        most = int(active[some].max())
        slot = np.arange(most)[:, None]
        there = slot < active[some]
        of = window[np.where(there, (ends - active)[some] + slot, 0)]
        p = own[some]
        yield points[p] >> bits, points[p] & ((1 << bits) - 1), points[p + 1] & ((1 << bits) - 1), np.where(there, c[of], _FAR), np.where(there, r[of], -1)


def covers(group: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray, least: int) -> tuple[np.ndarray, ...]:  # noqa: E741
    """(group, begin of a strip, greatest cover, last end that has it), where the cover is at least `least`; ordered by group and begin."""
    out = [[], [], [], []]
    for g, pos, _, cs, rs in _strips(group, l, c, r, least):
        best = np.zeros(len(pos), np.int64)
        for y in rs:
            n = np.zeros(len(pos), np.int32)
            for a, b in zip(cs, rs):
                n += (a <= y) & (b >= y)
            best = np.maximum(best, np.where(y >= 0, (n.astype(np.int64) << 32) | np.maximum(y, 0), 0))
        keep = (best >> 32) >= max(least, 1)
        for x, v in zip(out, (g, pos, best >> 32, best & 0xFFFFFFFF)):
            x.append(v[keep])
    return _in_order(out)


def rectangles(group: np.ndarray, l: np.ndarray, c: np.ndarray, r: np.ndarray, least: int) -> tuple[np.ndarray, ...]:  # noqa: E741
    """(group, begin, last end, cover, spans) of every cell of begins and ends over which at least `least` windows lie."""
    out = [[], [], [], [], []]
    for g, pos, nx, cs, rs in _strips(group, l, c, r, least):
        far = cs == _FAR
        # ends where a window begins to count (1) or no longer does (0), in order
        events = np.sort(np.concatenate([np.where(far, 1 << 40, (cs.astype(np.int64) << 1) | 1), np.where(far, 1 << 40, (rs.astype(np.int64) + 1) << 1)]), axis=0)
        y, n = events >> 1, np.cumsum(2 * (events & 1) - 1, axis=0)
        i, s = np.nonzero((n[:-1] >= max(least, 1)) & (y[1:] > y[:-1]) & (y[1:] < 1 << 39))
        for x, v in zip(out, (g[s], pos[s], y[i + 1, s] - 1, n[i, s], (nx[s] - pos[s]) * (y[i + 1, s] - y[i, s]))):
            x.append(v)
    return _in_order(out)


def _in_order(out: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
    order = np.lexsort(columns[2::-1] if len(columns) == 5 else columns[1::-1])
    return tuple(x[order] for x in columns)


def best_covers(l: np.ndarray, c: np.ndarray, r: np.ndarray, least: int) -> list[tuple[int, int, int]]:  # noqa: E741
    """covers of one group."""
    return list(zip(*(x.tolist() for x in covers(np.zeros(len(l), np.int64), np.asarray(l), np.asarray(c), np.asarray(r), least)[1:])))


def _swept(windows: DataFrame, least: int, sweep: Callable, schema: str, names: list[str], types: list) -> DataFrame:
    def swept(q: np.ndarray, d: np.ndarray, places: list[np.ndarray]) -> pa.RecordBatch:
        new = np.concatenate([[True], (q[1:] != q[:-1]) | (d[1:] != d[:-1])])
        first = np.flatnonzero(new)
        group, *rest = sweep(np.cumsum(new) - 1, *places, least)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((q[first[group]], d[first[group]], *rest), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([np.asarray(batch.column(k)).astype(np.int64) for k in range(5)])
            size += batch.num_rows
            if size >= GATHERED:
                rows = [np.concatenate(x) for x in zip(*held)]
                # the last group may go on
                cut = int(np.flatnonzero(np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]))[-1])
                if cut:
                    yield swept(rows[0][:cut], rows[1][:cut], [x[:cut] for x in rows[2:]])
                held, size = [[x[cut:] for x in rows]], 0 if cut else size // 2
        if held:
            rows = [np.concatenate(x) for x in zip(*held)]
            yield swept(rows[0], rows[1], rows[2:])

    own = windows.select(*KEY, "l", "c", "r").where("query_id is not null and doc_id is not null")
    return own.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(run, schema)


def max_cover(windows: DataFrame, least: int) -> DataFrame:
    """(query_id, doc_id, l, n_collide, r): for each strip of begins the greatest number of windows over one end, if at least
    `least`, and the last end that has it. Null ids are left out; repeated windows count each."""
    names, types = [*KEY, "l", "n_collide", "r"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    return _swept(windows, least, covers, "query_id long, doc_id long, l int, n_collide int, r int", names, types)


def all_rectangles(windows: DataFrame, least: int) -> DataFrame:
    """(query_id, doc_id, l, r, n_collide, area): every cell of begins and ends over which at least `least` windows lie;
    (l, r) is its first begin and last end, area its number of spans."""
    names, types = [*KEY, "l", "r", "n_collide", "area"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    return _swept(windows, least, rectangles, "query_id long, doc_id long, l int, r int, n_collide int, area long", names, types)


def covered_area(rectangles: DataFrame) -> DataFrame:
    """(query_id, doc_id, spans): how many spans of the document match."""
    return rectangles.groupBy(*KEY).agg(F.sum("area").alias("spans"))


def _strips_sql(windows: DataFrame) -> DataFrame:
    """Windows by strip (pos, nx): between successive begins or ends of windows, those that are active there."""
    points = windows.select(*KEY, F.explode(F.array(F.col("l"), F.col("c") + 1)).alias("pos")).distinct()
    strips = points.withColumn("nx", F.lead("pos").over(Window.partitionBy(*KEY).orderBy("pos"))).where("nx is not null")
    return strips.join(windows, KEY).where("l <= pos and c >= pos").select(*KEY, "pos", "nx", "c", "r")


def max_cover_sql(windows: DataFrame, least: int) -> DataFrame:
    """max_cover by joins."""
    active = _strips_sql(windows.select(*KEY, "l", "c", "r"))
    ends = active.select(*KEY, "pos", F.col("r").alias("y")).distinct()
    counts = ends.join(active, [*KEY, "pos"]).where("c <= y and r >= y").groupBy(*KEY, "pos", "y").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    best = counts.groupBy(*KEY, "pos").agg(F.max(F.struct("n", "y")).alias("m"))
    return best.select(*KEY, F.col("pos").cast("int").alias("l"), F.col("m.n").cast("int").alias("n_collide"), F.col("m.y").cast("int").alias("r"))


def all_rectangles_sql(windows: DataFrame, least: int) -> DataFrame:
    """all_rectangles by joins."""
    active = _strips_sql(windows.select(*KEY, "l", "c", "r"))
    points = active.select(*KEY, "pos", "nx", F.explode(F.array(F.col("c"), F.col("r") + 1)).alias("y")).distinct()
    each = points.withColumn("ny", F.lead("y").over(Window.partitionBy(*KEY, "pos").orderBy("y"))).where("ny is not null")
    counts = each.join(active.drop("nx"), [*KEY, "pos"]).where("c <= y and r >= y").groupBy(*KEY, "pos", "nx", "y", "ny").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    area = (F.col("nx") - F.col("pos")).cast("long") * (F.col("ny") - F.col("y"))
    return counts.select(*KEY, F.col("pos").cast("int").alias("l"), (F.col("ny") - 1).cast("int").alias("r"), F.col("n").cast("int").alias("n_collide"), area.alias("area"))
