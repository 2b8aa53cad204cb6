"""Substring dedup by fixed-block anchors: passages of at least `least` words that occur elsewhere, extended to maximal repeats.

A text is its words, split at white space. Reference blocks are the non-overlapping runs of `block` words of every document;
with least >= 2 * block - 1 any repeat holds one whole block of either side. The probes are all rolling windows of `block`
words of every document. Both are hashed and shuffled by hash; a window that meets a block elsewhere is a hit. Of the places
that share a hash the one of the smallest (id, position) is the reference of them all, so a passage in n documents costs n hits,
not n * n. A reference that no other place meets yields nothing. Where a text repeats a phrase over and over, so that equal windows overlap, only the first
two, the last and one at a block's place are sent for each such run: they align the run with itself and with others.

Hits of one document on one diagonal (same distance to the same reference document) that follow each other block by block form a
run. For each run the words of both sides are compared one by one, and it is extended left and right as long as
words agree: a maximal exact repeat. Those shorter than `least` words are dropped. Windows travel with 32 bits of their hash besides
their part, so different ones may meet: those that turn out to differ from their reference meet again among themselves, by a digest of
128 bits of their own words under another key each time, until none differs. A collision so costs work and no repeat.

The reference of a block may share less than `least` words around it with a place that shares more with a third document. So in a
second round the windows of `least` words around blocks that met, unless a repeat found in the first covers them, are
matched in the same way. The smallest place of each such window is never covered, so every repeat of `least` words is found.

Windows travel as arrays of about 6 bytes each. Texts are shuffled once, to keep those whose blocks met; of a reference only the stretch that
can align with the other document is sent on, its requests in groups of a bounded number, so that a boilerplate passage of a
third of all documents is no one task's work. The plan is the same at every size; the number of parts follows the bytes of text.

Defined results: a null id or text takes no part; fewer than `least` words never repeat; white space of any kind and amount
separates words and is not compared; rows that repeat an id are no repeats of each other (of differing texts under
one id the greatest is compared); very long texts are compared whole; other columns are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import RangeHash, mix64, partitions, slices, small, store, trimmed, utf8

LEAST = 50
BLOCK = 25

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FLUSH = 500_000
#: Bytes of text whose windows one task of a meeting holds.
PART_BYTES = 16 << 20
#: Requests for stretches of one reference that are answered together.
REQUESTS = 256


def spaced(text):
    """Runs of white space as one space: words can be hashed and compared as byte ranges."""
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def word_ranges(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins and ends of the words of these texts, and the number of words before each text."""
    mark = np.ones(len(text) + 2, bool)
    mark[1:-1] = _SPACE[text]
    begins, ends = np.flatnonzero(~mark[1:-1] & mark[:-2]), np.flatnonzero(~mark[1:-1] & mark[2:]) + 1
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(text)) & (inner != offsets[:-2])]  # once, where empty texts follow
    cut = inner[~_SPACE[text[inner]] & ~_SPACE[text[inner - 1]]] if len(inner) else inner
    if len(cut):
        begins, ends = np.sort(np.concatenate([begins, cut])), np.sort(np.concatenate([ends, cut]))
    return begins, ends, np.searchsorted(begins, offsets)


def _inner(doc: np.ndarray, position: np.ndarray, hashes: np.ndarray, length: int, block: int | None) -> np.ndarray:
    """Numbers of the windows within runs of overlapping equal windows of a text: all but the first two, the last, and the first at a block's place."""
    keys = hashes ^ mix64(doc.astype(np.uint64))
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    own = np.flatnonzero(np.isin(keys, twice))
    own = own[np.lexsort((position[own], doc[own], keys[own]))]
    k, d, p = keys[own], doc[own], position[own]
    link = (k[1:] == k[:-1]) & (d[1:] == d[:-1]) & (p[1:] - p[:-1] <= length)
    before, after = np.concatenate([[False], link]), np.concatenate([link, [False]])
    inner = before & after & np.concatenate([[False], before[:-1]])
    if block:
        aligned = np.flatnonzero(p % block == 0)
        inner[aligned[np.unique(np.cumsum(~before)[aligned], return_index=True)[1]]] = False
    return own[inner]


def _windows(parts: int, length: int, block: int | None = None, choose=None, bits: int = 64):
    """Windows of `length` words as rows (part, ids, counts, position, hash) for each part of the shuffle and about _FLUSH windows:
    all, or those at the positions that choose(words of the text, batch, row) names. bits: of the hash, fewer in tests of collisions."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        ids, position, hashes = (np.concatenate(x) for x in zip(*held))
        if bits < 64:
            hashes &= np.uint64((1 << bits) - 1)
        part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
        by = np.argsort(part.astype(np.uint16) if parts <= 65535 else part, kind="stable")
        cuts = np.searchsorted(part[by], np.arange(parts + 1))
        ids, position, low = ids[by], position[by], hashes[by].astype(np.uint32)
        out: list[list] = [[], [], [], [], []]
        for p in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[p], cuts[p + 1]
            new = np.concatenate([[0], np.flatnonzero(np.diff(ids[a:b])) + 1])
            for col, x in zip(out, (int(p), _pack(np.diff(ids[a:b][new], prepend=0)), _pack(np.diff(np.concatenate([new, [b - a]]))), _pack(np.diff(position[a:b], prepend=0)), low[a:b].tobytes())):
                col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["part", "ids", "counts", "position", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            text, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                begins, ends, at = word_ranges(text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sums = RangeHash(text[offsets[a] : offsets[b]])
                if choose is None:
                    many = np.maximum(np.diff(at) - length + 1, 0)
                    position = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                else:
                    chosen = [choose(int(at[i + 1] - at[i]), batch, a + i) for i in range(b - a)]
                    many, position = np.array([len(c) for c in chosen]), np.concatenate(chosen)
                if not many.sum():
                    continue
                doc = np.repeat(np.arange(b - a), many)
                first = at[doc] + position
                hashes = sums.of(begins[first], ends[first + length - 1])
                if len(inner := _inner(doc, position, hashes, length, block)):
                    doc, position, hashes = (np.delete(x, inner) for x in (doc, position, hashes))
                held.append((ids[a:b][doc], position.astype(np.int32), hashes))
                count += len(doc)
                if count >= _FLUSH:
                    yield flush(held)
                    held, count = [], 0
        if held:
            yield flush(held)

    return run


def _pack(deltas: np.ndarray) -> bytes:
    """Mostly small numbers: their low 16 bits as two planes of bytes, and the few that don't fit in full."""
    wide = np.flatnonzero((deltas < 0) | (deltas > 65534))
    low = deltas.astype(np.uint16)
    low[wide] = 65535
    planes = low.view(np.uint8).reshape(-1, 2)
    return np.int64(len(deltas)).tobytes() + planes[:, 0].tobytes() + planes[:, 1].tobytes() + deltas[wide].astype(np.int64).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    planes = np.frombuffer(data, np.uint8, 2 * n, 8).reshape(2, n)
    out = planes[0].astype(np.int64) | planes[1].astype(np.int64) << 8
    out[out == 65535] = np.frombuffer(data[8 + 2 * n :], np.int64)
    return out


def _hits(block: int | None):
    """Places (id, at) of windows that occur twice, if at a block's place anywhere (block None: all), and the smallest such place as
    (ref, ref_at), which are null for that place itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, positions, hashes = [], [], []
        for batch in batches:
            for i, c, p, h in zip(*(batch.column(k) for k in range(1, 5))):
                ids.append(np.repeat(np.cumsum(_unpack(i.as_py())), _unpack(c.as_py())))
                positions.append(np.cumsum(_unpack(p.as_py())).astype(np.int32))
                hashes.append(np.frombuffer(h.as_buffer(), np.uint32))
        if not ids:
            return
        ids, positions, hashes = np.concatenate(ids), np.concatenate(positions), np.concatenate(hashes)
        # a pass over the hashes alone leaves what occurs twice: most windows occur once
        order = hashes.astype(np.uint64)
        del hashes
        order <<= np.uint64(32)
        order |= np.arange(len(order), dtype=np.uint32)
        order.sort()
        high = order.view(np.uint32)[1::2]
        same = high[1:] == high[:-1]
        twice = np.concatenate([same, [False]])
        twice[1:] |= same
        order = order[twice]
        value, at = (order >> np.uint64(32)).astype(np.uint32), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del order, high, same, twice
        ids, positions = ids[at], positions[at]
        order = np.lexsort((positions, ids, value))
        value, ids, positions = value[order], ids[order], positions[order]
        if not len(value):
            return
        new = np.concatenate([[True], value[1:] != value[:-1]])
        group = np.cumsum(new) - 1
        indexed = np.bincount(group, positions % block == 0)[group] > 0 if block else np.ones(len(value), bool)
        head = np.flatnonzero(new)[group]
        hit = (ids != ids[head]) | (positions != positions[head])
        found = np.flatnonzero(indexed)
        for k in range(0, len(found), 100_000):
            f = found[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[f]), pa.array(positions[f]), pa.array(ids[head[f]], mask=~hit[f]), pa.array(positions[head[f]], mask=~hit[f])], ["id", "at", "ref", "ref_at"])

    return run


def _digest(words: list[str], level: int) -> bytes:
    return hashlib.blake2b(" ".join(words).encode(), digest_size=16, salt=level.to_bytes(8, "little")).digest()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References with requests (id, runs, low, high) -> one row (id, ref, runs, low, b) for each: the reference's words low to high - 1."""
    for batch in batches:
        for ref, requests, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            words = text.split(" ")
            own = requests.values
            low, high = own.field("low").to_pylist(), own.field("high").to_pylist()
            for k in range(0, len(own), 64):
                some = own.slice(k, 64)
                passages = [" ".join(words[a:b]) for a, b in zip(low[k : k + 64], high[k : k + 64])]
                yield pa.RecordBatch.from_arrays([some.field("id"), pa.array([ref] * len(some), pa.int64()), some.field("runs"), some.field("low"), pa.array(passages, pa.string())], ["id", "ref", "runs", "low", "b"])


def _extend(length: int, least: int, level: int):
    """Runs with the words of both sides -> maximal repeats, and the places of windows that only seemed to agree, with their digests.

    A row is a pair of documents: its runs (begin, end, shift), the text a, and the words b of the other one from word `low` on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a = None, []
        for batch in batches:
            out: list[tuple] = []
            for i, ref, runs, low, y, x in zip(*(batch.column(k) for k in range(6))):
                i, ref, low = i.as_py(), ref.as_py(), low.as_py()
                if now != i:
                    now, a = i, x.as_py().split(" ")
                b = y.as_py().split(" ")
                done: dict[int, int] = {}
                for begin, end, shift in sorted((r["begin"], r["end"], r["shift"]) for r in runs.as_py()):
                    off = shift + low  # word k of a is word k - off of b
                    differ = [k for k in range(begin, min(end, len(a))) if not 0 <= k - off < len(b) or a[k] != b[k - off]]
                    if differ:
                        windows = {w for k in differ for w in range(max(begin, k - length + 1), min(k + 1, end - length + 1))}
                        out += [(i, w, None, None, None, _digest(a[w : w + length], level)) for w in sorted(windows) if w + length <= len(a)]
                    # what agrees between the words that differ
                    edges = [begin - 1, *differ, min(end, len(a))]
                    for first, last in ((p + 1, q) for p, q in zip(edges, edges[1:]) if q - p - 1 >= length):
                        if first < done.get(shift, 0):  # within a repeat that is already found
                            continue
                        while first > max(0, off) and a[first - 1] == b[first - 1 - off] and first > done.get(shift, 0):
                            first -= 1
                        while last < len(a) and last - off < len(b) and a[last] == b[last - off]:
                            last += 1
                        done[shift] = last
                        if last - first >= least:
                            out.append((i, first, last - first, ref, first - shift, None))
                if len(out) >= 10_000:
                    yield _repeat_rows(out)
                    out = []
            if out:
                yield _repeat_rows(out)

    return run


def _repeat_rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["doc_id", "start", "words", "ref_id", "ref_start", "digest"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """Rows (doc_id, start, words, ref_id, ref_start, first): the words of doc_id from start are those of ref_id from ref_start; maximal.

    first is false for a place that repeats its reference. Each reference is listed too, once for each length, with the smallest
    of the places that repeat it and first true: so every document that holds a repeat is a doc_id, and those to cut are not first.
    """
    if least < 2 * block - 1:
        raise ValueError("least must be at least 2 * block - 1, or a repeat may hold no whole block")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(partitions(docs.sparkSession), -(-total // PART_BYTES))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), spaced(F.col(text_col)).alias("t")).where("id is not null and t is not null")
    places = _places(texts, parts, _windows(parts, block, block, bits=bits), _hits(block))
    met = places.groupBy("id").agg(F.collect_set("at").alias("at"))
    # the one shuffle of all texts: those whose blocks met stay
    found = texts.hint("merge").join(met, "id").groupBy("id").agg(F.max("t").alias("t"), F.any_value("at").alias("at"))
    bodies = store(found.withColumn("n", F.size(F.split("t", " "))), "bodies")
    first = _maximal(places.where("ref is not null"), bodies, block, least)

    # the second round: where the first has covered a document's words, as (begin, end) that only grow
    covered = first.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("start").alias("begin"), (F.col("start") + F.col("words")).alias("end")))).alias("covered"))
    again = bodies.join(covered, "id", "left").select("id", "t", "at", "covered")
    longer = _places(again, parts, _windows(parts, least, None, _uncovered(block, least), bits), _hits(None))
    found = store(first.unionAll(_maximal(longer.where("ref is not null"), bodies, least, least)).distinct(), "repeats")
    heads = found.groupBy("ref_id", "ref_start", "words").agg(F.min(F.struct("doc_id", "start")).alias("m"))
    mirrored = heads.select(F.col("ref_id").alias("doc_id"), F.col("ref_start").alias("start"), "words", F.col("m.doc_id").alias("ref_id"), F.col("m.start").alias("ref_start"), F.lit(True).alias("first"))
    return found.withColumn("first", F.lit(False)).unionAll(mirrored)


def _uncovered(block: int, least: int):
    """Begins of the windows of `least` words around the places of a document that no repeat of it covers."""

    def choose(words: int, batch: pa.RecordBatch, row: int) -> np.ndarray:
        if words < least:
            return np.zeros(0, np.int64)
        at = np.array(batch.column(2)[row].as_py(), np.int64)
        begins = np.unique((at[:, None] - np.arange(least - block + 1)).ravel())
        begins = begins[(begins >= 0) & (begins + least <= words)]
        covered = batch.column(3)[row].as_py()
        if covered and len(begins):
            first = np.array([c["begin"] for c in covered])
            last = np.maximum.accumulate(np.array([c["end"] for c in covered]))
            k = np.searchsorted(first, begins, "right") - 1
            begins = begins[(k < 0) | (last[np.maximum(k, 0)] < begins + least)]
        return begins

    return choose


def _places(texts: DataFrame, parts: int, windows, hits) -> DataFrame:
    probed = texts.mapInArrow(trimmed(windows), "part int, ids binary, counts binary, position binary, hash binary").repartitionById(parts, F.col("part"))
    return store(probed.mapInArrow(trimmed(hits), "id long, at int, ref long, ref_at int"), "places")


def _maximal(hits: DataFrame, bodies: DataFrame, length: int, least: int) -> DataFrame:
    """The maximal repeats through hits (id, at, ref, ref_at) of windows of `length` words. What only seemed to agree meets again."""
    out, level = None, 0
    while True:
        level += 1
        extended = store(_aligned(hits, bodies, length).mapInArrow(trimmed(_extend(length, least, level)), "doc_id long, start int, words int, ref_id long, ref_start int, digest binary"), "repeats")
        found = extended.where("digest is null").drop("digest")
        out = found if out is None else out.unionAll(found)
        left = extended.where("digest is not null").select(F.col("doc_id").alias("id"), F.col("start").alias("at"), "digest").distinct()
        if left.isEmpty():
            return out
        heads = left.groupBy("digest").agg(F.min(F.struct("id", "at")).alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", F.col("head.id").alias("ref"), F.col("head.at").alias("ref_at"))
        hits = left.join(heads, "digest").where("id <> ref or at <> ref_at").select("id", "at", "ref", "ref_at")


def _aligned(hits: DataFrame, bodies: DataFrame, length: int) -> DataFrame:
    """Rows (id, ref, runs, low, b, a) for _extend."""
    hits = hits.distinct().withColumn("shift", F.col("at") - F.col("ref_at"))
    own = Window.partitionBy("id", "ref", "shift").orderBy("at")
    ends = F.col("at") + length
    start = F.when(F.col("at") > F.coalesce(F.lag(ends).over(own), F.lit(-1)), 1).otherwise(0)
    runs = hits.withColumn("new", start).withColumn("run", F.sum("new").over(own))
    runs = runs.groupBy("id", "ref", "shift", "run").agg(F.min("at").alias("begin"), (F.max("at") + length).alias("end"))
    pairs = store(runs.groupBy("id", "ref").agg(F.collect_list(F.struct("begin", "end", "shift")).alias("runs"), F.min("shift").alias("least"), F.max("shift").alias("most")), "runs")
    # word k of the document is word k - shift of the reference: what can align at all is from -most to n - least
    spans = pairs.join(bodies.select("id", "n"), "id").select("id", "ref", "runs", F.greatest(F.lit(0), -F.col("most")).alias("low"), (F.col("n") - F.col("least")).alias("high"))
    hot = store(pairs.groupBy("ref").count().where(F.col("count") > REQUESTS).select("ref", F.ceil(F.col("count") / REQUESTS).alias("groups")), "hot")
    salted = spans.join(small(hot, hot.count(), 64), "ref", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("groups", F.lit(1))))
    requests = salted.groupBy("ref", "salt").agg(F.collect_list(F.struct("id", "runs", "low", "high")).alias("requests"))
    asked = requests.join(bodies.select(F.col("id").alias("ref"), "t"), "ref").select("ref", "requests", "t")
    stretches = asked.mapInArrow(trimmed(_stretches), "id long, ref long, runs array<struct<begin: int, end: int, shift: int>>, low int, b string")
    return stretches.join(bodies.select("id", F.col("t").alias("a")), "id").select("id", "ref", "runs", "low", "b", "a")
