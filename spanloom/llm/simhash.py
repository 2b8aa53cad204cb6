"""SimHash near-dedup: all pairs of documents whose fingerprints differ in at most `radius` bits.

A document's features are its different words (lower case). Its fingerprint has BITS bits, each the sign of a sum of pseudo-random
+1 and -1 over the features. Two documents are near duplicates if and only if their fingerprints differ in at most `radius` (84) of the 384 bits.

The search is exact, by the pigeonhole principle twice: radius + 1 units are dealt to the six 64-bit parts of a fingerprint, and those of
a part to its four chunks of 16 bits (85 units: 14 or 15 a part, 3 or 4 a chunk). If every part differed in at least as many bits as it has
units, the whole would differ in more than radius; so in some part of each pair fewer bits differ, and likewise in some chunk of that part (at most 2 or 3). For each
chunk, fingerprints are sorted by it, each value meets all values so near (137 or 697 of 65,536), and what meets is verified on the part,
then on the whole. One XOR rejects nearly all of what meets, but the cost grows with the square of the different fingerprints (README has figures).
A pair is given once, by the first chunk that has it. Fingerprints are split into blocks of about BLOCK; each task takes two blocks, and while there
are few blocks, a share of the chunks.

`word_bits` (32 or 64), if given, asks for a narrower relation whose cost doesn't grow with the square: near duplicates must then also have some word of
that many bits in which they differ in at most BALL = 2 bits. This leaves out pairs within the radius; no query uses it. Here every fingerprint emits all variants of each
word with at most one flipped bit (33 for 32 bits): two words within 2 bits have a variant in common and words further apart have none. Variants travel as
arrays, about 6 bytes each; pairs that meet are made distinct and verified on the whole fingerprints. Words of 32 bits suit up to some 10**8 different
fingerprints: beyond, unrelated ones meet by chance so often that the pairs to verify outgrow the rest.

Fingerprints that are equal are reduced to one class before the search, so copies (exact, reordered, in other case) cost one fingerprint. near_groups gives each
document's group and number of links, near_duplicates the pairs between the representatives (smallest ids) of all classes, and each member
with its representative; drop_near_duplicates leaves one text of each group. Nothing is capped.

Defined results: null ids and texts, and texts without any word, have no fingerprint and no pair; repeated rows of an id pair
only with other ids; an id with several texts is in several classes; pairs are (smaller id, larger id); very long texts count whole; other
columns are ignored, whatever their names; no rows give no rows. drop_near_duplicates goes by id and text, not by id alone: near duplicates of
one id are reduced to one too, and a text doesn't fall with another text of its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import RangeHash, mix64, partitions, slices, small, store, trimmed, unused, utf8

WORD_BITS = 32
BITS = 384
WORDS = BITS // WORD_BITS
BALL = 2
RADIUS = 84
#: Variants whose meeting one task holds.
PART_VARIANTS = 4_000_000
#: Fingerprints in a block; a task holds two blocks.
BLOCK = 500_000
_PAIRS = 2_000_000
_CELLS = 1 << 18
_CHUNKS = BITS // 16

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_LANES = np.uint64(0x9E3779B97F4A7C15) * np.arange(1, BITS // 64 + 1, dtype=np.uint64)


def word_hashes(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of these texts, and the number of words before each text."""
    mark = np.zeros(len(text) + 2, bool)
    mark[1:-1] = _WORD[text]
    begins, ends = np.flatnonzero(mark[1:-1] & ~mark[:-2]), np.flatnonzero(mark[1:-1] & ~mark[2:]) + 1
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(text)) & (inner != offsets[:-2])]  # once, where empty texts follow
    cut = inner[_WORD[text[inner]] & _WORD[text[inner - 1]]] if len(inner) else inner  # a word never spans two texts
    if len(cut):
        begins, ends = np.sort(np.concatenate([begins, cut])), np.sort(np.concatenate([ends, cut]))
    return RangeHash(text).of(begins, ends), np.searchsorted(begins, offsets)


def fingerprints_of(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have words, their fingerprints as uint64 rows)."""
    rows, prints = [], []
    for a, b in slices(offsets, 1 << 20):
        base = offsets[a]
        hashes, at = word_hashes(text[base : offsets[b]], offsets[a : b + 1] - base)
        for row in range(a, b):
            own = hashes[at[row - a] : at[row - a + 1]]
            if not len(own):
                continue
            own = np.unique(own)
            sums = np.zeros(BITS, np.int64)
            for i in range(0, len(own), 4096):
                part = own[i : i + 4096]
                with np.errstate(over="ignore"):
                    lanes = mix64((part[:, None] + _LANES[None, :]).ravel()).view(np.uint8).reshape(len(part), -1)
                sums += np.unpackbits(lanes, axis=1).sum(axis=0, dtype=np.uint16)
            rows.append(row)
            prints.append(np.packbits(2 * sums > len(own)).view(np.uint64))
    return np.array(rows, np.int64), np.array(prints, np.uint64).reshape(-1, BITS // 64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Rows (id, f0, f1, ...): the 64-bit parts of each fingerprint; with digest also the text's, as the last column."""
    names = [f"f{i}" for i in range(BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, prints = fingerprints_of(*utf8(batch.column(1)))
            if len(rows):
                columns = [column.take(pa.array(rows)) for column in (batch.column(0), *batch.columns[2:])]
                yield pa.RecordBatch.from_arrays([columns[0], *(pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in range(len(names))), *columns[1:]], ["id", *names, *["digest"] * digest])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("t"), *[_digest(text_col).alias("digest")] * digest).where("id is not null and t is not null")
    return texts.mapInArrow(trimmed(run), "id long, " + ", ".join(f"{n} long" for n in names) + ", digest string" * digest)


def _digest(text_col: str) -> Column:
    return F.sha2(F.col(text_col).cast("binary"), 256)


def _kind(word_bits: int) -> np.dtype:
    if word_bits not in (32, 64):
        raise ValueError("word_bits must be 32 or 64")
    return np.dtype(f"u{word_bits // 8}")


def _emit(parts: int, word_bits: int = WORD_BITS):
    """Variants of fingerprints, as one row (part, ids, counts, tag, variant) for each part of the shuffle and batch; a tag is word * (word_bits + 1) + flip."""
    kind, words, ball = _kind(word_bits), BITS // word_bits, word_bits + 1
    flips = np.concatenate([np.zeros(1, kind), kind.type(1) << np.arange(word_bits, dtype=kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            own_words = np.stack([np.asarray(batch.column(i)) for i in range(1, batch.num_columns)], axis=1).view(kind).reshape(len(ids), words)[order]
            for begin in range(0, len(ids), 2048):
                own = own_words[begin : begin + 2048]
                variant = (own[:, :, None] ^ flips).reshape(-1)
                tag = np.tile(np.arange(words * ball, dtype=np.uint16), len(own))
                row = np.repeat(np.arange(len(own), dtype=np.int32), words * ball)
                part = (mix64(variant.astype(np.uint64) ^ mix64((tag // ball).astype(np.uint64))) % np.uint64(parts)).astype(np.int32)
                by = np.argsort(part, kind="stable") if parts > 65535 else np.argsort(part.astype(np.uint16), kind="stable")
                cuts = np.searchsorted(part[by], np.arange(parts + 1))
                out: list[list] = [[], [], [], [], []]
                for p in np.flatnonzero(np.diff(cuts)):
                    sel = by[cuts[p] : cuts[p + 1]]
                    there, counts = np.unique(row[sel], return_counts=True)
                    for col, x in zip(out, (int(p), ids[begin + there].tobytes(), counts.astype(np.uint16).tobytes(), tag[sel].tobytes(), variant[sel].tobytes())):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], ["part", "ids", "counts", "tag", "variant"])

    return run


def _pair_rows(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    found = np.unique(np.concatenate(pairs), axis=0)
    for i in range(0, len(found), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[i : i + 100_000, k])) for k in (0, 1)], ["a", "b"])


def _groups_pairs(groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the members of each row of groups, some _PAIRS at a time."""
    m = groups.shape[1]
    if m * m > _PAIRS:  # one member against the rest
        for group in groups:
            for i in range(m - 1):
                yield np.full(m - 1 - i, group[i]), group[i + 1 :]
        return
    left, right = np.triu_indices(m, 1)
    for some in np.array_split(groups, max(1, groups.shape[0] * len(left) // _PAIRS)):
        yield some[:, left].ravel(), some[:, right].ravel()


def _meet(word_bits: int = WORD_BITS):
    """Pairs of ids that share a variant of a word, each once for about _PAIRS of them."""
    kind, words, ball = _kind(word_bits), BITS // word_bits, word_bits + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tags, variants = [], [], []
        for batch in batches:
            for a, b, c, d in zip(*(batch.column(i) for i in range(1, 5))):
                ids.append(np.repeat(np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.uint16)))
                tags.append(np.frombuffer(c.as_buffer(), np.uint16))
                variants.append(np.frombuffer(d.as_buffer(), kind))
        if not ids:
            return
        ids, tags, variants = np.concatenate(ids), np.concatenate(tags), np.concatenate(variants)
        word, flip = tags // ball, tags % ball
        pairs: list[np.ndarray] = []
        held = 0
        for t in range(words):
            own = np.flatnonzero(word == t)
            by = np.argsort(variants[own], kind="stable")
            at, value = own[by], variants[own][by]
            cut = np.flatnonzero(value[1:] != value[:-1]) + 1
            begin, size = np.concatenate([[0], cut]), np.diff(np.concatenate([[0], cut, [len(value)]]))
            for m in np.unique(size[size > 1]):
                for x, y in _groups_pairs(at[begin[size == m][:, None] + np.arange(m)]):
                    # one flip for both means that the words are equal: that pair is seen at their common unflipped variant
                    new = (flip[x] != flip[y]) | (flip[x] == 0)
                    x, y = ids[x[new]], ids[y[new]]
                    if len(x):
                        pairs.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
                        held += len(x)
                    if held >= _PAIRS:
                        yield from _pair_rows(pairs)
                        pairs, held = [], 0
        if pairs:
            yield from _pair_rows(pairs)

    return run


def _dealt(units: int, hands: int) -> list[int]:
    return [units // hands + (i < units % hands) for i in range(hands)]


def _units(radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Units of each 64-bit part and of each 16-bit chunk: some part, and some chunk of it, differs in fewer bits than these in every pair within the radius."""
    parts = _dealt(max(0, radius + 1), BITS // 64)
    return np.array(parts), np.array([n for units in parts for n in _dealt(units, 4)])


def _sorted_by(chunk: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the fingerprints by this chunk, the part that has the chunk in this order, and where each value of the chunk begins."""
    keys = np.ascontiguousarray(prints.view(np.uint16)[:, chunk])
    order = np.argsort(keys, kind="stable")
    return order, prints[order, chunk // 4], np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << 16))])


def _within(x: np.ndarray, y: np.ndarray | None, chunks: list[int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, distances) of the pairs within the radius whose first chunk is one of these; pairs within x, each once, if y is None."""
    part_units, chunk_units = _units(radius)
    weight = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))
    for chunk in chunks:
        masks, most = np.flatnonzero(weight < chunk_units[chunk]), np.uint8(min(255, part_units[chunk // 4]))
        order, part, begins = _sorted_by(chunk, x)
        other_order, other_part, other_begins = (order, part, begins) if y is None else _sorted_by(chunk, y)
        other_sizes, count = np.diff(other_begins), np.arange(max(len(order), len(other_order)))
        for key in np.flatnonzero(np.diff(begins)).tolist():
            near = masks ^ key
            if y is None:
                near = near[near >= key]
            sizes = other_sizes[near]
            ends = sizes.cumsum()
            n = int(ends[-1]) if len(ends) else 0
            if not n:
                continue
            at = (other_begins[near] - ends + sizes).repeat(sizes)
            at += count[:n]
            meets = other_part[at]
            step = max(1, _CELLS // n)
            for begin in range(int(begins[key]), last := int(begins[key + 1]), step):
                own = part[begin : min(begin + step, last)]
                found = (np.bitwise_count(own[:, None] ^ meets) < most).ravel().nonzero()[0]
                if not len(found):
                    continue
                a, b = begin + found // n, at[found % n]
                if y is None:  # values are met upwards; of equal ones, and of itself, the order decides
                    a, b = a[keep := (b > a)], b[keep]
                a, b = order[a], other_order[b]
                for i in range(0, len(a), _CELLS):
                    yield from _verified(a[i : i + _CELLS], b[i : i + _CELLS], x, x if y is None else y, chunk, radius)


def _verified(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, chunk: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    part_units, chunk_units = _units(radius)
    differ = x[a] ^ y[b]
    parts = np.bitwise_count(differ)
    distance = parts.sum(axis=1, dtype=np.int32)
    near = np.flatnonzero(distance <= radius)
    if len(near):
        meet = (np.bitwise_count(differ[near].view(np.uint16)) < chunk_units) & np.repeat(parts[near] < part_units, 4, axis=1)
        near = near[meet.argmax(axis=1) == chunk]
        if len(near):
            yield a[near], b[near], distance[near]


def _search(shares: int, radius: int):
    """Pairs (a, b, distance) of the classes of each part: rows (part, side, class, f0, f1, ...), where part % shares is the share of the chunks."""
    by_cost = np.argsort(-_units(radius)[1], kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            some = [np.asarray(batch.column(i)) for i in range(batch.num_columns)]
            for column, values in zip(columns, (some[0], some[1], some[2], np.stack(some[3:], axis=1).view(np.uint64))):
                column.append(values.copy())
        if not columns[0]:
            return
        part, side, ids, prints = (np.concatenate(column) for column in columns)
        columns.clear()
        for p in np.unique(part):
            chunks = by_cost[p % shares :: shares].tolist()
            left, right = (np.flatnonzero((part == p) & (side == s)) for s in (0, 1))
            # the pairs of a block with itself have one side (-1)
            alone = np.flatnonzero((part == p) & (side == -1))
            found, held = [], 0
            pairs = _within(prints[alone], None, chunks, radius) if len(alone) else _within(prints[left], prints[right], chunks, radius)
            ids_x, ids_y = (ids[alone], ids[alone]) if len(alone) else (ids[left], ids[right])
            for a, b, distance in pairs:
                found.append((ids_x[a], ids_y[b], distance))
                held += len(a)
                if held >= _PAIRS:
                    yield from _distance_rows(found)
                    found, held = [], 0
            if found:
                yield from _distance_rows(found)

    return run


def _distance_rows(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    a, b, distance = (np.concatenate(x) for x in zip(*found))
    for i in range(0, len(a), 100_000):
        some = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[some], b[some])), pa.array(np.maximum(a[some], b[some])), pa.array(distance[some])], ["a", "b", "distance"])


def _all_within(classes: DataFrame, names: list[str], radius: int) -> DataFrame:
    """Pairs (a, b, distance), a < b, of all classes within the radius, each once."""
    n = classes.count()
    blocks = -(-n // BLOCK) or 1
    pairs = blocks * (blocks + 1) // 2
    shares = max(1, min(_CHUNKS // pairs, n // 1000 + 1))
    block = F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")
    low, high = F.least("block", "other"), F.greatest("block", "other")
    sent = classes.select("class", *names, block.alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    part = ((high * (high + 1) / 2 + low) * shares + F.col("share")).cast("int")
    side = F.when(F.col("block") == F.col("other"), -1).otherwise((F.col("block") == high).cast("int"))
    sent = sent.select(part.alias("part"), side.alias("side"), "class", *names)
    return sent.repartitionById(pairs * shares, F.col("part")).mapInArrow(trimmed(_search(shares, radius)), "a long, b long, distance int")


def _near_words(classes: DataFrame, names: list[str], radius: int, word_bits: int) -> DataFrame:
    """Pairs (a, b, distance) of the classes within the radius that have some word within BALL bits."""
    parts = max(partitions(classes.sparkSession), classes.count() * (BITS // word_bits) * (word_bits + 1) // PART_VARIANTS + 1)
    emitted = classes.select("class", *names).mapInArrow(trimmed(_emit(parts, word_bits)), "part int, ids binary, counts binary, tag binary, variant binary")
    pairs = emitted.repartitionById(parts, F.col("part")).mapInArrow(trimmed(_meet(word_bits)), "a long, b long").distinct()
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("class").alias(side), *(F.col(n).alias(f"{side}_{n}") for n in names)), side)
    distance = sum((F.bit_count(F.col(f"a_{n}").bitwiseXOR(F.col(f"b_{n}"))) for n in names), F.lit(0))
    return pairs.select("a", "b", distance.cast("int").alias("distance")).where(F.col("distance") <= radius)


def _verified_pairs(classes: DataFrame, names: list[str], radius: int, word_bits: int | None) -> DataFrame:
    return _all_within(classes, names, radius) if word_bits is None else _near_words(classes, names, radius, word_bits)


def _classes(docs: DataFrame, id_col: str, text_col: str, radius: int, word_bits: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (id, class), classes (class, root), and pairs of classes (a, b, distance) within the radius.

    A class is one fingerprint and its root the smallest id that has it. An id with several texts may be in several classes.
    """
    names = [f"f{i}" for i in range(BITS // 64)]
    prints = store(fingerprints(docs, id_col, text_col), "fingerprints")
    # stored with the numbers, so that they are given once
    classes = store(prints.groupBy(*names).agg(F.min("id").alias("root")).select(F.monotonically_increasing_id().alias("class"), *names, "root"), "classes")
    verified = _verified_pairs(classes, names, radius, word_bits)
    members = prints.join(classes, names).select("id", "class").distinct()
    return members, classes.select("class", "root"), verified


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, word_bits: int | None = WORD_BITS) -> DataFrame:
    """Rows (doc_a, doc_b, distance), doc_a < doc_b: the pairs of near duplicates among the representatives of classes, and
    each further member of a class with its representative, at distance 0.

    A class is all documents of one fingerprint, its representative the smallest id. Two documents are near duplicates if and only if
    their classes are the same or paired, so no link is lost, and rows don't grow with the square of the copies.
    With word_bits None these are all pairs within the radius; by default, the narrower relation of 32-bit words.
    """
    members, classes, verified = _classes(docs, id_col, text_col, radius, word_bits)
    near = verified.join(classes.select(F.col("class").alias("a"), F.col("root").alias("x")), "a").join(classes.select(F.col("class").alias("b"), F.col("root").alias("y")), "b").select("x", "y", "distance")
    equal = members.join(classes, "class").select(F.col("root").alias("x"), F.col("id").alias("y"), F.lit(0).alias("distance"))
    return _ordered(near.unionAll(equal))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, word_bits: int | None = None) -> DataFrame:
    """Rows (doc_id, class_id, n_links) of the documents that have near duplicates: the smallest id of the connected group, and the
    number of documents that are near duplicates of this one.

    All links are counted, those between different texts one by one, those of copies by the sizes of their classes. A document of several texts has the smallest of their groups and the
    sum of their links.
    """
    members, classes, verified = _classes(docs, id_col, text_col, radius, word_bits)
    members, verified = store(members, "members"), store(verified, "links")
    sizes = members.groupBy("class").agg(F.count("*").alias("size"))
    both = verified.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("b").alias("other")), F.struct(F.col("b").alias("class"), F.col("a").alias("other")))).alias("x")).select("x.*")
    degrees = both.join(sizes.select(F.col("class").alias("other"), "size"), "other").groupBy("class").agg(F.sum("size").alias("linked"))
    roots = verified.join(classes.select(F.col("class").alias("a"), F.col("root").alias("doc_a")), "a").join(classes.select(F.col("class").alias("b"), F.col("root").alias("doc_b")), "b")
    groups = components(roots).select(F.col("id").alias("root"), F.col("root").alias("group"))
    # narrow rows, one for each class
    each = store(classes.join(sizes, "class").join(degrees, "class", "left").join(groups, "root", "left").select("class", F.coalesce("group", "root").alias("class_id"), (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")).where("n_links > 0"), "groups")
    found = members.join(small(each, each.count(), 40), "class")
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Rows (doc_a, doc_b, distance) of pairs (x, y, distance) of different ids, each once, with the least distance."""
    return pairs.where("x <> y").groupBy(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).agg(F.min("distance").alias("distance"))


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """Rows (id, root) of every id in a pair: root is the smallest id of its connected group.

    Alternating large-star and small-star steps until the edges no longer change; each step is stored, so that its lineage ends.
    """
    edges = store(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(edges.select(F.col("v"), F.col("v"))).groupBy("id").agg(F.min("root").alias("root"))
        state = now
        both = edges.select("u", "v").unionAll(edges.select(F.col("v"), F.col("u")))
        least = F.least("u", F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = F.min("v").over(Window.partitionBy("u"))
        step = large.withColumn("m", least)
        edges = store(step.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(step.select("u", F.col("m"))).distinct(), "edges")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, word_bits: int | None = None) -> DataFrame:
    """docs with one text, that of the smallest id, of each connected group of near duplicates. All columns are kept.

    Groups are of texts: those of one id may be in several groups, and if they are near duplicates, the one of the least digest stays. Equal rows go or stay together.
    """
    names = [f"f{i}" for i in range(BITS // 64)]
    prints = store(fingerprints(docs, id_col, text_col, digest=True), "fingerprints")
    classes = store(prints.groupBy(*names).agg(F.min(F.struct("id", "digest")).alias("first")).select(F.monotonically_increasing_id().alias("class"), *names, "first"), "classes")
    groups = components(_verified_pairs(classes, names, radius, word_bits), "a", "b").select(F.col("id").alias("class"), F.col("root").alias("group"))
    linked = store(classes.join(groups, "class").select("class", "group", "first"), "linked")
    kept = linked.join(linked.groupBy("group").agg(F.min("first").alias("kept")), "group").select("class", "kept")
    each = classes.join(kept, "class", "left").select(*names, F.coalesce("kept", "first").alias("kept"))
    out = prints.join(each, names).where(F.struct("id", "digest") != F.col("kept"))
    key = unused(docs, "text_digest")
    out = store(out.select(F.col("id").alias(id_col), F.col("digest").alias(key)).distinct(), "near")
    return docs.withColumn(key, _digest(text_col)).join(small(out, out.count()), [id_col, key], "left_anti").select(*docs.columns)
