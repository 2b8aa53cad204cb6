"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Examples: of each class of `labels` up to `per_class` documents, those of the least hash (the only bounded sample here). Their
dimensions are all their words; words that no example has are no dimension, as usual where a weighting is fitted. Document
frequencies are counted over all documents. A weight is (1 + ln tf) * idf ** IDF_POWER, with idf = ln((1 + N) / (1 + df)); vectors have
length 1. The power lets the words that few documents share decide: with 1, words of half of all documents drown them.
Words are runs of letters, digits and "_" of the lower-case text (any character beyond ASCII counts as a letter), told apart by 64-bit hashes.

Search: examples are sorted so that like ones are near and cut into blocks. Of a word that few examples have, the postings are by block, with
the greatest weight in each; of a word that an eighth of them have, the weights are a row, one for each example, and the rows' sums for
many documents are one matrix product. The k-th best of these sums is less than the k-th best cosine; a block whose greatest sum of a row and
sum of query weight times block maximum are together less than that has no neighbour and is left out, all others are scored.
The result is exact (weights are single precision), ties go to the smaller example id.

Vote: neighbours weigh 1 / (1.02 - cosine); the toxic share of the votes, with `doubt` votes for clean, goes through a logistic
curve. The curve and the number of neighbours (a power of 2) are those of the least loss over the examples themselves, each without itself and
without the words that it alone has, under the class shares of all labels. `threshold` applies to that probability. A labelled
document is never its own evidence.

Defined results: null ids or texts are not judged; a document without any dimension has no neighbours and is clean; repeated rows of
an id are judged each, and the highest score counts; an id labelled both ways is toxic; null labels are ignored; without toxic or
without clean examples nothing is toxic; very long texts are read whole; other columns are ignored, whatever their names; no rows give no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import slices, small, store, trimmed, utf8
from spanloom.llm.simhash import word_hashes

PER_CLASS = 2000
IDF_POWER = 2.0
MOST_NEIGHBOURS = 512
EVIDENCE = 8
DOUBT = 0.5
THRESHOLD = 0.3
BLOCK = 64
_TOGETHER = 64
_SLICE = 1 << 14

_SCHEMA = "doc_id long, score double, votes double, evidence array<struct<example_id: bigint, toxic: int, cosine: double>>"


def bags(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, word hashes in order, counts) of the rows of a column of lower-case texts that have any word."""
    text, offsets = utf8(column)
    for a, b in slices(offsets, 1 << 20):
        hashes, at = word_hashes(text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for row in range(a, b):
            own = hashes[at[row - a] : at[row - a + 1]]
            if len(own):
                yield row, *np.unique(own, return_counts=True)


class Words:
    """The words of the examples by hash: dimension k is the k-th hash in order."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.bits = max(1, min(28, len(hashes).bit_length()))
        heads = hashes >> np.uint64(64 - self.bits)
        self.first = np.searchsorted(heads, np.arange(1 << self.bits, dtype=np.uint64)).astype(np.int32)
        self.most = int(np.bincount(heads.astype(np.int64)).max()) if len(hashes) else 0

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The dimension of each hash, -1 without one. Hashes of one head follow each other and are few."""
        at = self.first[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        out = np.full(len(hashes), -1, np.int64)
        for k in range(self.most):
            place = np.minimum(at + k, len(self.hashes) - 1)
            same = self.hashes[place] == hashes
            out[same] = place[same]
        return out

    def bags(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row, dimensions in order, counts) of the rows of a column of lower-case texts that have any dimension."""
        text, offsets = utf8(column)
        for a, b in slices(offsets, 1 << 20):
            hashes, at = word_hashes(text[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            dims = self.find(hashes)
            known = dims >= 0
            keys = (np.repeat(np.arange(b - a), np.diff(at))[known] << 32) | dims[known]
            keys.sort()
            if not len(keys):
                continue
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts, keys = np.diff(np.concatenate([new, [len(keys)]])), keys[new]
            row, dims = keys >> 32, keys & 0xFFFFFFFF
            cuts = np.searchsorted(row, np.arange(b - a + 1)).tolist()
            for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                if x < y:
                    yield a + k, dims[x:y], counts[x:y]


def ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    n = end - begin
    return np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)


class BlockMax:
    """Postings of unit vectors (dimensions in order, weights) of examples, by dimension and block of examples."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], dims: int, block: int = BLOCK):
        n = len(ids)
        sizes = np.array([len(d) for d, _ in vectors], np.int64)
        word = np.concatenate([d for d, _ in vectors]) if n else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in vectors]).astype(np.float32) if n else np.zeros(0, np.float32)
        often = np.bincount(word, minlength=dims)
        # examples whose commonest words are the same side by side (so mostly one language) make the block maxima tight
        first = [tuple(d[np.argsort(-often[d], kind="stable")[:3]].tolist()) for d, _ in vectors]
        order = sorted(range(n), key=lambda i: (first[i], int(ids[i])))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.n, self.block, self.blocks = n, block, max(1, -(-n // block))
        self.ids, self.toxic, self.often = np.asarray(ids, np.int64)[order], np.asarray(toxic, np.int8)[order], often.astype(np.int32)
        example = np.repeat(place, sizes)
        wide = often * 8 > n
        self.row = np.full(dims, -1, np.int32)
        self.row[wide] = np.arange(wide.sum())
        self.rows = np.zeros((int(wide.sum()), n), np.float32)
        dense = wide[word]
        self.rows[self.row[word[dense]], example[dense]] = weight[dense]
        word, example, weight = word[~dense], example[~dense], weight[~dense]
        by = np.argsort(word * np.int64(max(1, n)) + example)
        word, self.example, self.weight = word[by], example[by], weight[by].astype(np.float64)
        self.at = np.zeros(1, np.int64)
        if len(word):
            new = np.concatenate([[True], (word[1:] != word[:-1]) | (self.example[1:] // block != self.example[:-1] // block)])
            begin = np.flatnonzero(new)
            self.most, self.of_block = np.maximum.reduceat(self.weight, begin), self.example[begin] // block
            self.begin = np.concatenate([begin, [len(word)]])
            self.at = np.searchsorted(word[begin], np.arange(dims + 1))
        else:
            self.most, self.of_block, self.begin, self.at = np.zeros(0), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(dims + 1, np.int64)

    def sums(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each query (dimensions, weights) and example the part of the cosine that words with rows have."""
        table = np.zeros((len(queries), len(self.rows)), np.float32)
        for q, (dims, weights) in enumerate(queries):
            row = self.row[dims]
            table[q, row[row >= 0]] = weights[row >= 0]
        return table @ self.rows

    def nearest(self, dims: np.ndarray, weights: np.ndarray, k: int, without: int | None = None, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of examples, cosines) of the k nearest with a cosine above 0, in order; the id `without` is left out."""
        found, cosines = self.among_nearest(dims, weights, k, without, sums)
        by = np.lexsort((self.ids[found], -cosines))
        return found[by], cosines[by]

    def among_nearest(self, dims: np.ndarray, weights: np.ndarray, k: int, without: int | None = None, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The same in any order. sums: the query's row of sums()."""
        if not self.n or not len(dims):
            return np.zeros(0, np.int64), np.zeros(0)
        cosines = (self.sums([(dims, weights)])[0] if sums is None else sums).astype(np.float64)
        narrow = self.row[dims] < 0
        lists, own = dims[narrow], weights[narrow]
        begin, end = self.at[lists], self.at[lists + 1]
        entry, factor = ranges(begin, end), np.repeat(own, end - begin)
        padded = np.zeros(self.blocks * self.block)
        padded[: self.n] = cosines
        bound = (np.bincount(self.of_block[entry], self.most[entry] * factor, self.blocks) + padded.reshape(self.blocks, -1).max(axis=1)) * (1 + 1e-5)
        # one more than k: the example itself may be among them
        floor = np.partition(cosines, self.n - k - 1)[self.n - k - 1] * (1 - 1e-5) if self.n > k else 0.0
        now = (bound >= floor) & (bound > 0)
        sel = now[self.of_block[entry]]
        if 2 * np.count_nonzero(sel) > len(sel):  # lists are read whole where most of their blocks are needed
            first, last = self.begin[begin], self.begin[end]
            posts = [slice(x, y) for x, y in zip(first.tolist(), last.tolist())]
            example, weight = np.concatenate([self.example[x] for x in posts]), np.concatenate([self.weight[x] for x in posts])
            cosines += np.bincount(example, weight * np.repeat(own, last - first), self.n)
        elif len(some := entry[sel]):
            first, last = self.begin[some], self.begin[some + 1]
            posts = ranges(first, last)
            cosines += np.bincount(self.example[posts], self.weight[posts] * np.repeat(factor[sel], last - first), self.n)
        if not now.all():
            cosines[~np.repeat(now, self.block)[: self.n]] = 0
        if without is not None:
            cosines[self.ids == without] = 0
        found = np.flatnonzero(cosines >= np.partition(cosines, self.n - k)[self.n - k]) if self.n > k else np.arange(self.n)
        found = found[cosines[found] > 0]
        if len(found) > k:  # ties
            found = found[np.lexsort((self.ids[found], -cosines[found]))][:k]
        return found, cosines[found]


def shares(toxic: np.ndarray, cosines: np.ndarray, doubt: float = DOUBT) -> np.ndarray:
    """The toxic share of the votes of the first 1, 2, 3, ... neighbours."""
    w = 1 / (1.02 - np.minimum(cosines, 1.0))
    return np.cumsum(w * toxic) / (np.cumsum(w) + doubt)


def depths(n: int) -> list[int]:
    """Numbers of neighbours to choose from: powers of 2 up to a sixth of the examples."""
    return [k for k in (1 << i for i in range(2, MOST_NEIGHBOURS.bit_length())) if k <= max(4, n // 6)]


def calibration(own: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Slope and offset of P(toxic | share), by Newton steps on weighted, lightly ridged log-likelihood; and the mean loss."""
    y = toxic.astype(float)
    weight = np.where(y == 1, prior / max(y.sum(), 1), (1 - prior) / max((1 - y).sum(), 1)) * len(y)
    design, beta = np.stack([own, np.ones_like(own)], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 0.05 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(design @ beta, -30, 30))), 1e-9, 1 - 1e-9)
    return float(beta[0]), float(beta[1]), float(-(weight * np.where(y == 1, np.log(p), np.log(1 - p))).mean())


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [(ids[r], toxic[r], h.tobytes(), c.astype(np.int32).tobytes()) for r, h, c in bags(batch.column(2))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ["id", "toxic", "words", "counts"])


def _examples(texts: DataFrame, labels: DataFrame, label_id_col: str, label_col: str, per_class: int) -> tuple[DataFrame, float]:
    """The bounded sample of labelled documents (id, toxic, words, counts), and the share of toxic labels."""
    own = labels.select(F.col(label_id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max(F.when(F.col("toxic") != 0, 1).otherwise(0)).alias("toxic"))
    own = store(own, "labels")
    share = own.agg(F.avg("toxic")).first()[0] or 0.0
    picked = None
    for y in (0, 1):
        some = own.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = some if picked is None else picked.unionAll(some)
    # 2 * per_class ids at most
    rows = texts.join(F.broadcast(picked), "id").select("id", "toxic", "t").mapInArrow(trimmed(_bag_rows), "id long, toxic int, words binary, counts binary")
    return store(rows.groupBy("id").agg(F.min(F.struct("toxic", "words", "counts")).alias("m")).select("id", "m.toxic", "m.words", "m.counts"), "examples"), float(share)


def _document_frequencies(texts: DataFrame, words: Words) -> tuple[np.ndarray, int]:
    """In how many of all documents each of these words is, and the number of documents.

    A task counts in one array; slices of the arrays are added up in the cluster, and their sums alone are collected.
    """
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts, n = np.zeros(len(known), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, dims, _ in known.bags(batch.column(1)):
                counts[dims] += 1
        rows = [(k, counts[i : i + _SLICE]) for k, i in enumerate(range(0, len(counts), _SLICE))]
        rows = [(-1, np.array([n]))] + [(k, c) for k, c in rows if c.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for _, c in rows], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(zlib.decompress(data.as_buffer()), np.int64)
                sums[k] = sums[k] + own if k in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in sums.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    df, n = np.zeros(len(words), np.int64), 0
    for k, data in texts.mapInArrow(trimmed(count), schema).repartition("slice").mapInArrow(add, schema).collect():
        own = np.frombuffer(zlib.decompress(data), np.int64)
        if k < 0:
            n = int(own[0])
        else:
            df[k * _SLICE : k * _SLICE + len(own)] = own
    shared.unpersist()
    return df, n


@dataclass
class Judge:
    """What the examples taught: words, idf, index, and the vote's depth, slope and offset."""

    words: Words
    idf: np.ndarray
    index: BlockMax
    depth: int = MOST_NEIGHBOURS
    slope: float = 0.0
    offset: float = 0.0

    def own_vector(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dimensions and weights of an example, of length 1, without the words that it alone has."""
        dims = self.words.find(hashes)
        twice = self.index.often[dims] > 1
        return unit(dims[twice], counts[twice], self.idf)

    def own_shares(self, rows: list[tuple[int, np.ndarray, np.ndarray]], at: list[int]) -> Iterator[list[float]]:
        """The votes for examples (id, hashes, counts) at several depths, each without itself and its own words."""
        queries = [self.own_vector(hashes, counts) for _, hashes, counts in rows]
        for (i, _, _), (dims, weights), sums in zip(rows, queries, self.index.sums(queries)):
            best, cosines = self.index.nearest(dims, weights, max(at), i, sums)
            own = shares(self.index.toxic[best], cosines)
            yield [float(own[min(k, len(own)) - 1]) for k in at] if len(own) else [0.0] * len(at)

    def verdicts(self, rows: list[tuple[int, np.ndarray, np.ndarray]], threshold: float) -> Iterator[tuple[float, float, list[dict]]]:
        """(probability, share of votes, evidence) of documents (id, dimensions, counts); evidence only from the threshold on."""
        queries = [unit(dims, counts, self.idf) for _, dims, counts in rows]
        for (i, _, _), (dims, weights), sums in zip(rows, queries, self.index.sums(queries)):
            best, cosines = self.index.among_nearest(dims, weights, self.depth, i, sums)
            if not len(best):
                yield 0.0, 0.0, []
                continue
            share = float(shares(self.index.toxic[best], cosines)[-1])
            score = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * share + self.offset))))
            if score < threshold:
                yield score, share, []
                continue
            by = np.lexsort((self.index.ids[best], -cosines))[:EVIDENCE]
            best, cosines = best[by], cosines[by]
            yield score, share, [{"example_id": int(self.index.ids[e]), "toxic": int(self.index.toxic[e]), "cosine": round(float(c), 6)} for e, c in zip(best, cosines)]


def together(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows, some at a time."""
    rows = iter(rows)
    while some := list(islice(rows, _TOGETHER)):
        yield some


def unit(dims: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = (1 + np.log(counts)) * idf[dims]
    dims, w = dims[w > 0], w[w > 0]
    return dims, w / math.sqrt(float(w @ w)) if len(w) else w


def learn(texts: DataFrame, labels: DataFrame, label_id_col: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS) -> Judge | None:
    """The Judge of texts (id, t), t in lower case, by labels; None without examples of both classes."""
    examples, prior = _examples(texts, labels, label_id_col, label_col, per_class)
    sample = sorted((r["id"], r["toxic"], np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.int32)) for r in examples.toLocalIterator())
    toxic = np.array([y for _, y, _, _ in sample], np.int8)
    if not toxic.any() or toxic.all():
        return None
    words = Words(np.unique(np.concatenate([h for _, _, h, _ in sample])))
    df, n = _document_frequencies(texts, words)
    idf = np.log((1 + n) / (1 + df)) ** IDF_POWER
    vectors = [unit(words.find(h), c, idf) for _, _, h, c in sample]
    judge = Judge(words, idf, BlockMax(np.array([i for i, *_ in sample]), toxic, vectors, len(words)))
    del sample, vectors
    shared, at = texts.sparkSession.sparkContext.broadcast(judge), depths(len(toxic))

    def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, y, h, c = (batch.column(k) for k in range(4))
            rows = ((a, np.frombuffer(b.as_buffer(), np.uint64), np.frombuffer(d.as_buffer(), np.int32)) for a, b, d in zip(i.to_pylist(), h, c))
            own = [x for some in together(rows) for x in shared.value.own_shares(some, at)]
            yield pa.RecordBatch.from_arrays([y, pa.array(own, pa.list_(pa.float64()))], ["toxic", "shares"])

    # the loss over the examples is computed side by side
    spread = examples.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism, "id")
    rows = spread.mapInArrow(trimmed(own_votes), "toxic int, shares array<double>").collect()
    table, y = np.array([r["shares"] for r in rows]), np.array([r["toxic"] for r in rows])
    fits = [(*calibration(table[:, k], y, min(max(prior, 1e-3), 1 - 1e-3)), depth) for k, depth in enumerate(at)]
    judge.slope, judge.offset, _, judge.depth = min(fits, key=lambda f: f[2])
    shared.unpersist()
    return judge


def toxic_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, score, votes, evidence) of the documents judged toxic: their probability, the share of votes, the nearest neighbours."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.lower(text_col).alias("t")).where("id is not null and t is not null")
    judge = learn(texts, labels, label_id_col, label_col, per_class)
    if judge is None:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    shared = docs.sparkSession.sparkContext.broadcast(judge)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("votes", pa.float64()), ("evidence", pa.list_(pa.struct([("example_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ids = [], batch.column(0).to_pylist()
            for some in together((ids[row], dims, counts) for row, dims, counts in shared.value.words.bags(batch.column(1))):
                for (i, _, _), (score, share, evidence) in zip(some, shared.value.verdicts(some, threshold)):
                    if evidence:
                        out.append({"doc_id": i, "score": round(score, 6), "votes": round(share, 6), "evidence": evidence})
            yield pa.RecordBatch.from_pylist(out, schema)

    # rows that repeat an id: the highest score counts
    judged = texts.mapInArrow(trimmed(run), _SCHEMA)
    return judged.groupBy("doc_id").agg(F.max(F.struct("score", "votes", "evidence")).alias("m")).select("doc_id", "m.score", "m.votes", "m.evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the ids judged toxic. All columns are kept; rows with null ids or texts stay."""
    out = store(toxic_documents(docs, labels, id_col, text_col, **options).select(F.col("doc_id").alias(id_col)), "toxic")
    return docs.join(small(out, out.count()), id_col, "left_anti").select(*docs.columns)
