"""An archive of web captures with a two-level index: sorted, compressed blocks of lines and a sparse directory.

Archive: each task writes one file of records, each a WARC resource record compressed for itself, so that any one is read by range.
Only the place of a record (file, offset, length) and the digest of its body go on. Index: captures are sorted by reversed-host key
("com,example,www)/path?query") and id, by range over the cluster; each task writes one
file of compressed blocks of `entries` lines, ended by the file's directory: first key, offset and length of each block.
A manifest (one row for each file: first and last key) is the upper level and names only files of tasks that succeeded.
An index has MOST_FILES files at most, of as many lines as that takes, which bounds the manifest.

Lookup: a range of keys goes to the files whose keys it can meet, by binary search in the manifest; there by binary search
in the directory to its blocks, which alone are read, by range, and unpacked. Records are then read by range, file by file. Files are read through
pyarrow's file systems (local, hdfs, s3, gs), from the shared folder of the cluster.

Defined results: null urls and ids are neither archived nor indexed; a null body is an empty one; an empty url has the key ")/"; repeated captures are
listed once each time they occur; a key with any number of captures, over several blocks or files, is found whole; very long bodies are one
record each; other columns are ignored, whatever their names; an empty table makes an index of no files, in which nothing is found.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import partitions, pieces, store, trimmed
from spanloom.session import fresh_path
from spanloom.sources.files import resolve

ENTRIES = 3000
#: Lines of a file of the index, and files: beyond, files have more lines.
FILE_LINES = 1_000_000
MOST_FILES = 65_536
URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:@]*)(:[0-9]*)?([^?#]*)([?][^#]*)?"


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, lower case, without scheme, user, default port and fragment; path "/" if empty."""
    host, port, path, query = (F.regexp_extract(url, URL, i) for i in (1, 2, 3, 4))
    port = F.when(port.isin(":80", ":443", ":"), "").otherwise(port)
    path = F.when(path == "", "/").otherwise(path)
    return F.concat(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","), port, F.lit(")"), path, query)


_PLACE = ("file", "offset", "length", "digest")


def record(url: str, body: bytes) -> bytes:
    """One compressed record."""
    head = f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", 4, mtime=0)


def parsed(data: bytes) -> tuple[str, bytes]:
    """(url, body) of a compressed record."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields["WARC-Target-URI"], rest[: int(fields["Content-Length"])]


def _archiver(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name = None, ""
        for batch in pieces(batches, 256):
            rows = []
            for capture, key, url, body in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"  # a task that runs again writes another file
                    system, path = resolve(name)
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)  # a name must not choose it
                raw = (body or "").encode()
                # a line end in a url would begin another header
                data = record(" ".join(url.split("\r")).replace("\n", " "), raw)
                rows.append((key, capture, name, out.tell(), len(data), hashlib.md5(raw).hexdigest()))
                out.write(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["key", "id", *_PLACE])
        if out is not None:
            out.close()

    return run


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes records into the shared folder; (key, id, file, offset, length, digest) of each."""
    own = pages.select(F.col(id_col).cast("long").alias("id"), url_key(F.col(url_col)).alias("key"), F.col(url_col).alias("url"), F.col(body_col).alias("body")).where("key is not null and id is not null")
    return store(own.mapInArrow(trimmed(_archiver(fresh_path(pages.sparkSession, "archive"))), "key string, id long, file string, offset long, length long, digest string"), "records")


def _line(entry: list) -> bytes:
    return json.dumps(entry, ensure_ascii=False).encode() + b"\n"


def _writer(folder: str, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, directory, lines, first, last, name = None, [], [], None, None, ""

        def close_block() -> None:
            data = zlib.compress(b"".join(lines), 6)
            directory.append([first, out.tell(), len(data)])
            out.write(data)
            lines.clear()

        for batch in batches:
            for entry in zip(*(c.to_pylist() for c in batch.columns)):
                key = entry[0]
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.blocks"  # a task that runs again writes another file
                    system, path = resolve(name)
                    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(path, compression=None)  # a name must not choose it
                    lowest = key
                if not lines:
                    first = key
                lines.append(_line(list(entry)))
                last = key
                if len(lines) >= entries:
                    close_block()
        if out is None:
            return
        if lines:
            close_block()
        end = out.tell()
        footer = zlib.compress(json.dumps(directory, ensure_ascii=False).encode(), 6)
        out.write(footer)
        out.write(end.to_bytes(8, "little"))
        size = out.tell()
        out.close()
        yield pa.RecordBatch.from_pylist([{"file": name, "first_key": lowest, "last_key": last, "blocks": len(directory), "size": size}], pa.schema([("file", pa.string()), ("first_key", pa.string()), ("last_key", pa.string()), ("blocks", pa.int32()), ("size", pa.int64())]))

    return run


def build(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", entries: int = ENTRIES) -> DataFrame:
    """Writes archive and index into the shared folder; the manifest: (file, first_key, last_key, blocks, size)."""
    spark = pages.sparkSession
    records = archive(pages, id_col, url_col, body_col)
    files = min(MOST_FILES, max(partitions(spark), records.count() // FILE_LINES))
    ordered = records.select("key", "id", *_PLACE).repartitionByRange(files, "key", "id").sortWithinPartitions("key", "id")
    return store(ordered.mapInArrow(_writer(fresh_path(spark, "captures"), entries), "file string, first_key string, last_key string, blocks int, size long"), "manifest")


class BlockReader:
    """Reads one file of the index; keeps its directory and the last block."""

    def __init__(self, name: str, size: int):
        system, path = resolve(name)
        self.file = system.open_input_file(path)
        end = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.directory = json.loads(zlib.decompress(self.file.read_at(size - 8 - end, end)))
        self.firsts = [d[0] for d in self.directory]
        self.block, self.lines, self.read = -1, [], 0

    def load(self, block: int) -> list[list]:
        if block != self.block:
            _, offset, length = self.directory[block]
            self.lines = [json.loads(x) for x in zlib.decompress(self.file.read_at(length, offset)).split(b"\n") if x]
            self.block, self.read = block, self.read + 1
        return self.lines

    def between(self, low: str, high: str) -> Iterator[list]:
        """Lines with low <= key <= high."""
        block = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while block < len(self.firsts) and self.firsts[block] <= high:
            lines = self.load(block)
            yield from lines[bisect.bisect_left(lines, low, key=lambda x: x[0]) : bisect.bisect_right(lines, high, key=lambda x: x[0])]
            block += 1


_FOUND = "low string, high string, key string, capture long, file string, offset long, length long, digest string"


def lookup(manifest: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows (low, high, key, capture, file, offset, length, digest) for every capture with low <= key <= high, of each distinct row (low, high) of ranges."""
    files = sorted((r["first_key"], r["last_key"], r["file"], r["size"]) for r in manifest.collect())  # MOST_FILES at most
    if not files:
        return manifest.sparkSession.createDataFrame([], _FOUND)
    firsts, lasts = [f[0] for f in files], [f[1] for f in files]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for low, high in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in range(bisect.bisect_left(lasts, low), bisect.bisect_right(firsts, high)):
                    for col, x in zip(out, (f, low, high)):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["file", "low", "high"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at = None, -1
        types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["low", "high", "key", "capture", *_PLACE]
        for batch in batches:
            out: list[tuple] = []
            for f, low, high in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if f != at:
                    reader, at = BlockReader(files[f][2], files[f][3]), f
                for line in reader.between(low, high):
                    out.append((low, high, *line))
                    if len(out) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    asked = ranges.select(F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high")).where("low is not null and high is not null").distinct()
    routed = asked.mapInArrow(route, "file int, low string, high string").repartition("file").sortWithinPartitions("file", "low", "high")
    return routed.mapInArrow(trimmed(read), _FOUND)


def bodies(found: DataFrame) -> DataFrame:
    """found(key, capture, file, offset, length, digest) with the url and body of each record, read by range; a body that isn't what was written is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        for batch in pieces(batches, 64):
            urls, texts = [], []
            for name, offset, length, digest in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                if name != now:
                    system, path = resolve(name)
                    now, file = name, system.open_input_file(path)
                url, raw = parsed(file.read_at(length, offset))
                if hashlib.md5(raw).hexdigest() != digest:
                    raise ValueError(f"{name} at {offset}: the record is damaged")
                urls.append(url)
                texts.append(raw.decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(urls, pa.string()), pa.array(texts, pa.string()), batch.column(5)], ["key", "capture", "url", "body", "digest"])

    # a file's records may be many: they are spread by place, and each task reads them in order
    places = found.select("key", "capture", *_PLACE).repartition("file", F.floor(F.col("offset") / F.lit(16 << 20))).sortWithinPartitions("file", "offset")
    return places.mapInArrow(trimmed(run), "key string, capture long, url string, body string, digest string")


def captures_of(manifest: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows (urlkey, page_id, digest, n_chars): every capture of every url, each key once, with what its record says."""
    key = url_key(F.col(url_col))
    found = lookup(manifest, urls.select(key.alias("low"), key.alias("high")))
    return bodies(found).select(F.col("key").alias("urlkey"), F.col("capture").alias("page_id"), F.md5("body").alias("digest"), F.length("body").cast("long").alias("n_chars"))
