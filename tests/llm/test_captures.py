import hashlib
import random

import pytest
from pyspark.sql import functions as F

from spanloom.llm import capture_index as c

PAGES = "page_id long, url string, html string, key string"


def key(url):
    from urllib.parse import urlsplit

    u = urlsplit(url)
    port = "" if u.port in (None, 80, 443) else f":{u.port}"
    return ",".join(reversed(u.hostname.split("."))) + port + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def body(i):
    return None if i is not None and i % 11 == 3 else f"<p>é {i}\r\n\r\n" * ((i or 0) % 40)


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, body(i), "k") for i, u in rows], PAGES)


def row(k, i):
    text = body(i) or ""
    return k, i, hashlib.md5(text.encode()).hexdigest(), len(text)


def corpus():
    rng = random.Random(3)
    rows = [(i, f"http{rng.choice(['', 's'])}://{rng.choice(['a.', 'b.', 'WWW.', ''])}site{rng.randrange(9)}.example.com{rng.choice(['', ':80', ':8080'])}{rng.choice(['', '/', '/p/' + str(rng.randrange(20))])}{rng.choice(['', '?q=é', '#top'])}") for i in range(3000)]
    return rows + [(5000 + i, "https://hot.example.com/x") for i in range(700)]


@pytest.mark.parametrize("entries", [7, 3000])
def test_every_capture_is_found(spark, entries):
    rows = corpus()
    manifest = c.build(pages_of(spark, rows), entries=entries)
    got = sorted(map(tuple, c.captures_of(manifest, pages_of(spark, rows)).collect()))
    assert got == sorted(row(key(u), i) for i, u in rows)


def test_ranges_and_reads(spark):
    rows = corpus()
    manifest = c.build(pages_of(spark, rows), entries=50)
    asked = spark.createDataFrame([("com,example,site3", "com,example,site3￿"), ("com,example,zz", "com,example,zzz"), ("", "￿"), ("b", "a"), (None, "x")], "low string, high string")
    got = c.lookup(manifest, asked).collect()
    keys = sorted((key(u), i) for i, u in rows)
    for low, high in (("com,example,site3", "com,example,site3￿"), ("", "￿")):
        assert sorted((r["key"], r["capture"]) for r in got if r["low"] == low) == [k for k in keys if low <= k[0] <= high]
    assert not [r for r in got if r["low"] in ("com,example,zz", "b")]
    r = manifest.orderBy(F.desc("blocks")).first()
    reader = c.BlockReader(r["file"], r["size"])
    first = next(iter(reader.between(r["last_key"], r["last_key"])))
    assert first[0] == r["last_key"] and reader.read <= 2 < r["blocks"] and len(list(reader.between(r["first_key"], r["last_key"]))) > 50


def test_records_are_read_by_range(spark):
    rows = corpus()[::7]
    records = c.archive(pages_of(spark, rows))
    url = dict(rows)
    for r in records.limit(50).collect():
        system, path = c.resolve(r["file"])
        with system.open_input_file(path) as f:
            assert c.parsed(f.read_at(r["length"], r["offset"])) == (url[r["id"]], (body(r["id"]) or "").encode())
    found = records.select("key", F.col("id").alias("capture"), "file", "offset", "length", "digest")
    assert sorted((r["capture"], r["url"], r["body"]) for r in c.bodies(found).collect()) == sorted((i, u, body(i) or "") for i, u in rows)
    with pytest.raises(Exception, match="damaged"):
        c.bodies(found.withColumn("digest", F.lit("x"))).count()


def test_edges(spark):
    rows = [(1, None), (None, "http://a.b/"), (2, ""), (3, "http://a.b/\n\t\"x"), (4, "http://a.b/" + "y" * 100_000), (4, "http://a.b/" + "y" * 100_000)]
    pages = pages_of(spark, rows)
    found = sorted(map(tuple, c.captures_of(c.build(pages), pages).collect()))
    got = [r[:2] for r in found]
    assert all(r == row(*r[:2]) for r in found)
    assert got == sorted([(")/", 2), ('b,a)/\n\t"x', 3), ("b,a)/" + "y" * 100_000, 4), ("b,a)/" + "y" * 100_000, 4)])
    none = c.build(pages.where("false"))
    assert none.count() == 0 and c.captures_of(none, pages).count() == 0
