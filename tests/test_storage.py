import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import index
from spanloom.operators.windows import compact_windows
from spanloom.session import clean, fresh_path, materialise, scratch, shared_folder, ship
from spanloom.sources import corpus_bin, doc_bundle, files, tables
from spanloom.streaming import ingest

WINDOW = ["h", "token", "doc_id", "l", "c", "r"]


def docs_of(spark, n=40):
    rng = random.Random(7)
    return spark.createDataFrame([(i, rng.choices(range(20), k=rng.randint(0, 60))) for i in range(n)], "doc_id long, tokens array<int>")


def rows(df):
    return sorted(map(tuple, df.select(WINDOW).collect()))


def test_corpus_bin_round_trip(spark, tmp_path):
    corpus_bin.register(spark)
    docs = docs_of(spark).unionAll(spark.createDataFrame([(99, None), (100, [-1, 2**31 - 1])], "doc_id long, tokens array<int>"))
    docs.select("tokens").repartition(3).write.format("corpus_bin").mode("append").save(str(tmp_path / "c"))
    back = spark.read.format("corpus_bin").load(str(tmp_path / "c"))
    key = lambda df: sorted(tuple(r["tokens"]) for r in df.collect() if r["tokens"] is not None)
    assert key(back) == key(docs)
    assert back.groupBy("file").agg((F.max("ordinal") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0
    docs.limit(2).select("tokens").write.format("corpus_bin").mode("overwrite").save(str(tmp_path / "c"))
    assert spark.read.format("corpus_bin").load(str(tmp_path / "c")).count() == 2


def test_corpus_bin_files(tmp_path):
    (tmp_path / "a.bin").write_bytes(corpus_bin.record([1, 2]) + corpus_bin.record([]) + corpus_bin.record([-7]))
    (tmp_path / ".hidden").write_bytes(b"x")
    assert files.list_files(f"file://{tmp_path}") == [(str(tmp_path / "a.bin"), 24)] == files.list_files(str(tmp_path / "a.bin"))
    with pytest.raises(FileNotFoundError):
        files.list_files(str(tmp_path / "none"))
    assert [a.tolist() for a in corpus_bin.read_records(str(tmp_path / "a.bin"))] == [[1, 2], [], [-7]]
    for bad in (b"\x02\0\0\0abc", b"\xff\xff\xff\xff"):
        (tmp_path / "b.bin").write_bytes(bad)
        with pytest.raises(ValueError):
            list(corpus_bin.read_records(str(tmp_path / "b.bin")))


def test_epochs_merge_and_repeat(spark):
    docs, path = docs_of(spark), fresh_path(spark, "epochs")
    for e in (0, 1, 1, 2):  # one epoch is written twice, as after a crash
        tables.write_windows(compact_windows(ingest.epochs(docs, 15).where(F.col("epoch") == e), 2, 3), path, e, mode="overwrite")
    want = rows(compact_windows(docs, 2, 3))
    assert rows(tables.read_windows(spark, path)) == want
    out = fresh_path(spark, "compacted")
    tables.compact_epochs(spark, path, out)
    assert rows(tables.read_windows(spark, out)) == want
    plan = tables.read_windows(spark, out).where("h = 1 and token = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(h" in plan and "EqualTo(token,3)" in plan


def test_stream_equals_batch(spark):
    docs, source, out = docs_of(spark), fresh_path(spark, "in"), fresh_path(spark, "out")
    docs.repartition(5).write.parquet(source)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(source)
    ingest.ingest(spark, stream, out, fresh_path(spark, "progress"), 2, 3).awaitTermination()
    assert rows(tables.read_windows(spark, out)) == rows(compact_windows(docs, 2, 3))
    assert spark.read.parquet(out).select("epoch").distinct().count() > 1


def test_session_helpers(spark, tmp_path):
    ship(spark)
    ship(spark)
    assert shared_folder(spark) == shared_folder(spark) and materialise(spark.range(3), "t").count() == 3
    (tmp_path / "s.txt").write_text("the\n a \n\nthe\n")
    assert sorted(r[0] for r in tables.read_stopwords(spark, str(tmp_path / "s.txt")).collect()) == ["a", "the"]
    assert tables.random_access(spark.range(9).withColumnRenamed("id", "doc_id"), [2, 4]).count() == 2


def test_corpus_bin_is_read_in_parts(spark, tmp_path):
    corpus_bin.register(spark)
    rng = random.Random(3)
    docs = spark.createDataFrame([([rng.randrange(1000)] * rng.randrange(30),) for _ in range(2000)], "tokens array<int>")
    docs.coalesce(1).write.format("corpus_bin").mode("append").save(str(tmp_path / "c"))
    whole = spark.read.format("corpus_bin").load(str(tmp_path / "c"))
    parts = spark.read.format("corpus_bin").option("split", 20_000).load(str(tmp_path / "c"))
    assert whole.rdd.getNumPartitions() == 1 and parts.rdd.getNumPartitions() > 3
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect())) and parts.count() == 2000
    docs.limit(1).write.format("corpus_bin").mode("overwrite").save(str(tmp_path / "c"))
    assert len(list((tmp_path / "c").iterdir())) == 2  # a file and its marks


def test_doc_bundles(spark, tmp_path):
    doc_bundle.register(spark)
    rng = random.Random(4)
    rows = [(f"d{i}", t := [rng.randrange(-5, 1000) for _ in range(rng.randrange(40))], [7 * k for k in range(len(t))]) for i in range(300)]
    schema = "name string, tokens array<int>, offsets array<int>"
    spark.createDataFrame([*rows, (None, [1], [1]), ("none", None, None)], schema).repartition(2).write.format("doc_bundle").mode("append").save(str(tmp_path / "b"))
    for split in (10**9, 500):
        back = spark.read.format("doc_bundle").option("split", split).load(str(tmp_path / "b"))
        assert sorted((r.name, r.tokens, r.offsets) for r in back.collect()) == sorted(rows)
    assert back.rdd.getNumPartitions() > 4
    bundle = back.first()["bundle"]
    assert set(doc_bundle.bundle_names(bundle)) <= {r[0] for r in rows} and doc_bundle.read_ints(f"{bundle}.split")[0] == 0
    with pytest.raises(Exception, match="offset"):
        spark.createDataFrame([("x", [1, 2], [1])], schema).write.format("doc_bundle").mode("append").save(str(tmp_path / "bad"))
    assert files.list_files(str(tmp_path / "bad")) == []


def test_stopword_token_files(spark, tmp_path):
    corpus_bin.register(spark)
    tables.write_stopword_tokens(spark.createDataFrame([(5,), (2,), (5,)], "token int"), str(tmp_path / "s"))
    assert (next((tmp_path / "s").glob("part*"))).read_bytes() == corpus_bin.record([2, 5])
    assert sorted(r[0] for r in tables.read_stopword_tokens(spark, str(tmp_path / "s")).collect()) == [2, 5]


def test_order_of_stored_windows(spark):
    own, good, bad = compact_windows(docs_of(spark, 200), 2, 3), fresh_path(spark, "sorted"), fresh_path(spark, "shuffled")
    tables.write_windows(own, good)
    own.orderBy(F.rand(1)).write.parquet(bad)
    n = own.count()
    assert tuple(index.order_violations(spark, good).first()) == (0, n)
    violations, windows = index.order_violations(spark, bad).first()
    assert windows == n and violations > n / 4


def test_scratch_is_deleted(spark):
    import os

    kept = materialise(spark.range(3), "kept")
    path = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(path))
    with scratch(spark):
        assert materialise(spark.range(5), "gone").count() == 5 and set(os.listdir(path)) > before
    assert set(os.listdir(path)) == before and kept.count() == 3
    clean(spark)
    assert not any(x.startswith("kept") for x in os.listdir(path))
