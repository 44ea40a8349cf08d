import pytest
from pyspark.sql import functions as F

from folioforge.operators import tracking
from folioforge.sources import layout_reader, store
from folioforge.streaming import activity, lifecycle


def test_windows_equal_in_batch_and_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = activity.windowed(stream, "1 hour", late="3650 days").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert key(spark.table("w")) == key(activity.windowed(events, "1 hour"))


def test_lifecycle_stream(spark, tmp_path):
    steps = ["in_review", "closed", "closed", "in_review", "not_reviewed", "closed"]
    rows = [(f"k{i % 3}", i, steps[i // 3 % 6], (i * 37) % 100) for i in range(36)]
    df = spark.createDataFrame(rows, "key string, event_no long, target string, progress int")
    src = str(tmp_path / "in")
    for lo in (0, 12, 24):
        df.where(f"event_no >= {lo} and event_no < {lo + 12}").coalesce(1).write.mode("append").parquet(src)
    lifecycle.use_rocksdb(spark)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    q = lifecycle.track(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {(r.key, r.event_no): (r.accepted, r.state) for r in tracking.replay(df, ["key"], ["event_no"], "target").collect()}
    got = spark.read.parquet(out).collect()
    assert {(r.key, r.event_no): (r.accepted, r.state) for r in got} == want
    for k in ("k0", "k1", "k2"):
        p = [r.progress for r in sorted(got, key=lambda r: r.event_no) if r.key == k]
        assert p == sorted(p)


def test_upsert_batches(spark, tmp_path):
    put = lifecycle.upsert_batches(str(tmp_path))
    make = lambda rows: spark.createDataFrame(rows, "key string, event_no long, state string, progress int")
    put(make([("a", 1, "x", 5), ("a", 2, "y", 6), ("b", 1, "x", 1)]), 0)
    for _ in range(2):  # a repeated batch changes nothing
        put(make([("a", 3, "z", 9)]), 1)
    now = lambda: sorted(tuple(r) for r in lifecycle.current(spark, str(tmp_path)).collect())
    assert now() == [("a", 3, "z", 9), ("b", 1, "x", 1)]
    # a new checkpoint starts at batch 0 again and goes on with the table
    put(make([("c", 1, "x", 1), ("a", 2, "late", 1)]), 0)
    assert now() == [("a", 3, "z", 9), ("b", 1, "x", 1), ("c", 1, "x", 1)]
    # only touched buckets are written anew
    moved = spark.read.parquet(f"{tmp_path}/marker").groupBy("seq").count().collect()
    assert {r.seq: r["count"] for r in moved} == {0: 2, 1: 1, 2: 1, 3: 2}
    # rows of a batch that failed before its marker count for nothing
    make([("b", 99, "lost", 1)]).selectExpr("*", "0 as bucket", "'g' as generation").write.mode("append").partitionBy("bucket", "generation").parquet(f"{tmp_path}/rows/buckets=16")
    assert ("b", 1, "x", 1) in now() and lifecycle.current(spark, f"{tmp_path}/none") is None
    put(make([]), 9)
    assert ("b", 1, "x", 1) in now()


def test_upsert_buckets_grow_and_are_cleaned(spark, tmp_path):
    put = lifecycle.upsert_batches(str(tmp_path), bucket_rows=10, least=2)
    want = {}
    for i in range(6):
        rows = spark.range(60).selectExpr(f"concat('k', (id * {i + 1}) % 150) as key", f"id + {i} * 100 as event_no", "'s' as state", "cast(id as int) as progress")
        for r in rows.collect():
            want[r.key] = max(want.get(r.key, (-1,)), (r.event_no, r.state, r.progress))
        put(rows, i)
    got = {r.key: (r.event_no, r.state, r.progress) for r in lifecycle.current(spark, str(tmp_path)).collect()}
    assert got == want
    assert spark.read.parquet(f"{tmp_path}/marker").agg(F.max("buckets")).first()[0] >= 4
    kept = [len(list(b.glob("generation=*"))) for b in tmp_path.glob("rows/buckets=*/bucket=*")]
    assert max(kept) <= 2


def test_layout_reader(spark, tmp_path):
    for name, data in (("a.pdf", b"# A"), ("b.pdf", b"  "), ("c.pdf", b"boom")):
        (tmp_path / name).write_bytes(data)

    def reader(data):
        if data == b"boom":
            raise layout_reader.Throttled("busy")
        return data.decode()

    got = {r.path[-5:]: (r.markdown, r.error) for r in layout_reader.read_layout(spark, str(tmp_path), reader, (0.0, 0.0)).collect()}
    assert got == {"a.pdf": ("# A", None), "b.pdf": (None, "empty text"), "c.pdf": (None, "throttled: busy")}


def test_index(spark, tmp_path):
    path = str(tmp_path / "index")
    made = spark.createDataFrame([("d", 0, None), ("d", 1, 0)], "document_id string, chunk_index int, parent_chunk_index int").withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    for a in ("a1", "a2", "a1"):
        store.write_index(store.index_ids(made, a), path)
    rows = spark.read.parquet(path)
    assert rows.count() == 4
    found, cut = store.chunks_of(rows, "a1", cap=1)
    assert cut and found.first().id == "a1--d--0" and rows.where("parent_chunk_id = 'a2--d--0'").count() == 1
    assert store.delete_index(spark, path, "a1") == 2 and spark.read.parquet(path).count() == 2 and store.delete_index(spark, str(tmp_path / "none"), "x") == 0
    store.check_contract(made, ["embedding"], 2)
    with pytest.raises(ValueError):
        store.check_contract(made, ["embedding"], 3)
    with pytest.raises(ValueError):
        store.check_contract(made, ["title"])


def test_defaults_and_sinks(spark):
    raw = spark.createDataFrame([(None, None, None, '{"table_id":"t","row_index":2,"headers":["a"]}', "no json")], "section_path string, block_type string, chunk_type string, table_ref string, blocks string")
    r = store.with_defaults(raw).first()
    assert (r.section_path, r.block_type, r.chunk_type, r.table_ref.row_index, r.blocks) == ("general", "paragraph", "normal", 2, None)
    seen = []
    failed = store.write_all(raw, {"bad": lambda df: 1 / 0, "good": lambda df: seen.append(df.count())})
    assert seen == [1] and list(failed) == ["bad"]
