import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from folioforge.streaming import lifecycle, limits

START = datetime(2024, 5, 1, 12, 0)
KINDS = "key string, ts timestamp, event_no long, status string, progress int, pages int"


def at(minutes):
    return START + timedelta(minutes=minutes)


def events(seed=2):
    r = random.Random(seed)
    rows = []
    for k in range(25):
        begin, n = r.uniform(0, 60), r.choice([1, 2, 5, 9])
        times = sorted(begin + r.uniform(0, r.choice([5, 30])) for _ in range(n))
        for i, t in enumerate(times):
            rows.append((f"k{k}", at(round(t, 3)), i, r.choice(["analyzing", "analyzing", "analyzing", "completed", "cancelled", None]), r.choice([None, r.randrange(0, 130)]), r.choice([10, 80, 150, 400, None])))
    rows += [("same", at(3), 1, "analyzing", 5, 10), ("same", at(3), 1, "analyzing", 5, 10), ("same", at(3), 2, "completed", 99, 10), ("at-limit", at(1), 0, "queued", 1, 10), ("at-limit", at(9), 1, "completed", 50, 10)]
    return rows


def plain(rows, until):
    """The rules, one analysis at a time."""
    out = []
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2], r[3] is not None, r[3] or "", r[4] or 0))
        p = own[0][5] or 0
        deadline = own[0][1] + timedelta(minutes=8 if p <= 50 else 12 if p <= 100 else 18 if p <= 200 else 25)
        most, n, end = 0, 0, None
        for _, t, _, status, progress, _ in own:
            if t > deadline:
                break
            most, n = max(most, progress or 0), n + 1
            if status in ("completed", "cancelled"):
                end = (t, status, min(100, most))
                break
        end = end or (deadline, "error", min(95, most))
        if end[0] <= until:
            out.append((key, *end, n))
    return sorted(out)


def as_rows(df):
    return sorted((x.key, x.ended_at, x.status, x.progress, x.n_events) for x in df.collect())


def test_batch(spark):
    rows = events()
    df = spark.createDataFrame([*rows, (None, at(1), 1, "completed", 1, 1), ("none", None, 1, "completed", 1, 1)], KINDS)
    assert as_rows(limits.ended(df, at(500))) == plain(rows, at(500))
    assert as_rows(limits.ended(df)) == plain(rows, max(r[1] for r in rows))
    assert limits.ended(df.limit(0), at(1)).collect() == []


def test_stream_with_late_rows_equals_batch_and_forgets(spark, tmp_path):
    rows, r = events(), random.Random(5)
    # arrival: by time, each row up to nine minutes late, in small files
    order = sorted(rows, key=lambda x: x[1] + timedelta(minutes=r.uniform(0, 9)))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [order[i : i + 12] for i in range(0, len(order), 12)]
    parts += [[("tick", at(120 + 1600 * i), 0, "analyzing", 0, 10)] for i in range(3)]
    conf = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = spark.conf.get(conf[1])
    lifecycle.use_rocksdb(spark)
    spark.conf.set(conf[1], "2")
    try:
        for part in parts:  # one file a batch, in order of arrival
            spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(KINDS).parquet(src)
            q = limits.watch(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset(conf[0])
        spark.conf.set(conf[1], before)
    got = [x for x in as_rows(spark.read.parquet(out)) if x[0] != "tick"]
    assert got == plain(rows, at(10_000))
    # the state of ended analyses has gone; what is left is of the last tick
    left = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "run").load()
    assert left.select(F.col("key").getField("key")).distinct().count() <= 1


def test_cancels_in_batch_and_stream(spark, tmp_path):
    r = random.Random(8)
    runs = [(i, f"k{r.randrange(6)}", at(r.uniform(0, 300))) for i in range(60)]
    cancels = [(f"k{r.randrange(8)}", at(r.uniform(0, 330))) for _ in range(40)]
    a = spark.createDataFrame(runs, "run_id long, key string, started_at timestamp")
    b = spark.createDataFrame(cancels, "key string, requested_at timestamp")
    want = sorted(((i, k, s, c) for i, k, s in runs for c in ([t for k2, t in cancels if k == k2 and s <= t <= s + timedelta(minutes=25)] or [None])), key=repr)
    rows = lambda df: sorted((tuple(x) for x in df.collect()), key=repr)
    assert rows(limits.with_cancels(a, b)) == want
    one, two, out = (str(tmp_path / x) for x in ("a", "b", "out"))
    late = lambda row, t: t + timedelta(minutes=r.uniform(0, 9))
    own = sorted(runs, key=lambda x: late(x, x[2]))
    req = sorted(cancels, key=lambda x: late(x, x[1]))
    steps = [(own[i : i + 20], [c for c in req if not i or c[1] >= at(0)][i * 40 // 60 : (i + 20) * 40 // 60]) for i in range(0, 60, 20)]
    steps += [([(1000 + i, "tick", at(900 + i))], [("tick", at(990 + i))]) for i in range(2)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for x, y in steps:
            spark.createDataFrame(x, a.schema).coalesce(1).write.mode("append").parquet(one)
            spark.createDataFrame(y, b.schema).coalesce(1).write.mode("append").parquet(two)
            joined = limits.with_cancels(spark.readStream.schema(a.schema).parquet(one), spark.readStream.schema(b.schema).parquet(two), late="200 minutes")
            q = joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [x for x in rows(spark.read.parquet(out)) if x[0] < 1000] == want


