"""Lifecycle state of analyses over a stream of events."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioforge.operators.tracking import ALLOWED

OUT = "key string, event_no long, target string, accepted boolean, state string, progress int"


class Tracker(StatefulProcessor):
    """State per key: review status and highest progress.  A rejected request
    changes neither; progress never falls."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string, progress int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, progress = self.now.get() if self.now.exists() else ("not_reviewed", 0)
        out = []
        frames = list(rows)  # the batch's rows of one key may come in several frames
        if frames:
            for r in pd.concat(frames).sort_values("event_no", kind="stable").itertuples(index=False):
                ok = r.target in ALLOWED.get(state, ())
                state = r.target if ok else state
                progress = min(100, max(progress, int(r.progress)))
                out.append((key[0], r.event_no, r.target, ok, state, progress))
        self.now.update((state, progress))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def track(events: DataFrame) -> DataFrame:
    """events (a stream): key, event_no, target, progress -> OUT.  Needs
    :func:`use_rocksdb`."""
    return events.groupBy("key").transformWithStateInPandas(Tracker(), OUT, "Append", "None")


#: Rows that a bucket should hold, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 16


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def _marked(spark: SparkSession, path: str) -> tuple[int, DataFrame] | None:
    """Number of buckets, and (bucket, generation, n_rows, seq) of the table as it stands."""
    if not _exists(spark, f"{path}/marker"):
        return None
    rows = spark.read.parquet(f"{path}/marker")
    buckets = rows.agg(F.max("buckets")).first()[0]  # it only grows
    return buckets, rows.where(F.col("buckets") == buckets).groupBy("bucket").agg(F.max_by(F.struct("generation", "n_rows", "seq"), "seq").alias("x")).select("bucket", "x.*")


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that :func:`upsert_batches` keeps below ``path``; None before any."""
    marked = _marked(spark, path)
    if marked is None:
        return None
    buckets, moved = marked
    rows = spark.read.parquet(f"{path}/rows/buckets={buckets}")
    # a row per bucket
    return rows.join(F.broadcast(moved.select("bucket", "generation")), ["bucket", "generation"]).drop("bucket", "generation")


def upsert_batches(path: str, bucket_rows: int = BUCKET_ROWS, least: int = LEAST_BUCKETS):
    """A foreachBatch body that keeps the last row of each key below ``path``.

    Keys are dealt into buckets, as many as hold ``bucket_rows`` rows each: a batch
    rewrites the buckets that it touches, so what it writes follows what it
    brings, not the table.  When buckets have grown to twice that, their number
    is doubled once, for all of the table.  A rewritten bucket is a generation of
    its own (rows/buckets=/bucket=/generation=); a row in the marker then says
    which generation a bucket has.  Generations that neither the last nor the
    marker before it names are deleted afterwards, so a reader may finish.

    A batch that is repeated after a failure makes generations anew and marks
    those, whether it had come to its marker or not, so it ends in the same
    table.  The order of events decides, not that of batches, so a stream that
    starts over with a new checkpoint goes on with the same table.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        generation = uuid.uuid4().hex
        marked, old = _marked(spark, path), current(spark, path)
        buckets, seq, total = least, 0, 0
        if marked is not None:
            buckets, (seq, total) = marked[0], marked[1].agg(F.max("seq") + 1, F.sum("n_rows")).first()
        grown = buckets
        while total > 2 * bucket_rows * grown:
            grown *= 2
        of_key = F.pmod(F.xxhash64("key"), F.lit(grown)).cast("int")
        new = batch.select("key", "event_no", "state", "progress").withColumn("bucket", of_key)
        if old is not None:
            kept = old.withColumn("bucket", of_key)
            if grown == buckets:  # a row per bucket
                kept = kept.join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi")
            new = new.unionByName(kept)
        last = new.groupBy("bucket", "key").agg(F.max_by(F.struct("event_no", "state", "progress"), "event_no").alias("s"))
        rows = last.select("key", "s.*", "bucket", F.lit(generation).alias("generation"))
        at = f"{path}/rows/buckets={grown}"
        rows.repartition("bucket").write.mode("append").partitionBy("bucket", "generation").parquet(at)
        if _exists(spark, at):
            sizes = spark.read.parquet(at).where(F.col("generation") == generation).groupBy("bucket").agg(F.count("*").alias("n_rows"))
            sizes.select("bucket", F.lit(generation).alias("generation"), "n_rows", F.lit(seq).cast("long").alias("seq"), F.lit(grown).alias("buckets")).coalesce(1).write.mode("append").parquet(f"{path}/marker")
            _clean(spark, path, grown)

    return put


def _clean(spark: SparkSession, path: str, buckets: int) -> None:
    """Delete what neither of the last two marks of a bucket names."""
    by = Window.partitionBy("bucket").orderBy(F.desc("seq"))
    marks = spark.read.parquet(f"{path}/marker").where(F.col("buckets") == buckets)
    last = marks.agg(F.max("seq")).first()[0]
    ranked = marks.withColumn("no", F.row_number().over(by))
    # only buckets of the last batch have something new to delete
    fresh = ranked.where(F.col("no") <= 2).groupBy("bucket").agg(F.collect_set("generation").alias("named"), F.max("seq").alias("seq")).where(F.col("seq") == last)
    for r in fresh.collect():
        fs, at = _files(spark, f"{path}/rows/buckets={buckets}/bucket={r.bucket}")
        for x in fs.listStatus(at):
            if x.getPath().getName().removeprefix("generation=") not in r.named:
                fs.delete(x.getPath(), True)
