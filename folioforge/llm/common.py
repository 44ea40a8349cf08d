"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scripts written without spaces (Thai, Lao, Myanmar, Khmer, kana, ideographs): there a character is a token.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u9fff"
OWN_SCRATCH = "/tmp/checkpoints"
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``).

    Only where that setting is absent and everything runs in one process, as in
    tests, a local folder is set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(OWN_SCRATCH)
        found = OWN_SCRATCH
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing exists there yet."""
    path = f"{shared_dir(spark)}/folioforge/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession):
    """What operators write into the shared folder inside the block is deleted at
    its end, so results must have been written by then (``materialize`` with
    ``keep``).  Outside any scope the folders are left to the cluster."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in made:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


#: Rows of a table of numbers that a task writes at least, and tasks that may always write.
TASK_ROWS, FEW_TASKS = 50_000, 24


def materialize(df: DataFrame, name: str, keep: bool = False, most_rows: int | None = None, long_rows: bool = False) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Cuts the lineage: a lost executor costs the rereading of a file, never the
    recomputation of what lies before, and a frame that is used twice is
    computed once.  With ``most_rows``, a bound on the rows of a frame of short rows,
    no more tasks write (and leave files) than they need: where Spark doesn't
    merge small partitions, a writing task costs more than its few rows.  With
    ``long_rows``, for rows of megabytes, Parquet looks at a page's size after every
    row and not first after a hundred: a page is held whole, and once more outside
    the heap by what compresses or inflates it, so its bytes must be bounded.
    """
    if most_rows is not None:
        df = df.coalesce(max(FEW_TASKS, -(-most_rows // TASK_ROWS)))
    path = scratch(df.sparkSession, name)
    if keep and (made := _made.get()):
        made.remove(path)
    (df.write.option("parquet.page.size.row.check.min", 1) if long_rows else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: int | str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most_bytes`` of text in ``column``.

    What a worker makes of a slice (strings, sets, ids) is a multiple of its
    text; so its memory depends neither on the number of rows of an Arrow batch
    nor on the length of most texts.  A single longer text is a slice of its own.
    """
    for b in batches:
        start = size = 0
        at = column if isinstance(column, int) else b.schema.get_field_index(column)
        for i, n in enumerate(pc.binary_length(b.column(at)).to_pylist()):
            if size and size + (n or 0) > most_bytes:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += n or 0
        if start < b.num_rows or not b.num_rows:
            yield b.slice(start)


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Arrow batches, and batches of the Parquet reader, of ``most`` rows for what
    runs inside the block.

    An executor builds an Arrow batch outside its heap and the reader joins a
    batch's texts in one array, so rows of megabytes must not meet in batches of
    the usual 10000 and 4096.
    """
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(key) for key in keys]
    for key in keys:
        spark.conf.set(key, str(most))
    try:
        yield
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value)


# hot keys -------------------------------------------------------------------

#: A key with more than one in HOT of all rows is hot; fewer than HOT keys can be.
HOT = 1000


def join_hot(rows: DataFrame, side: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` on ``keys``, hot keys without a shuffle.

    ``side`` has one row per key and the column n_rows: how many of the ``total``
    rows have the key (more is allowed).  Fewer than HOT keys can be hot, so their
    hashes are gathered.  Rows with such a hash stay where they are and meet
    their entries of ``side`` as a broadcast; all others are joined by a shuffle,
    where no key has more than its share.  ``how`` is inner or left; n_rows is
    part of the result.
    """
    hashed = F.xxhash64(*keys)
    found = side.where(F.col("n_rows") * HOT > max(total, HOT)).select(hashed.alias("h")).distinct().collect()
    if not found:
        return rows.join(side, keys, how)
    hot = hashed.isin([x.h for x in found])
    return rows.where(hot).join(F.broadcast(side.where(hot)), keys, how).unionByName(rows.where(~hot).join(side.where(~hot), keys, how))


# bitmaps --------------------------------------------------------------------

LEAST_BITS, MOST_BITS = 1 << 16, 1 << 25


def bitmap(keys: DataFrame, n_keys: int | None = None, name: str = "bitmap") -> DataFrame:
    """One row with one column, bits: an array of longs, by DataFrame operations.

    ``keys`` has one long column, key.  There are about eight bits for each of
    ``n_keys``, at most MOST_BITS (four megabytes); a bitmap that fills up lets
    more rows pass, which the joins behind it sort out.  Equal words meet as
    aggregates of at most MOST_BITS / 64 rows, which is also all that the last
    task gathers.
    """
    n_bits = LEAST_BITS
    while n_bits < min(MOST_BITS, 8 * (MOST_BITS if n_keys is None else n_keys)):
        n_bits *= 2
    at = F.pmod("key", F.lit(n_bits))
    words = keys.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("key", F.lit(64)).cast("int")).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(n_bits // 64).select(F.col("id").alias("word"))
    dense = every.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return materialize(dense.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("bits")), name)


def in_bitmap(key: Column) -> Column:
    """Whether the column ``bits`` of a bitmap's row may hold ``key``."""
    n_bits = F.size("bits").cast("long") * 64
    word = F.element_at("bits", (F.shiftright(F.pmod(key, n_bits), 6) + 1).cast("int"))
    return F.call_function("shiftright", word, F.pmod(key, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1


# rows -----------------------------------------------------------------------


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """k1, k2: 128 bits that tell (identifier, text) apart, nulls included."""
    parts = [doc_id.isNull(), F.coalesce(doc_id, F.lit(0).cast("long")), F.coalesce(text, F.lit(""))]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(1), *parts).alias("k2")]


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay; columns unchanged.

    ``decided`` has one row (k1, k2, stays) per row of ``docs``.  Rows that are
    equal in identifier and text are settled together: one of them stays or none.
    A bitmap keeps texts about which nothing is decided out of the shuffle.
    ``most_rows`` is a bound on the rows of ``decided``, if one is known.
    """
    acts = decided.groupBy("k1", "k2").agg(F.max("stays").alias("stays"), F.count("*").alias("n_rows")).where("not stays or n_rows > 1")
    acts = materialize(acts, "rows-decided", most_rows=most_rows)
    n_acts, total = acts.agg(F.count("*"), F.sum("n_rows")).first()
    bits = F.broadcast(bitmap(acts.select(F.col("k1").alias("key")), n_acts, "rows-bitmap"))
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    keys = row_key(docs[id_col].cast("long"), docs[text_col].cast("string"))
    keyed = docs.select(*(docs[c].alias(n) for c, n in names.items()), *keys)
    sure = keyed.join(bits, in_bitmap(F.col("k1")), "left_anti")
    may = keyed.join(bits, in_bitmap(F.col("k1")), "left_semi")
    joined = join_hot(may, acts, ["k1", "k2"], total or 0, "left")
    again = joined.where("stays").dropDuplicates(["k1", "k2"])
    out = [F.col(n).alias(c) for c, n in names.items()]
    return sure.select(*out).union(joined.where("stays is null").select(*out)).union(again.select(*out))
