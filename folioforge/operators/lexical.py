"""A stored lexical index and pruned top-k retrieval from it.

SPAN documents that are read in a row make a bucket.  The postings
of a term (of one field, in one space) in one bucket are a block: places and
saturated frequencies in two arrays, with the largest of them as the block's
bound.  Blocks are ranged and sorted by term, so a search reads the row groups of
its terms only.

A search goes from bounds to postings.  The heads of the blocks, without their
arrays, say what a bucket can give a query at most: the sum of its blocks' bounds.
The few buckets that promise most are evaluated first; the k-th score found there
is the query's threshold, and only buckets that can reach it are evaluated at all.
Blocks travel to the task of their bucket once, however many queries want them,
and a task returns the k best of a query (with ties), adding the terms of a query
by falling bound and leaving documents out that can no longer reach the
threshold.  Nothing that a common term has in millions of documents becomes a row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions.text import matching_form, tokens
from folioforge.sources.scratch import new_path, written

K1, B = 1.2, 0.75
SPAN = 1024
#: Buckets of a query that are evaluated for its threshold.
FIRST = 4
#: So many different terms are named in the filter of a scan; more are joined.
LISTED = 5000
#: Different query terms that may be sent to where documents are read.
SENT_TERMS = 100_000
#: Query terms that may be sent to the scans of block heads, by their rows.
SENT = 1_000_000
#: Scores are rounded to six digits; bounds are kept so far above them.
SLACK = 2e-6


@dataclass
class LexicalIndex:
    """What is stored below ``path``: docs (bucket, at, id, space), terms (term, field, df,
    most), blocks (term, field, space, bucket, n, most, ats, ws), fields (field,
    n, mean)."""

    path: str
    span: int

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def build(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str | Sequence[str] = "text", within: str | None = None, span: int = SPAN, queries: DataFrame | None = None) -> LexicalIndex:
    """Index ``docs`` below ``path`` (a new folder of the shared one by default).

    ``text``: one field or several, each with statistics of its own.  ``within``: a
    column (the analysis, say) in which query and document must agree; counts
    and mean lengths cover all documents.  A null text has no words; rows that
    repeat an identifier are separate documents.

    Documents are counted where they are read: the blocks of a bucket are those of
    one slice of a task's documents, so only finished blocks are shuffled, once, to
    be ranged by term.  An index that serves ``queries`` (with a column query) only
    once leaves other terms out where they are read, if those of the queries are
    few enough to be sent there; what it finds for them is the same.
    """
    only = None
    if queries is not None:
        words = queries.select(F.explode(tokens(matching_form(F.col("query")))).alias("term")).distinct()
        listed = [r.term for r in words.limit(SENT_TERMS + 1).collect()]
        only = listed if len(listed) <= SENT_TERMS else None
    spark = docs.sparkSession
    path = path or new_path(spark, "lexical-index")
    fields = [text] if isinstance(text, str) else list(text)
    space = F.coalesce(F.col(within).cast("string"), F.lit("")) if within else F.lit("")
    picked = docs.select(F.col(id_col).alias("id"), space.alias("space"), *(matching_form(F.coalesce(F.col(f), F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)))
    id_type = picked.schema["id"].dataType.simpleString()
    counted = picked.mapInArrow(_counts(span, only), f"term string, field int, space string, bucket long, ats array<int>, tfs array<int>, lens array<int>, ids array<{id_type}>, spaces array<string>")
    counted = written(counted, "lexical-counts")
    marker = counted.where("term is null")  # one row per field and bucket
    named = marker.where("field = 0").select("bucket", F.explode(F.arrays_zip("ats", "ids", "spaces")).alias("x"))
    named.select("bucket", F.col("x.ats").alias("at"), F.col("x.ids").alias("id"), F.col("x.spaces").alias("space")).write.parquet(f"{path}/docs")
    sums = F.aggregate("lens", F.lit(0).cast("long"), lambda s, x: s + x)
    stats = marker.groupBy("field").agg(F.sum(F.size("ats")).alias("n"), (F.sum(sums) / F.sum(F.size("ats"))).alias("mean"))
    stats.coalesce(1).write.parquet(f"{path}/fields")
    stats = F.broadcast(spark.read.parquet(f"{path}/fields"))  # one row per field
    key = ["term", "field", "space", "bucket"]
    ranged = counted.where("term is not null").select(*key, "ats", "tfs", "lens").repartitionByRange(*key).sortWithinPartitions(*key).join(stats.select("field", "mean"), "field")
    weights = F.zip_with("tfs", "lens", lambda tf, n: tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / F.col("mean"))))
    weighed = ranged.select(*key, F.size("ats").alias("n"), "ats", weights.alias("ws"))
    weighed.select(*key, "n", F.array_max("ws").alias("most"), "ats", "ws").write.parquet(f"{path}/blocks")
    terms = spark.read.parquet(f"{path}/blocks").groupBy("term", "field").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    return LexicalIndex(path, span)


def _lists(values, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def _counts(span: int, only: list[str] | None = None):
    """Blocks of every ``span`` documents (of the terms ``only``, if given), and a row without a term for each field
    with the documents themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 32, 0
        for whole in batches:
            for lo in range(0, whole.num_rows, span):
                b = whole.slice(lo, span)
                bucket, rows = task + number, b.num_rows
                number += 1
                spaces = b.column(1).dictionary_encode()
                for field, texts in enumerate(b.columns[2:]):
                    parts = pc.split_pattern(texts, " ")
                    words = parts.flatten()
                    doc = np.repeat(np.arange(rows), pc.list_value_length(parts).to_numpy())
                    some = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
                    coded, doc = words.filter(pa.array(some)).dictionary_encode(), doc[some]
                    lens = np.bincount(doc, minlength=rows).astype(np.int32)
                    codes = coded.indices.to_numpy()
                    if only is not None:
                        kept = pc.is_in(coded.dictionary, value_set=pa.array(only, pa.string())).to_numpy(zero_copy_only=False)
                        kept = kept[codes] if len(codes) else np.zeros(0, bool)
                        codes, doc = codes[kept], doc[kept]
                    n_terms = max(1, len(coded.dictionary))
                    keys, tfs = np.unique((spaces.indices.to_numpy()[doc].astype(np.int64) * n_terms + codes) * rows + doc, return_counts=True)
                    block, at = keys // rows, (keys % rows).astype(np.int32)
                    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(keys) else np.zeros(0, np.int64)
                    sizes = np.diff(np.append(first, len(keys)))
                    none = lambda kind, n: pa.array([None] * n, kind)
                    kinds = (pa.list_(b.column(0).type), pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([
                        coded.dictionary.take(pa.array(block[first] % n_terms)), pa.array(np.full(len(first), field, np.int32)), spaces.dictionary.take(pa.array(block[first] // n_terms)), pa.array(np.full(len(first), bucket)),
                        _lists(pa.array(at), sizes), _lists(pa.array(tfs.astype(np.int32)), sizes), _lists(pa.array(lens[at]), sizes), *(none(k, len(first)) for k in kinds),
                    ], NAMES)
                    one = [rows]
                    yield pa.RecordBatch.from_arrays([
                        none(pa.string(), 1), pa.array([field], pa.int32()), none(pa.string(), 1), pa.array([bucket]),
                        _lists(pa.array(np.arange(rows, dtype=np.int32)), one), none(pa.list_(pa.int32()), 1), _lists(pa.array(lens), one), _lists(b.column(0), one), _lists(b.column(1), one),
                    ], NAMES)

    return run


NAMES = ["term", "field", "space", "bucket", "ats", "tfs", "lens", "ids", "spaces"]


def best_of_bucket(span: int, blocks: dict, terms: Sequence[tuple[str, int, float]], space: str, k: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best of one bucket, ties and all, of those
    that may reach ``theta``."""
    found = [(idf * blocks[t, f, space][2], idf, *blocks[t, f, space][:2]) for t, f, idf in terms if (t, f, space) in blocks]
    found.sort(key=lambda x: -x[0])
    score, left = np.zeros(span), sum(x[0] for x in found)
    seen = np.zeros(span, bool)
    for bound, idf, ats, ws in found:
        if left < theta - SLACK:  # a document first met here cannot reach it
            known = seen[ats]
            ats, ws = ats[known], ws[known]
        score[ats] += idf * ws
        seen[ats] = True
        left -= bound
    at = np.flatnonzero(seen & (score >= theta - SLACK))
    if len(at) > k:
        rounded = np.round(score[at], 6)
        at = at[rounded >= np.partition(rounded, -k)[-k] - SLACK]
    return at, score[at]


def _evaluated(pairs: DataFrame, weighted: DataFrame, blocks: DataFrame, k: int, span: int) -> DataFrame:
    """query_id, bucket, at, score from the buckets of ``pairs`` (query_id, bucket, theta)."""
    need = pairs.select("query_id", "bucket").join(weighted.select("query_id", "term", "field", "space"), "query_id").select("term", "field", "space", "bucket").distinct()
    held = blocks.join(need, ["term", "field", "space", "bucket"], "left_semi").select("term", "field", "space", "bucket", "most", "ats", "ws")
    query = weighted.groupBy("query_id", "space").agg(F.array_sort(F.collect_list(F.struct("term", "field", "idf"))).alias("terms"))
    asked = pairs.join(query, "query_id").select("bucket", "query_id", "space", "theta", "terms")
    id_type = next(f.dataType for f in weighted.schema if f.name == "query_id").simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own = {(t, f, s): (ats.values.to_numpy(), ws.values.to_numpy(), most.as_py()) for t, f, s, most, ats, ws in zip(*(left[c].to_pylist() for c in ("term", "field", "space")), left["most"], left["ats"], left["ws"])}
        ids, buckets, places, scores = [], [], [], []
        for bucket, query_id, space, theta, terms in zip(*(right[c].to_pylist() for c in ("bucket", "query_id", "space", "theta", "terms"))):
            at, score = best_of_bucket(span, own, [(x["term"], x["field"], x["idf"]) for x in terms], space, k, theta)
            ids += [query_id] * len(at)
            buckets += [bucket] * len(at)
            places.append(at)
            scores.append(score)
        join = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
        return pa.table([pa.array(ids, right["query_id"].type), pa.array(buckets, pa.int64()), join(places, pa.int64()), join(scores, pa.float64())], ["query_id", "bucket", "at", "score"])

    return held.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(run, f"query_id {id_type}, bucket long, at long, score double")


def _ranked(rows: DataFrame, k: int, *ties: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: LexicalIndex, queries: DataFrame, k: int, within: str | None = None, first: int = FIRST) -> DataFrame:
    """query_id, id, score, rank: the ``k`` best documents of each query by BM25.

    ``queries``: query_id, query, and ``within`` if the index has spaces.  Equal to
    scoring every document: ties go by id, scores are rounded to six digits.  A
    query without words or hits has no rows.
    """
    spark = queries.sparkSession
    space: Column = F.coalesce(F.col(within).cast("string"), F.lit("")) if within else F.lit("")
    asked = queries.select("query_id", space.alias("space"), F.explode(F.array_distinct(tokens(matching_form(F.col("query"))))).alias("term"))
    words = asked.select("term").distinct()
    listed = [r.term for r in words.limit(LISTED + 1).collect()]
    only = (lambda df: df.where(F.col("term").isin(listed))) if len(listed) <= LISTED else (lambda df: df.join(words, "term", "left_semi"))
    stats = F.broadcast(index.read(spark, "fields"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = only(index.read(spark, "terms")).join(stats, "field").join(asked, "term").select("query_id", "space", "term", "field", idf.alias("idf"))
    weighted = written(weighted, "lexical-weighted")
    few = weighted.count() <= SENT
    blocks = only(index.read(spark, "blocks"))
    heads = blocks.select("term", "field", "space", "bucket", "most").join(F.broadcast(weighted) if few else weighted, ["term", "field", "space"])
    able = written(heads.groupBy("query_id", "bucket").agg(F.sum(F.col("idf") * F.col("most")).alias("score")), "lexical-able")
    start = _ranked(able, first, "bucket").select("query_id", "bucket", F.lit(0.0).alias("theta"))
    found = written(_evaluated(start, weighted, blocks, k, index.span), "lexical-found")
    least = _ranked(found, k, "bucket", "at").where(F.col("rank") == k).select("query_id", F.col("score").alias("theta"))
    rest = able.join(start, ["query_id", "bucket"], "left_anti").join(least, "query_id", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)))
    rest = rest.where(F.col("score") >= F.col("theta") - SLACK).select("query_id", "bucket", "theta")
    every = found.unionByName(_evaluated(rest, weighted, blocks, k, index.span))
    named = every.join(index.read(spark, "docs").select("bucket", F.col("at").cast("long").alias("at"), "id"), ["bucket", "at"]).select("query_id", "id", F.round("score", 6).alias("score"))
    return _ranked(named, k, "id")
