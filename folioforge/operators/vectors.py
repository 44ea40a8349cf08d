"""Nearest vectors from stored lists: coarse centres, probing, exact ranking.

Centres are fitted on a sample of stated size; every vector goes to the list of its
nearest centre.  Lists are stored by list, large ones in parts, so a query reads
the lists it probes only, and no list is one task.  All probed vectors are ranked
by their exact cosine.  ``exact`` also reads every list that may still hold one of
the k best, by the angle between query and centre and the largest angle in the
list; that gives what comparing with every vector gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.sources.scratch import new_path, written

#: Vectors that the centres are fitted on, and bytes that they may have.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
MOST_LISTS, ROUNDS, PROBES = 4096, 8, 8
#: Vectors in a part of a list.
PART = 50_000
#: Cells of a matrix of cosines that a worker holds.
CELLS = 4 << 20
SLACK = 2e-6


@dataclass
class VectorLists:
    """Stored below ``path``: lists (list, centre, reach, n, parts), vectors (list, part, id, v, norm)."""

    path: str

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; null or of another length: zero."""
    out = np.zeros((len(column), dim))
    lens = np.diff(column.offsets.to_numpy())
    good = np.flatnonzero((lens == dim) & column.is_valid().to_numpy(zero_copy_only=False))
    flat = np.nan_to_num(column.values.to_numpy(zero_copy_only=False).astype(np.float64))
    starts = column.offsets.to_numpy()[:-1][good]
    out[good] = flat[starts[:, None] + np.arange(dim)]
    return out


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((m * m).sum(axis=1))
    return m / np.where(norm > 0, norm, 1.0)[:, None], norm


def fit_centres(sample: np.ndarray, n_lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; an empty list takes the vector that fits its own worst."""
    x, norm = _unit(sample)
    x = x[norm > 0]
    if not len(x):
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 0))
    centres = x[np.linspace(0, len(x) - 1, min(n_lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        cos = x @ centres.T
        own, fit = cos.argmax(axis=1), cos.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        for empty in np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0):
            worst = int(fit.argmin())
            sums[empty], fit[worst] = x[worst], 2.0
        centres = _unit(sums)[0]
    return centres


def build(vectors: DataFrame, path: str | None = None, id_col: str = "vec_id", vec: str = "embedding", n_lists: int | None = None, sample: int = SAMPLE) -> VectorLists:
    """Store ``vectors`` by list.  ``n_lists``: the square root of their number by
    default, at most MOST_LISTS.  Null vectors, and those that are not as long as
    the longest, count as zero vectors (cosine 0)."""
    spark = vectors.sparkSession
    path = path or new_path(spark, "vector-lists")
    picked = vectors.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    n, dim = picked.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = max(dim or 0, 1)
    size = min(sample, max(1, SAMPLE_BYTES // (8 * dim)))
    # the least hashes: a sample of bounded size that does not depend on the partitions
    rows = picked.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(size).collect()
    centres = fit_centres(np.array([r.v for r in rows], np.float64).reshape(-1, dim), n_lists or max(1, min(round(n**0.5), len(rows) // 8, MOST_LISTS)))
    sent = spark.sparkContext.broadcast(centres)  # MOST_LISTS centres at most
    id_type = picked.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit, norm = _unit(_matrix(b.column(1), dim))
            cos = unit @ sent.value.T
            own = cos.argmax(axis=1) if len(unit) else np.zeros(0, np.int64)
            angle = np.arccos(np.clip(cos[np.arange(len(own)), own], -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(angle), pa.array(norm), b.column(0), b.column(1)], ["list", "angle", "norm", "id", "v"])

    placed = written(picked.mapInArrow(assign, f"list int, angle double, norm double, id {id_type}, v array<double>"), "vectors-placed")
    counts = {r.list: r for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("reach")).collect()}  # a row per list
    lists = [(k, centres[k].tolist(), float(c.reach), int(c.n), -(-c.n // PART)) for k, c in counts.items()]
    spark.createDataFrame(lists, "list int, centre array<double>, reach double, n long, parts long").coalesce(1).write.parquet(f"{path}/lists")
    parts = F.broadcast(spark.read.parquet(f"{path}/lists").select("list", "parts"))
    dealt = placed.join(parts, "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "v", "norm")
    dealt.repartitionByRange("list", "part").sortWithinPartitions("list", "part").write.parquet(f"{path}/vectors")
    return VectorLists(path)


def _scored(pairs: DataFrame, lists: DataFrame, vectors: DataFrame, k: int, probed: list[int]) -> DataFrame:
    """query_id, id, score: of every part of a probed list the k best for a query."""
    asked = pairs.join(F.broadcast(lists.select("list", "parts")), "list").withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))))
    asked = asked.select("list", "part", "query_id", "query_vec")
    held = vectors.where(F.col("list").isin(probed)).select("list", "part", "id", "v", "norm")
    kinds = {f.name: f.dataType.simpleString() for f in [*pairs.schema, *vectors.schema]}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, queries, scores = [], [], []
        if left.num_rows and right.num_rows:
            q = right["query_vec"].combine_chunks()
            dim = len(q[0])
            unit_q, unit_v = _unit(_matrix(q, dim))[0], _unit(_matrix(left["v"].combine_chunks(), dim))[0]
            own, of = left["id"].combine_chunks(), right["query_id"].to_pylist()
            step = max(1, CELLS // len(unit_v))
            for lo in range(0, len(unit_q), step):
                cos = np.round(unit_q[lo : lo + step] @ unit_v.T, 6) + 0.0
                for i, row in enumerate(cos):
                    at = np.arange(len(row))
                    if len(row) > k:
                        at = np.flatnonzero(row >= np.partition(row, -k)[-k])
                    best = sorted(zip((-row[at]).tolist(), own.take(pa.array(at)).to_pylist()), key=lambda x: (x[0], x[1] is not None, x[1]))[:k]
                    ids += [x for _, x in best]
                    scores += [-s + 0.0 for s, _ in best]
                    queries += [of[lo + i]] * len(best)
        return pa.table([pa.array(queries, right["query_id"].type), pa.array(ids, left["id"].type), pa.array(scores, pa.float64())], ["query_id", "id", "score"])

    return held.groupBy("list", "part").cogroup(asked.groupBy("list", "part")).applyInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


def search(index: VectorLists, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """query_id, id, score (cosine, six digits), rank: the k nearest in the lists of
    the ``probes`` nearest centres, or, ``exact``, of all vectors.

    ``queries``: query_id, query_vec; null vectors find nothing.  Ties go by id.
    """
    spark = queries.sparkSession
    lists = index.read(spark, "lists")
    rows = sorted(lists.collect(), key=lambda r: r.list)  # MOST_LISTS at most
    numbers = np.array([r.list for r in rows], np.int32)
    centres = np.array([r.centre for r in rows])
    reach = np.array([r.reach for r in rows])
    sent = spark.sparkContext.broadcast((numbers, centres, reach))
    asked = queries.where("query_vec is not null").select("query_id", F.col("query_vec").cast("array<double>").alias("query_vec"))
    id_type = asked.schema["query_id"].dataType.simpleString()

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, centres, reach = sent.value
        for b in batches:
            angle = np.arccos(np.clip(_unit(_matrix(b.column(1), centres.shape[1]))[0] @ centres.T, -1, 1))
            order = np.argsort(angle, axis=1, kind="stable")
            if not exact:
                order = order[:, :probes]
            row = np.repeat(np.arange(b.num_rows), order.shape[1])
            at = order.ravel()
            # no vector of the list is nearer than this
            most = np.cos(np.maximum(0.0, angle[row, at] - reach[at]))
            place = np.tile(np.arange(order.shape[1]), b.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(numbers[at]), pa.array(place), pa.array(most)], ["query_id", "query_vec", "list", "place", "most"])

    if not rows:
        return asked.select("query_id", F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    planned = written(asked.mapInArrow(plan, f"query_id {id_type}, query_vec array<double>, list int, place int, most double"), "vectors-planned")
    vectors = index.read(spark, "vectors")
    first = planned.where(F.col("place") < probes)
    found = _scored(first, lists, vectors, k, [r.list for r in first.select("list").distinct().collect()])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    if not exact:
        return top(found)
    found = written(found, "vectors-found")
    least = top(found).where(F.col("rank") == k).select("query_id", F.col("score").alias("theta"))
    more = planned.where(F.col("place") >= probes).join(least, "query_id", "left").where(F.col("theta").isNull() | (F.col("most") >= F.col("theta") - SLACK)).drop("theta")
    # zero vectors are as far from everything: their cosine is 0 whatever the angles say
    more = written(more.unionByName(planned.where(F.col("place") >= probes).join(least.where(F.col("theta") <= 0), "query_id", "left_semi")).distinct(), "vectors-more")
    return top(found.unionByName(_scored(more, lists, vectors, k, [r.list for r in more.select("list").distinct().collect()])))
