import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge import registry
from folioforge.operators import retrieve, vectors


def data(n=1500, dim=16, seed=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(20, dim)) * 2
    rows = [(int(i), (centres[i % 20] + r.normal(size=dim) * 0.7).tolist()) for i in range(n)]
    rows += [(n + i, [1.0] * dim) for i in range(120)]  # ties
    return rows + [(9000, None), (9001, [0.0] * dim), (9002, [1.0])], [(q, (centres[q % 20] + r.normal(size=dim)).tolist()) for q in range(30)] + [(100, [1.0] * dim), (101, None), (102, [0.0] * dim)]


def as_rows(df):
    return sorted(tuple(x) for x in df.select("query_id", "id", "score", "rank").collect())


def test_exact_mode_and_recall(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 60)  # lists in several parts
    monkeypatch.setattr(vectors, "CELLS", 500)
    rows, queries = data()
    v = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<double>, list string").repartition(4)
    q = spark.createDataFrame(queries, "query_id long, query_vec array<double>")
    index = vectors.build(v, n_lists=40)
    assert index.read(spark, "lists").agg(F.sum("n")).first()[0] == len(rows) and index.read(spark, "vectors").agg(F.max("part")).first()[0] > 0
    good = v.where(F.size("embedding") == 16)
    want = as_rows(retrieve.knn(q.where("query_vec is not null and query_id <> 102"), good, 10))
    exact = [x for x in as_rows(vectors.search(index, q, 10, probes=3, exact=True)) if x[0] != 102]
    assert exact == want
    got = {x[:2] for x in as_rows(vectors.search(index, q, 10, probes=6))}
    assert len(got & {x[:2] for x in want}) / len(want) >= 0.95
    zero = [x for x in as_rows(vectors.search(index, q, 10, probes=1, exact=True)) if x[0] == 102]
    assert [x[1:3] for x in zero] == [(i, 0.0) for i in range(10)]


def test_few_and_no_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.1])], "query_id long, query_vec array<double>")
    assert [x[1] for x in as_rows(vectors.search(vectors.build(v), q, 5, exact=True))] == [1, 2, 2]
    assert vectors.search(vectors.build(v.limit(0)), q, 5, exact=True).collect() == []


def test_only_probed_lists_are_read(spark):
    rows, queries = data(800)
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vectors.build(v, n_lists=30)
    q = spark.createDataFrame(queries[:1], "query_id long, query_vec array<double>")
    plan = vectors.search(index, q, 5, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "list" in plan.split("PushedFilters")[1][:200]


def test_centres_fill_empty_lists():
    x = np.vstack([np.eye(4)] * 5 + [np.ones((30, 4))])
    centres = vectors.fit_centres(x, 5)
    assert centres.shape == (5, 4) and len(np.unique((x / np.linalg.norm(x, axis=1)[:, None] @ centres.T).argmax(axis=1))) == 5
    assert vectors.fit_centres(np.zeros((3, 4)), 2).shape == (1, 4)


def test_knn_compares_blocks_and_gives_what_all_pairs_give(spark, monkeypatch):
    texts = lambda df: sorted(repr(tuple(x)) for x in df.select("query_id", "id", "score", "rank").collect())
    rows, queries = data(700)
    rows += [(9004, [1.0, None] * 8), (9005, []), (9000, [1.0] * 16)]
    rows += [(9100 + i, [1.0 if j == i % 16 else 0.0 for j in range(16)]) for i in range(40)]  # exact halves
    queries += [(103, [1.0, None] * 8), (104, [1.0, 2.0]), (105, []), (100, rows[0][1]), (106, [1.0] + [0.0] * 15), (107, [float(x) for x in [1, 127] + [0] * 14])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, query_vec array<double>")
    every = q.crossJoin(v).select("query_id", F.col("vec_id").alias("id"), F.round(retrieve.cosine(F.col("embedding"), F.col("query_vec")), 6).alias("score"))
    want = texts(retrieve.top(every, 12))
    found = retrieve.knn(q, v, 12)
    assert texts(found) == want
    # a pair is no row of a join, and a task sends its best only
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieve, "QUERY_BYTES", 8000)
    monkeypatch.setattr(retrieve, "CELLS", 300)
    monkeypatch.setattr(retrieve, "BLOCK_BYTES", 4000)
    assert texts(retrieve.knn(q, v.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding"), 5)) == texts(retrieve.top(every.withColumn("id", F.col("id").cast("string")), 5))
    assert retrieve.knn(q.limit(0), v, 5).collect() == [] and retrieve.knn(q, v.limit(0), 5).collect() == []


#: Queries over vector hits.
OVER_HITS = ["category_boost", "rrf_fusion", "token_budget", "retrieval_purity", "relevance_cut"]


@pytest.mark.parametrize("name", OVER_HITS)
def test_vector_hits_are_no_join_of_all_pairs(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Cartesian" not in plan and "MapInArrow" in plan
