import random

import numpy as np
from pyspark.sql import functions as F

from folioforge.operators import lexical, retrieve


def corpus(n=600, seed=1):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.8))}" for _ in range(4000)] + ["común"] * 300
    docs = [(f"d{i:04d}", " ".join(r.choices(words, k=r.choice([0, 3, 30, 200]))), r.choice(["Guía uno", "two", None]), r.choice("abc")) for i in range(n)]
    docs += [("d9000", None, None, "a"), ("d9001", "", "x", None)]
    queries = [(q, " ".join(r.choices(words, k=r.choice([1, 2, 6, 40]))) + (" Común, uno" if q % 3 == 0 else ""), r.choice("abc")) for q in range(40)]
    return docs, queries + [(100, None, "a"), (101, "", "b"), (102, "nowhere", "c"), (103, "w1", None)]


def as_rows(df):
    return sorted(tuple(x) for x in df.select("query_id", "id", "score", "rank").collect())


def test_equal_to_scoring_every_document(spark):
    docs, queries = corpus()
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id string, text string, title string, lang string, no int").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, query string, lang string")
    for text, within in (("text", None), (["text", "title"], None), (["text", "title"], "lang")):
        index = lexical.build(d, None, "doc_id", text, within, span=64)
        once = lexical.build(d, None, "doc_id", text, within, span=64, queries=q)
        for k, index in ((1, index), (10, once)):
            want = retrieve.top(retrieve.bm25(q, d, "doc_id", text, within), k)
            assert as_rows(lexical.search(index, q, k, within, first=2)) == as_rows(want), (text, within, k)


def test_buckets_that_cannot_matter_are_not_read(spark, monkeypatch):
    docs = [(i, "common words everywhere" + (" rare rare rare" if i < 40 else "") + " filler" * (i % 7)) for i in range(4000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    q = spark.createDataFrame([(1, "the rare common words")], "query_id long, query string")
    index = lexical.build(d, span=32)
    asked = []
    inner = lexical._evaluated
    monkeypatch.setattr(lexical, "_evaluated", lambda pairs, *a: asked.append(pairs.count()) or inner(pairs, *a))
    got = lexical.search(index, q, 5)
    assert as_rows(got) == as_rows(retrieve.top(retrieve.bm25(q, d), 5))
    assert sum(asked) < 12  # of 125 buckets


def test_index_is_stored_and_sorted(spark, tmp_path):
    docs, _ = corpus(80)
    d = spark.createDataFrame(docs, "doc_id string, text string, title string, lang string")
    index = lexical.build(d, str(tmp_path / "ix"), span=16)
    again = lexical.LexicalIndex(index.path, 16)
    blocks = again.read(spark, "blocks")
    assert blocks.groupBy("term", "field", "space", "bucket").count().where("count > 1").isEmpty()
    assert blocks.where(F.size("ats") > 16).isEmpty() and blocks.where(F.array_max("ws") != F.col("most")).isEmpty()
    assert again.read(spark, "docs").select("bucket", "at").distinct().count() == len(docs)
    q = spark.createDataFrame([(1, "w1 w2")], "query_id long, query string")
    plan = lexical.search(again, q, 3)._jdf.queryExecution().toString()
    assert "Generate explode(ats" not in plan
    twice = lexical.build(spark.createDataFrame([("x", "w1 w3"), ("x", "w1 w3"), ("y", "w4")], "doc_id string, text string"))
    assert [r.id for r in lexical.search(twice, q, 3).collect()] == ["x", "x"]
    empty = lexical.build(d.limit(0))
    assert lexical.search(empty, q, 3).collect() == []


def test_bounds_inside_a_bucket_lose_nothing():
    r = random.Random(6)
    for _ in range(200):
        blocks, terms = {}, []
        for t in range(r.randrange(1, 8)):
            at = np.array(sorted(r.sample(range(50), r.randrange(1, 50))))
            w = np.array([r.uniform(0.1, 2) for _ in at])
            blocks[f"t{t}", 0, ""] = (at, w, float(w.max()))
            terms.append((f"t{t}", 0, r.uniform(0.1, 5)))
        whole = np.zeros(50)
        for t, f, idf in terms:
            np.add.at(whole, blocks[t, f, ""][0], idf * blocks[t, f, ""][1])
        theta = float(np.quantile(whole, r.random()))
        k = r.randrange(1, 60)
        at, score = lexical.best_of_bucket(50, blocks, terms, "", k, theta)
        want = sorted((i for i in range(50) if whole[i] >= theta and whole[i] > 0), key=lambda i: -whole[i])[:k]
        assert set(want) <= set(at.tolist()) and all(abs(whole[i] - s) < 1e-9 for i, s in zip(at, score))
