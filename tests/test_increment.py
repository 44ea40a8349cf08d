from pyspark.sql import functions as F

from folioforge.operators.extract import HashEmbedder
from folioforge.sources import increment, store

KINDS = "document_id string, chunk_index int, parent_chunk_index int, title string, content string"


def chunks(spark, docs, analysis="a"):
    rows = [(d, i, None, None, t) for d, texts in docs.items() for i, t in enumerate(texts)]
    return store.index_ids(spark.createDataFrame(rows, KINDS), analysis)


def counts(df):
    return {r.change: r["count"] for r in df.groupBy("change").count().collect()}


def test_only_new_chunks_are_embedded_and_stale_ones_go(spark, tmp_path):
    index, vectors = str(tmp_path / "index"), str(tmp_path / "vectors")
    docs = {"d1": ["uno", "dos", "dos"], "d2": ["tres", "cuatro"], "d3": ["uno"]}
    changes, asked = increment.ingest_again(chunks(spark, docs), index, HashEmbedder(8), 8, vectors)
    assert counts(changes) == {"added": 6} and asked == 4  # equal texts once
    increment.ingest_again(chunks(spark, {"x": ["other analysis"]}, "b"), index, HashEmbedder(8), 8, vectors)
    docs = {"d1": ["dos", "uno", "dos", "cinco"], "d2": ["tres", "cuatro"]}
    changes, asked = increment.ingest_again(chunks(spark, docs), index, HashEmbedder(8), 8, vectors)
    assert asked == 1 and counts(changes) == {"added": 1, "moved": 2, "kept": 3, "removed": 1}
    rows = spark.read.parquet(index).orderBy("analysis_id", "id").collect()
    assert [r.content for r in rows] == ["dos", "uno", "dos", "cinco", "tres", "cuatro", "other analysis"]
    want = dict(zip(docs["d1"] + docs["d2"], HashEmbedder(8)(docs["d1"] + docs["d2"])))
    for r in rows[:-1]:
        assert all(abs(x - y) < 1e-6 for x, y in zip(r.embedding, want[r.content]))

    def broken(texts):
        raise AssertionError("nothing is new")

    changes, asked = increment.ingest_again(chunks(spark, docs), index, broken, 8, vectors)
    assert asked == 0 and counts(changes) == {"kept": 6}
    # another model has vectors of its own
    assert increment.embed_stored(chunks(spark, docs), HashEmbedder(8), 8, vectors, "m2")[1] == 5


def test_repeated_writes_and_null_texts(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = chunks(spark, {"d": [None, "", "a"], None: ["a"]})
    out, asked = increment.embed_stored(rows, HashEmbedder(4), 4, path)
    assert asked == 2 and out.count() == 4
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    spark.read.parquet(path).write.mode("append").parquet(path + "2")
    assert increment.stored(spark, path + "2").count() == 2 and increment.stored(spark, path + "3") is None
    again, asked = increment.embed_stored(rows.limit(0), HashEmbedder(4), 4, path + "4")
    assert asked == 0 and again.collect() == []


def test_difference_matches_repeats_in_order(spark):
    side = lambda rows: spark.createDataFrame(rows, "document_id string, chunk_index int, digest string")
    old = side([("d", 0, "x"), ("d", 1, "x"), ("d", 2, "y"), (None, 0, "x")])
    new = side([("d", 0, "x"), ("d", 1, "z"), ("d", 2, "x"), ("d", 3, "x"), (None, 0, "x")])
    got = sorted(((r.document, r.digest, r.occurrence, r.old_at, r.new_at, r.change) for r in increment.difference(old, new).collect()), key=repr)
    assert got == sorted([("d", "x", 0, 0, 0, "kept"), ("d", "x", 1, 1, 2, "moved"), ("d", "x", 2, None, 3, "added"), ("d", "y", 0, 2, None, "removed"), ("d", "z", 0, None, 1, "added"), (None, "x", 0, 0, 0, "kept")], key=repr)
    assert increment.difference(old, new.limit(0)).where(F.col("change") != "removed").isEmpty()
