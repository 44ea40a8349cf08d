import hashlib
import re

from tokenizers import Tokenizer

import corpus_pipeline
from folioforge.llm import decontaminate as D
from folioforge.llm import quality as Q
from folioforge.llm.bpe import default_vocabulary

from .test_decontaminate import brute as leaks
from .test_minhash import brute as components

SF = "/root/testdata/sf0.001"


def brute(spark, sf):
    """The five stages as plain loops over all rows (the model itself is fitted)."""
    docs, labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = Q.train(docs, labels)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    rows = [r for r in rows if model.above(Q.features(r[1]))[-1] >= 0.5]
    best = {}
    for i, t in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", t)
        best[k] = min(best.get(k, (1, 0)), (-len(t), i))
    kept = {i for _, i in best.values()}
    rows = [r for r in rows if r[0] in kept]
    kept = {d for d, _, _, ok in components(rows, 5, 80) if ok}
    rows = [r for r in rows if r[0] in kept]
    held = {d for d, _ in leaks(rows, [(r.item_id, r.text) for r in items.collect()])}
    return [r for r in rows if r[0] not in held]


def test_stages_equal_brute_force(spark):
    library = Tokenizer.from_file(default_vocabulary())
    want = {}
    for i, t in brute(spark, SF):
        want[i] = library.encode(t, add_special_tokens=False).ids
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.ids for r in got} == want and 50 < len(got) < 200
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "tokenize"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name


def test_odd_rows(spark):
    """Nulls, copies, empty and very long texts go through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "", None, None, 0), (9003, "wort " * 60_000, "de", "s", 1), (None, "a row without a name", "en", "s", 5), (9004, "x" * 50_000, "en", "s", 2)], docs.schema)
    now = odd
    for _, stage in corpus_pipeline.STAGES[1:]:
        now = stage(spark, now, SF)
    got = {r.doc_id: r.n_tokens for r in now.collect()}
    assert {9001, 9003, 9004, None} == set(got) and got[9001] == 0 and got[9003] > 60_000
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_words_of_decontamination():
    assert D.words_of("Don't STOP_now, été 2!") == ["don", "t", "stop", "now", "été", "2"]


def test_stages_are_planned_with_small_batches(spark):
    """What a stage returns is written later, in batches of no more than BATCH_ROWS."""
    import pyarrow as pa

    before = spark.conf.get(corpus_pipeline.BATCH_KEY)

    def sizes(batches):
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows for b in batches], pa.int64())], ["n"])

    try:
        for set_to, most in ("10000", 1000), ("0", 1000), ("70", 70):
            spark.conf.set(corpus_pipeline.BATCH_KEY, set_to)
            stage = corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long"))
            assert max(x.n for x in stage(spark, spark.range(0, 3000, 1, 1), SF).collect()) == most
        for _, stage in corpus_pipeline.STAGES[1:4]:
            spark.conf.set(corpus_pipeline.BATCH_KEY, "10000")
            stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(0), SF)
            assert spark.conf.get(corpus_pipeline.BATCH_KEY) == "1000"
    finally:
        spark.conf.set(corpus_pipeline.BATCH_KEY, before)


def test_stages_bound_the_batches_of_the_reader(spark):
    key = corpus_pipeline.READER_KEY
    before = [(k, spark.conf.get(k)) for k in (key, corpus_pipeline.BATCH_KEY)]
    stage = corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: docs)
    try:
        for set_to, most in (("4096", "1000"), ("7", "7")):
            spark.conf.set(key, set_to)
            stage(spark, spark.range(1), SF)
            assert spark.conf.get(key) == most
    finally:
        for k, value in before:
            spark.conf.set(k, value)
