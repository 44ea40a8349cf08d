import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioforge.llm import collocations as C
from folioforge.llm.collocations import grow, mine_collocations
from folioforge.llm.common import arrow_rows, materialize

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, support, longest=4, top=2000, cover=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= support}
    within = Counter()
    for (lang, *p), a in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                within[lang, *p[i : i + m]] = max(within[lang, *p[i : i + m]], a)
    out = {}
    for (lang, *p), a in cand.items():
        if 100 * within[lang, *p] >= cover * a:
            continue
        score, _, left, right = min((C.SCALE * a // (f[lang, *p[:k]] + f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def corpus(n=400, seed=3):
    r = random.Random(seed)
    words = ["the", "The", "of", "new", "york", "city", "état", "語", "a\x01b", "x-1", "(y)", "'s", "b\x0e", "z"]
    weights = [9, 3, 7, 5, 5, 4, 2, 2, 1, 1, 1, 1, 1, 1]
    rows = []
    for _ in range(n):
        parts = [r.choices(words, weights)[0] if r.random() < 0.8 else "new york city hall" for _ in range(r.randrange(0, 40))]
        rows.append((r.choice(["en", "en", "fr", None, "und", ""]), r.choice(["  ", " ", "\t"]).join(w + r.choice(["", "", "", ".", ",", "\n", "\r", " "]) for w in parts)))
    return rows + [("en", None), ("en", ""), ("fr", "..,;"), ("xx", "only once"), *[("dup", "same text here. same text here")] * 40]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "z", 0) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, ids string, n int").repartition(3)


def as_rows(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_equal_to_brute_force(spark):
    rows = corpus()
    docs = frame(spark, rows)
    assert as_rows(mine_collocations(docs)) == brute(rows, 30)
    assert as_rows(mine_collocations(docs, support=5, top=20, cover=60)) == brute(rows, 5, top=20, cover=60)


def test_other_lengths_small_chunks_and_batches(spark, monkeypatch):
    rows = corpus(150, 9)
    docs = frame(spark, rows)
    for longest in (2, 5):
        assert as_rows(mine_collocations(docs, 4, longest)) == brute(rows, 4, longest)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # prefixes over many batches
    try:
        assert as_rows(mine_collocations(docs, 4)) == brute(rows, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_chunks_end_at_pieces(monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 16)
    text = b"one two three four five six seven eight. nine ten, eleven" + b"twelve" * 5 + b"\nthirteen"
    data, at = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), len(text), 2 * len(text)])
    parts = list(C._chunks(data, at))
    assert parts[0][0] == 0 and parts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert all(hi in at or C._SEPARATES[data[hi]] for _, hi in parts[:-1]) and len(parts) > 4


def test_growth_sums_over_any_cuts():
    r = random.Random(2)
    rows = sorted(tuple(r.choices([1, 2, 3], k=4))[: r.randrange(3, 5)] for _ in range(300))
    want = Counter(x[:d] for x in rows for d in range(3, len(x) + 1))
    padded = np.array([(*x, 0, 0)[:4] for x in rows])
    for cuts in ([0, 300], [0, 7, 150, 151, 300]):
        got = Counter()
        for lo, hi in zip(cuts, cuts[1:]):
            part = padded[lo:hi]
            for row, d, c in grow(part, np.ones(len(part), np.int64), 12):
                got[tuple(part[row, :d].tolist())] += c
        assert {k: v for k, v in want.items() if v >= 12} == {k: v for k, v in got.items() if v >= 12}
    assert grow(padded[:0], np.zeros(0, np.int64), 1) == []


def test_one_word_in_a_third_of_all_and_empty(spark):
    r = random.Random(5)
    rows = [("en", " ".join("hot" if r.random() < 0.4 else f"w{r.randrange(30)}" for _ in range(300))) for _ in range(60)]
    assert as_rows(mine_collocations(frame(spark, rows))) == brute(rows, 30)
    assert mine_collocations(frame(spark, rows).limit(0)).collect() == []
    assert mine_collocations(frame(spark, [("en", "a b c")])).collect() == []


def test_long_counts_stay_exact(spark):
    big = 9_000_000_000_000_000_000
    row = spark.createDataFrame([(big, big, big)], "a long, l1 long, r1 long").selectExpr(f"CAST(a AS DECIMAL(20,0)) * {C.SCALE} div (CAST(l1 AS DECIMAL(20,0)) + CAST(r1 AS DECIMAL(20,0))) AS s").first()
    assert row.s == C.SCALE // 2
    assert pa.types.is_string(C._coded(np.frombuffer(b"a b", np.uint8), np.array([3]))[0].type)


def test_a_worker_holds_a_small_multiple_of_a_chunk(spark):
    """Peak of numpy's memory over 16 MB of one language, beside the text itself."""
    import tracemalloc

    class Task:
        @staticmethod
        def get():
            return Task

        @staticmethod
        def partitionId():
            return 0

    text = " ".join(f"w{i % 5003}." for i in range(300))
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * 1000), pa.array([text] * 1000)], ["lang", "text"]) for _ in range(8)]
    assert sum(b.nbytes for b in batches) > 13e6
    held, C.TaskContext = C.TaskContext, Task
    tracemalloc.start()
    try:
        n = sum(b.column(2)[0].as_py() for b in C._encode(iter([pa.concat_batches(batches)])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        C.TaskContext = held
    assert n == 8 * 1000 * 300
    assert peak < 60e6


def test_slices_gather_small_batches(spark, monkeypatch):
    """Batches of a few rows, and slices that join them, change no count."""
    monkeypatch.setattr(C, "TEXT_ROWS", 7)
    monkeypatch.setattr(C, "SLICE_ROWS", 1)
    monkeypatch.setattr(C, "SLICE_BYTES", 4000)
    monkeypatch.setattr(C, "CHUNK", 900)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = corpus(seed=11)
    assert as_rows(mine_collocations(frame(spark, rows), support=5)) == brute(rows, 5)
    assert spark.conf.get(key) == before


def test_pages_of_slices_are_bounded(spark, monkeypatch):
    """A page holds few long rows: it is held whole by what compresses and inflates it."""
    long = []

    def written(df, name, *args, **kwargs):
        if kwargs.get("long_rows"):
            long.append(name)
        return materialize(df, name, *args, **kwargs)

    monkeypatch.setattr(C, "materialize", written)
    assert mine_collocations(frame(spark, [("en", "a b c. " * 40)])).count() == 1
    assert {"phrase-slices", "phrase-spelled"} <= set(long)

    rows = spark.range(30).select(F.expr("cast(repeat(sha2(cast(id as string), 512), 5000) as binary)").alias("codes")).coalesce(1)
    jvm, conf = spark._jvm.org.apache, spark.sparkContext._jsc.hadoopConfiguration()
    [path] = materialize(rows, "long", long_rows=True).inputFiles()
    reader = jvm.parquet.hadoop.ParquetFileReader.open(jvm.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.hadoop.fs.Path(path), conf))
    try:
        assert reader.readOffsetIndex(reader.getFooter().getBlocks().get(0).getColumns().get(0)).getPageCount() >= 10
    finally:
        reader.close()


def test_arrow_rows_bounds_the_reader_and_restores(spark):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in keys]
    with arrow_rows(spark, 3):
        assert [spark.conf.get(k) for k in keys] == ["3", "3"]
    assert [spark.conf.get(k) for k in keys] == before
