import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from folioforge.llm import line_dedup as L


def brute(rows):
    rows = [(d, t or "") for d, t in rows]
    leaves = defaultdict(lambda: defaultdict(set))
    place = {}
    for t in {t for _, t in rows}:
        for no, line in enumerate(t.split("\n")):
            line = re.sub("([\u3040-\u30ff\u4e00-\u9fff\u0e00-\u0e7f])", r" \1 ", line)
            tok = [L.VARIABLE if re.search("[0-9]", x) else x for x in re.split(r"[ \t\r\f\v]+", line.strip(" \t\r\f\v")) if x]
            if any(x != L.VARIABLE and re.search(r"[^\W\d_]", x) for x in tok):
                leaf = (len(tok), *tok[: L.DEPTH])
                leaves[leaf][tuple(tok)].add(t)
                place[t, no] = (leaf, tuple(tok))
    template = {}
    for leaf, lines in leaves.items():
        if len(set().union(*lines.values())) < 2:
            continue
        weight = Counter()
        for tok, texts in lines.items():
            for i, x in enumerate(tok):
                weight[i, x] += len(texts)
        for tok in lines:
            g = tuple(x if x != L.VARIABLE and weight[i, x] >= L.SUPPORT else L.VARIABLE for i, x in enumerate(tok))
            fixed = sum(x != L.VARIABLE for x in g)
            template[leaf, tok] = (leaf, g if fixed >= L.SHARE * len(tok) else tok)
    having, first = defaultdict(set), {}
    order = sorted({(d is None, d or 0, t) for d, t in rows})
    for no_id, d, t in order:
        for no in range(len(t.split("\n"))):
            if (k := template.get(place.get((t, no)))) is not None:
                having[k].add(t)
                first.setdefault(k, t)
    out = []
    for d, t in rows:
        lines = t.split("\n")
        kept = []
        for no, line in enumerate(lines):
            k = template.get(place.get((t, no)))
            recurs = k is not None and (len(having[k]) >= L.TEXTS or len(having[k]) >= 2 and k[0][0] >= L.LONG)
            if not recurs or first[k] == t:
                kept.append(line)
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def corpus():
    r = random.Random(12)
    words = [f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    boiler = ["All rights reserved.", "Posted by {} on {} at noon today", "error code {} in module {} of the server", "  Licensed\tunder the licence, version 2.0."]
    long = " ".join(r.choices(words, k=60))
    rows = []
    for d in range(120):
        lines = [" ".join(r.choices(words, k=r.choice([1, 2, 4, 12]))) for _ in range(r.randrange(1, 6))]
        if d % 3 == 0:
            lines.insert(r.randrange(len(lines) + 1), r.choice(boiler).format(r.choice(words), r.randrange(99)))
        if d % 8 == 0:
            lines += ["Advertisement", "Read more", "-----", f"{d}", "}", "著作権は本社に帰属し2024年の規約に従う", "ข้อความ"][: d % 7 + 1]
        if d in (40, 77):
            lines.append(long)
        if d % 10 == 0:
            lines += ["", " "]
        rows.append((d, "\n".join(lines)))
    copy = "one two three four\nfive six seven eight"
    return rows + [(200 + i, copy) for i in range(9)] + [(300, None), (301, ""), (None, rows[0][1]), (0, rows[0][1]), (None, "All rights reserved.")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, leaf string").repartition(5)
    got = sorted((tuple(x) for x in L.drop_recurring_lines(df).collect()), key=repr)
    want = brute(rows)
    assert got == want
    by_id = {x[0]: x for x in want}
    assert by_id[205][2] == 0 and sum(x[2] for x in want) >= 10
    assert len(by_id[40][3]) > 100 and by_id[77][2] >= 1
    assert L.drop_recurring_lines(df.limit(0)).count() == 0


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a b c\nd")], "doc_id long, text string")
    plan = L.drop_recurring_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def timed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {x.doc_id: x for x in L.drop_recurring_lines(df).collect()}
    return got, time.time() - began


def test_long_tokens_and_long_logs(spark):
    timed(spark, [(1, "a"), (2, "b")])
    tail = "\nthe same line ends them all"
    got, s = timed(spark, [(i, c * 1_000_000 + d + tail) for i, (c, d) in enumerate([("x", ""), ("y", "1"), ("z", " z")])])
    assert s < 30 and got[0].n_dropped == 0 and got[1].n_dropped == got[2].n_dropped == 1
    line = "connection {} was closed by the peer at {}"
    logs = [(i, "\n".join(line.format(n * 3 + i, n) for n in range(200_000)) + f"\nand text {'abc'[i]} goes on") for i in range(3)]
    got, s = timed(spark, logs)
    assert s < 60 and got[0].n_dropped == 0
    assert got[2].n_lines == 200_001 and got[2].n_dropped == 200_000 and got[2].text == "and text c goes on"


def test_marks(spark):
    got = spark.createDataFrame([([2, 0, 5],), ([0],), ([3],)], "x array<int>").select(L._marks(F.col("x")).alias("m")).collect()
    assert [bytes(x.m) for x in got] == [b"101001", b"1", b"0001"]


def test_hot_line_is_not_shuffled_by_its_key(spark):
    rows = [(i, f"a line of its own {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} here\nAll rights are reserved by us" + ("\nsome more" if i % 2 else "")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted((tuple(x) for x in L.drop_recurring_lines(df).collect()), key=repr) == brute(rows)
