import hashlib
import random
import re

import duckdb
import pytest

from folioforge.llm import queries as Q
from folioforge.llm.fim import MARKS, _checked, fill_in_middle, restore

UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\r\f\v]+[ \t\n\r\f\v]*|^[ \t\n\r\f\v]+", "character": r"[\s\S]"}


def brute(doc_id, text, unit="line", fim=100, spm=50):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    assert "".join(units) == text
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in MARKS) or h3 % 100 >= fim:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def corpus():
    r = random.Random(4)
    bits = ["a", "é", "語", "🙂", "\n", "\n\n", " ", "\t", "\r", "word ", "<P", "P>", "<", ">", "<S", " ", "\x00", "line of text\n"]
    rows = [(i, "".join(r.choices(bits, k=r.randrange(0, 30)))) for i in range(600)]
    rows += [(600, None), (601, ""), (602, "has <P> inside\nb\n"), (603, "<M>"), (604, "x" * 200_000 + "\n" + "é\n" * 50_000), (605, "\n"), (606, "no end of line"), (None, "a\nb\nc\nd"), (607, "<P"), (608, "S>\n")]
    return rows + [(5, "a\nb\nc\n"), (5, "a\nb\nc\n"), (-3, "x\ny\n")]


@pytest.mark.parametrize("unit", UNIT)
def test_equal_to_brute_force_and_restored(spark, unit):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, output string, n int")
    for fim, spm in ((100, 50), (60, 0), (0, 50)):
        out = restore(fill_in_middle(docs, unit, fim_percent=fim, spm_percent=spm)).collect()
        assert sorted((tuple(x)[:6] for x in out), key=repr) == sorted((brute(d, t, unit, fim, spm) for d, t in rows), key=repr)
        assert sorted((x.restored for x in out)) == sorted(t or "" for _, t in rows)


def test_query_equals_sql(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    want = db.sql(f"SELECT {', '.join(names)} FROM ({Q.OP12_SQL})").fetchall()
    got = [tuple(x) for x in Q.op12_fill_in_middle(spark, str(tmp_path)).select(names).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table_and_other_marks(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert restore(fill_in_middle(empty)).collect() == []
    docs = spark.createDataFrame([(1, "a\nb\nc\n<P>")], "doc_id long, text string")
    marks = ("[pre]", "[suf]", "[mid]")
    out = restore(fill_in_middle(docs, marks=marks), marks).first()
    assert out.form in ("psm", "spm") and out.restored == "a\nb\nc\n<P>"
    for bad in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("", "a", "b"), (">x<", "<y", "z")):
        with pytest.raises(ValueError):
            _checked(bad)
