import pytest
from pyspark.sql import functions as F

from folioforge.functions import tables
from folioforge.operators import chunking, sections
from folioforge.sources import schemas


def test_windows_equal_the_dataframe_form(spark):
    tables.register(spark)
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(n)) + "\t\n ") for i, n in enumerate((0, 1, 9, 10, 11, 17, 18, 40))] + [(99, None)], "doc_id int, text string")
    got = spark.sql("SELECT doc_id, w.* FROM {docs} t, LATERAL text_windows(t.text, 10, 3) w", docs=docs)
    want = chunking.window_rows(docs, "text", 10, 3)
    rows = lambda df: sorted(tuple(x) for x in df.select("doc_id", "window_no", "n_words", "window_text").collect())
    assert rows(got) == rows(want)
    assert spark.sql("SELECT * FROM text_windows('a b c')").first().n_words == 3
    for bad in ("text_windows('a', 3, 5)", "text_windows(1)", "text_windows('a', 'b', 1)"):
        with pytest.raises(Exception, match="windows|text|number"):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_clauses(spark):
    tables.register(spark)
    text = "intro\n" + "".join(f"{c}) " + "palabra " * 20 + "\n" for c in "abc")
    df = spark.createDataFrame([(1, text), (2, "none"), (3, None)], "id int, content string")
    got = spark.sql("SELECT id, c.* FROM {df} t, LATERAL clauses(t.content) c ORDER BY id, clause_no", df=df).collect()
    assert [(r.id, r.label, r.clause) for r in got] == [(1, label, clause) for label, clause in chunking.clauses(text)] and len(got) == 3


def test_section_walk_over_a_table(spark):
    tables.register(spark)
    rows = []
    for d in ("x", "y"):
        rows += [(d, 0, 1, "paragraph", "Título", 0, 0, 1, None, (1, 0), [], []), (d, 1, 1, "paragraph", "uno", 1, 0, None, None, None, [(1, 1.0, 2.0, 3.0, 4.0)], []), (d, 2, 1, "paragraph", "dos", 2, 0, None, None, None, [], []), (d, 3, 2, "table", "a: b", 3, 1, None, ("t", 1, ["a"]), None, None, [])]
    blocks = spark.createDataFrame(rows[::-1], schemas.BLOCK)
    got = spark.sql("SELECT * FROM section_walk(TABLE({blocks}))", blocks=blocks)
    want = sections.build_sections(blocks)
    by = lambda df: [x.asDict(True) for x in df.orderBy("document_id", "block_no").collect()]
    assert by(got) == by(want) and got.count() == 4
    assert got.where(F.col("table_ref.table_id") == "t").count() == 2
