import pytest
from pyspark.sql import functions as F

from folioforge.operators import chunking, layout, sections
from folioforge.operators.sections import Block
from folioforge.sources.schemas import BLOCK


def para(text, page=1, boxes=()):
    return Block(page, "paragraph", text, None, None, None, list(boxes))


def head(text, level, page=1, boxes=()):
    return Block(page, "paragraph", text, level, None, None, list(boxes))


def row(text, table="t", n=1, page=1):
    return Block(page, "table", text, None, {"table_id": table, "row_index": n, "headers": ["a"]})


def paths(blocks):
    return [(" > ".join(s.path), s.text) for s in sections.sections_of(blocks)]


def test_markdown(spark):
    md = "# Title\n\nfirst line\nof hyphen-\nated text\n\n<!-- note -->\n<figure>\nlogo\n</figure>\n## Part\nbody\n<table>\n<tr><td>x</td></tr>\n</table>\nafter\n<!-- PageBreak -->\n### Deep\n\nlast"
    df = spark.createDataFrame([("d", md)], "document_id string, markdown string")
    got = [tuple(r) for r in layout.parse_markdown(df).orderBy("source_order").select("page_number", "block_type", "content", "heading_level").collect()]
    assert got == [
        (1, "paragraph", "Title", 1),
        (1, "paragraph", "first line\nof hyphenated text", None),
        (1, "paragraph", "Part", 2),
        (1, "paragraph", "body", None),
        (1, "table", None, None),
        (1, "paragraph", "after", None),
        (2, "paragraph", "Deep", 3),
        (2, "paragraph", "last", None),
    ]


def test_boxes_and_lines(spark):
    pages = spark.createDataFrame([("d", 1, "inch", 8.0, 11.0), ("d", 2, "pixel", 800.0, 1100.0), ("d", 3, "point", 600.0, 800.0)], "document_id string, page_number int, unit string, width double, height double")
    rows = spark.createDataFrame([("d", p, f"l{p}", [1.0, 1.0, 3.0, 1.0, 3.0, 2.0, 1.0, 2.0]) for p in (1, 2, 3)], "document_id string, page_number int, content string, polygon array<double>")
    got = {r.page_number: r.box.asDict() for r in layout.scaled(rows, pages).collect()}
    assert got == {1: {"page": 1, "x": 72.0, "y": 72.0, "width": 144.0, "height": 72.0}, 3: {"page": 3, "x": 1.0, "y": 1.0, "width": 2.0, "height": 1.0}}
    blocks = spark.createDataFrame([("d", 0, [(1, 70.0, 70.0, 200.0, 100.0)]), ("d", 1, [(1, 400.0, 70.0, 10.0, 10.0)])], "document_id string, block_no int, bbox array<struct<page:int,x:double,y:double,width:double,height:double>>")
    lines = layout.attach_lines(blocks, layout.scaled(rows, pages)).orderBy("block_no").collect()
    assert [x.t for x in lines[0].lines] == ["l1"] and lines[1].lines is None
    ok = spark.range(1).select(layout.valid_boxes(F.expr("array(struct(0D x,0D y,5D width,5D height),struct(0D x,0D y,700D width,5D height),struct(0D x,0D y,0D width,5D height))"), F.lit(600.0), F.lit(800.0)).alias("b")).first()
    assert len(ok.b) == 1


def test_tables(spark):
    cells = [("d", "t", 0, 0, "columnHeader", "Item"), ("d", "t", 0, 1, None, ""), ("d", "t", 1, 0, None, "bolt"), ("d", "t", 1, 1, None, "4"), ("d", "t", 2, 0, None, " "), ("d", "t", 3, 1, None, "9")]
    df = spark.createDataFrame(cells, "document_id string, table_id string, row_index int, column_index int, kind string, content string")
    got = {r.row_index: (r.content, r.table_ref.headers) for r in layout.table_rows(df).collect()}
    assert got == {2: ("Item: bolt\ncol_2: 4", ["Item", "col_2"]), 4: ("col_2: 9", ["col_2"])}
    md = spark.createDataFrame([("d", "a\n<table>\n</table>\nb")], "document_id string, markdown string")
    tables = spark.createDataFrame([("d", "t", 0, 1)], "document_id string, table_id string, table_no int, page_number int")
    out = layout.place_tables(layout.parse_markdown(md), layout.table_rows(df), tables).orderBy("source_order", "row_order").collect()
    assert [r.content for r in out] == ["a", "Item: bolt\ncol_2: 4", "col_2: 9", "b"]


def test_matching_paragraphs(spark):
    assert layout.same_text("Articulo 10: GAR", "articulo 10: garantia") and not layout.same_text("ab", "abc") and layout.same_text("1\\. x", "1. x")
    blocks = spark.createDataFrame([("d", 1, i, "paragraph", t) for i, t in enumerate(["HEAD", "the first paragraph", "HEAD", "unknown text here"])], "document_id string, page_number int, block_no int, block_type string, content string")
    paras = spark.createDataFrame([("d", 1, 0, "HEAD"), ("d", 1, 5, "figure words"), ("d", 1, 9, "the first paragraph"), ("d", 1, 20, "HEAD")], "document_id string, page_number int, span_offset int, content string")
    got = {r.block_no: r.para_id.idx for r in layout.match_paragraphs(blocks, paras).collect()}
    assert got == {0: 0, 1: 2, 2: 3}


def test_siblings_and_levels():
    blocks = [head("Artículo 1: OBJETO", 2), para("uno"), head("Artículo 2: OTRA", 2), para("dos")]
    assert paths(blocks) == [("Artículo 1: OBJETO", "uno"), ("Artículo 2: OTRA", "dos")]
    three = [head("1. UNO", 2), head("2. DOS", 3), head("3. TRES", 2)]
    assert [b.level for b in sections.level_sequences(three)] == [2, 2, 2]
    deep = [head("1. Uno", 1), head("1.1. Dos", 1), head("1.1.1. Tres", 2), head("2. X", 1)]
    assert [b.level for b in sections.level_decimals(deep)] == [1, 2, 3, 1]
    free = [head("3. Uno", 2), head("Capa", 2), head("Sub", 3), head("Anexo I", 1), head("Y", 1)]
    assert [b.level for b in sections.nest_unnumbered(free)] == [2, 3, 4, 1, 3]


def test_heading_without_body_stays():
    assert paths([head("ANEXO", 1), head("1. Uno", 1), para("x")]) == [("ANEXO", ""), ("1. Uno", "x")]
    assert paths([head("A", 1), head("B", 2)]) == [("A > B", ""), ("A", "")]


def frame(spark, docs):
    kind = "document_id string, page_number int, block_type string, content string, source_order int, row_order int, heading_level int, table_ref struct<table_id:string,row_index:int,headers:array<string>>"
    return spark.createDataFrame([(d, b.page, b.kind, b.text, i, 0, b.level, b.table) for d, blocks in docs.items() for i, b in enumerate(blocks)], kind)


def test_listing(spark):
    toc = lambda ends: [row(f"col_1: {i}.1. Cap\ncol_2: {e}", "toc", i, 2) for i, e in enumerate(ends, 1)]
    body = [para("text of the tender", p) for p in range(3, 46)]
    lines = lambda texts: [para(t, 2) for t in texts]
    entry = [f"{i}. Part" for i in range(1, 7)]
    docs = {
        "good": toc(range(4, 11)) + body,
        "few": toc(range(4, 8)) + body,
        "beyond": toc([90 * i for i in range(1, 8)]) + body,
        "falling": toc([20 - i for i in range(1, 8)]) + body,
        "own page": toc([1] * 3 + [2] * 4) + body,
        "one target": toc([9] * 7) + body,
        # a number alone ends the entry above it
        "lone": lines([x for i, e in enumerate(entry) for x in (e, str(5 + i))]) + body,
        "lone first": lines(["3", *(f"{e} {5 + i}" for i, e in enumerate(entry))]) + body,
        "no prefix": lines([f"Part {'abcdef'[i]} {5 + i}" for i in range(6)]) + body,
        "some without page": lines([f"{i}. Part {i + 3 if i != 4 else ''}" for i in range(1, 7)]) + body,
        "heading between": lines([f"{i}. Part {i + 3}" for i in range(1, 5)]) + [head("H", 1, 2)] + lines([f"{i}. Part {i + 3}" for i in range(5, 8)]) + body,
        "escaped": lines([f"{i}\\. Part {i + 3}" for i in range(1, 7)]) + body,
        "empty": [para("", 2)] + body,
    }
    left = {r.document_id: r["count"] for r in sections.without_listings(frame(spark, docs)).groupBy("document_id").count().collect()}
    gone = {d: len(b) - left.get(d, 0) for d, b in docs.items() if len(b) != left.get(d, 0)}
    assert gone == {"good": 7, "lone": 12, "lone first": 7, "some without page": 6, "escaped": 6}


def test_furniture(spark):
    pages = [x for p in range(1, 6) for x in (para("City  Hall", p), para(f"own text {p}", p), head("Same", 1, p), row("same row", "t", 1, p))]
    docs = {"five": pages, "two": pages[:8], "long": [para("long clause " * 20, p) for p in range(1, 6)]}
    left = sections.without_furniture(frame(spark, docs)).select("document_id", "content").collect()
    assert all("Hall" not in r.content for r in left if r.document_id == "five")
    assert [sum(r.document_id == d for r in left) for d in docs] == [15, 8, 5]


def test_split_headings():
    got = sections.join_across_pages([head("3.1. Plataforma de", 2, 1), head("software base", 2, 2), head("ARTÍCULO 12: PLA", 2, 3), head("ZO DE ENTREGA", 2, 4)])
    assert [b.text for b in got] == ["3.1. Plataforma de software base", "ARTÍCULO 12: PLAZO DE ENTREGA"]
    box = lambda y: [{"page": 1, "x": 0.0, "y": y, "width": 9.0, "height": 10.0}]
    got = sections.join_tails([head("Artículo 10: GAR", 2, 1, box(100.0)), para("ANTÍA DE OFERTA: En caso de", 1, box(102.0))])
    assert [b.text for b in got] == ["Artículo 10: GARANTÍA DE OFERTA", "En caso de"]
    apart = [head("Artículo 10: GAR", 2, 1, box(100.0)), para("ANTÍA DE OFERTA: En caso de", 1, box(150.0))]
    assert sections.join_tails(apart) == apart


def test_run_in_heading():
    got = sections.promote_run_ins([para("Artículo 10: GARANTÍA DE OFERTA: En caso de corresponder"), para("10. de los pagos se descontara. Y mas")])
    assert [(b.text, b.level) for b in got][:2] == [("Artículo 10: GARANTÍA DE OFERTA", 2), ("En caso de corresponder", None)] and len(got) == 3


def test_merging_tables():
    got = sections.merge_sections(sections.with_paths([head("S", 1), para("Intro.\n\nThe table follows:"), row("a: 1", n=1), row("a: 2", n=2), row("a: " + "x" * 2100, n=3), para("after")]))
    assert [s.text[:10] for s in got] == ["Intro.\n\nTh", "a: 1\na: 2", "a: xxxxxxx", "after"]
    assert got[1].context == got[2].context == "The table follows:" and got[1].table["row_index"] == 2


def test_packing():
    three = [" ".join(["w"] * 690)] * 3
    assert [len(p.split()) for p in chunking.pack(three)] == [690, 690, 690]
    small = [" ".join([f"p{i}"] * 100) for i in range(9)]
    got = chunking.pack(small)
    assert [len(p.split()) for p in got] == [700, 300] and got[1].startswith("p6")
    big = chunking.pack([" ".join(map(str, range(1500)))])
    assert [len(p.split()) for p in big] == [700, 700, 340] and big[0].split()[-120:] == big[1].split()[:120]
    with pytest.raises(ValueError):
        chunking.pack(["a"], 10, 10)


def test_chunks_with_children(spark):
    clause = "a) " + "uno " * 40 + "\nb) " + "dos " * 40
    article = "Texto introductorio del articulo. " * 20 + "\n" + clause
    rows = [("d", 0, 1, "paragraph", "# ", None, None), ("d", 1, 1, "paragraph", "ARTICULO 5", 2, None), ("d", 2, 1, "paragraph", article, None, None), ("d", 3, 2, "paragraph", "Corto.", None, None)]
    full = [(d, i, p, k, t.strip("# ") if i else "", i, 0, lv, None, None, [], None) for d, i, p, k, t, lv, _ in rows]
    blocks = spark.createDataFrame(full, BLOCK)
    made = sections.build_sections(blocks)
    got = chunking.create_chunks(made).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.chunk_type, r.parent_chunk_index, r.title) for r in got] == [(0, "parent", None, "ARTICULO 5"), (1, "child", 0, "ARTICULO 5.a)"), (2, "child", 0, "ARTICULO 5.b)"), (3, "normal", None, "ARTICULO 5")]
    assert {r.section_path for r in got} == {"ARTICULO 5"} and all(r.blocks for r in got)
    assert sections.build_sections(blocks.limit(0)).count() == 0
    assert chunking.clauses("a) corto\nb) corto") == []


def test_table_lines_shuffle_orders_once(spark):
    from folioforge import registry

    df = registry.queries()["table_lines"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_the_last_header_of_a_column_names_it(spark):
    cells = [("d", "t", 0, 0, "columnHeader", "Old"), ("d", "t", 1, 0, "column header", "New"), ("d", "t", 1, 2, "stubHead", "Z"), ("d", "t", 3, 2, "", "c"), ("d", "t", 3, 0, None, "a"), ("d", "t", 3, 1, None, "b"), ("d", "t", 4, 0, None, " "), ("d", "u", 0, 0, None, "x"), (None, "t", 0, 0, None, "y")]
    df = spark.createDataFrame(cells, "document_id string, table_id string, row_index int, column_index int, kind string, content string")
    got = {(r.document_id, r.table_id, r.row_index): r.content for r in layout.table_rows(df).collect()}
    assert got == {("d", "t", 4): "New: a\ncol_2: b\nZ: c", ("d", "u", 1): "col_1: x", (None, "t", 1): "col_1: y"}
