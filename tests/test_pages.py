"""Pages with very many boxes, lines and citations."""

import random

from pyspark.sql import functions as F

from folioforge.operators import geometry, layout


def test_lines_in_boxes_equal_all_pairs(spark):
    r = random.Random(7)
    box = lambda page, n: {"page": page, "x": r.uniform(-50, 600), "y": r.uniform(-50, 800), "width": r.choice([0.0, 3.0, r.uniform(0, 90), r.uniform(0, n)]), "height": r.choice([0.0, 2.0, r.uniform(0, 40), r.uniform(0, n)])}
    blocks = [(d, i, [box(r.randrange(3), 900) for _ in range(r.choice([0, 1, 3]))]) for d in "ab" for i in range(60)] + [("a", 900, None)]
    lines = [(d, p, f"t{i}", box(p, 200)) for i in range(400) for d, p in [(r.choice("ab"), r.randrange(3))]]
    b = spark.createDataFrame(blocks, "document_id string, block_no int, bbox array<struct<page:int,x:double,y:double,width:double,height:double>>")
    t = spark.createDataFrame(lines, "document_id string, page_number int, content string, box struct<page:int,x:double,y:double,width:double,height:double>")
    got = {(x.document_id, x.block_no): sorted(y.t for y in x.lines or []) for x in layout.attach_lines(b, t).collect()}
    want = {}
    for d, no, boxes in blocks:
        held = set()
        for d2, p, text, o in lines:
            cx, cy = o["x"] + o["width"] / 2, o["y"] + o["height"] / 2
            if any(d == d2 and p == q["page"] and q["x"] - 2 <= cx <= q["x"] + q["width"] + 2 and q["y"] - 2 <= cy <= q["y"] + q["height"] + 2 for q in boxes or []):
                held.add(text)
        want[d, no] = sorted(held)
    assert got == want and sum(map(len, want.values())) > 100


def test_a_page_of_many_boxes_makes_no_product(spark):
    n = 40_000
    at = lambda c: F.struct(F.lit(1).alias("page"), (F.col("id") % 200 * 20.0).alias("x"), (F.floor(F.col("id") / 200) * 20.0).alias("y"), F.lit(c).alias("width"), F.lit(c).alias("height"))
    b = spark.range(n).select(F.lit("d").alias("document_id"), F.col("id").cast("int").alias("block_no"), F.array(at(16.0)).alias("bbox"))
    t = spark.range(n).select(F.lit("d").alias("document_id"), F.lit(1).alias("page_number"), F.col("id").cast("string").alias("content"), at(10.0).alias("box"))
    out = layout.attach_lines(b, t)  # 1.6e9 pairs
    assert out.where("size(lines) = 1 and lines[0].t = cast(block_no as string)").count() == n


def test_positions_of_many_citations_on_a_page(spark):
    r = random.Random(3)
    vocabulary = ["Plazo", "de", "aa", "aaa", "a", "-", "", "Ñandú,", "12.5", "oferta"]
    words = [("d", p, i, r.choice(vocabulary)) for p in (1, 2) for i in range(400)] + [("e", 1, 0, None), ("e", 1, 1, "plazo")]
    form = lambda x: "".join(c for c in (x or "").lower().replace("ñ", "n").replace("ú", "u") if c.isascii() and c.isalnum())
    asked = [(f"c{i}", r.choice("de"), r.choice([1, 2, 3]), " ".join(r.choices(vocabulary, k=r.randrange(1, 4)))) for i in range(150)] + [("x", "d", 1, None), ("y", "d", 1, "--"), ("z", None, 1, "plazo")]
    w = spark.createDataFrame(words, "document_id string, page_number int, word_no int, text string")
    c = spark.createDataFrame(asked, "citation_id string, document_id string, page_number int, citation string")
    want = []
    for cid, d, p, citation in asked:
        own = [(no, form(t)) for d2, p2, no, t in words if (d, p) == (d2, p2)]
        page, owner = "".join(f for _, f in own), [no for no, f in own for _ in f]
        needle, n = form(citation), 0
        for at in range(len(page) - len(needle) + 1 if needle else 0):
            if page.startswith(needle, at):
                want.append((cid, n, owner[at], owner[at + len(needle) - 1]))
                n += 1
    assert sorted(map(tuple, geometry.word_hits(w, c).collect())) == sorted(want) and len(want) > 500
