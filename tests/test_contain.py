import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.operators import contain
from folioforge.operators.contain import contained, picked_grams


def sides(seed=3):
    r = random.Random(seed)
    words = ["plazo", "de", "la", "oferta", "días", "hábiles", "語", "🙂", "x", "12.000"] + [f"w{i}" for i in range(60)]
    texts = []
    for i in range(250):
        texts.append((r.choice("ab"), r.choice([1, 2, None]), i, " ".join(r.choices(words, k=r.choice([0, 2, 30, 120])))))
    texts += [("a", 1, 900 + i, "same boilerplate line for everybody " + "and more " * i) for i in range(40)] + [("a", 1, 999, None), (None, 1, 998, "plazo de la oferta plazo")]
    sought = []
    for _ in range(300):
        d, p, _, t = r.choice(texts)
        if t:
            lo = r.randrange(len(t))
            sought.append((d, p, t[lo : lo + r.choice([1, 5, 12, 13, 40, 400])]))
    sought += [("a", 1, "boilerplate line for every"), ("a", 1, "is nowhere to be found"), ("a", 1, ""), ("a", 1, None), ("b", None, "plazo de la oferta"), sought[0]]
    return texts, sought


@pytest.mark.parametrize("sent", [contain.SENT, -1])
def test_equal_to_all_pairs(spark, monkeypatch, sent):
    monkeypatch.setattr(contain, "SENT", sent)
    monkeypatch.setattr(contain, "SLICE", 300)
    texts, sought = sides()
    t = spark.createDataFrame([(*x, "z") for x in texts], "doc string, page int, id int, text string, gram string").repartition(3)
    s = spark.createDataFrame(sought, "doc string, page int, form string")
    got = sorted(tuple(x) for x in contained(s, t, ["doc", "page"], ["id"]).collect())
    want = sorted({(d, p, f, i) for d, p, f in sought if d and p and f for d2, p2, i, text in texts if (d, p) == (d2, p2) and text and f in text})
    assert got == want and len(want) > 200
    long = s.where(F.octet_length("form") >= 12)
    got = sorted(tuple(x) for x in contained(long, t, (), ["id"]).collect())
    assert got == sorted({(f, i) for *_, f in sought if f and len(f.encode()) >= 12 for *_, i, text in texts if text and f in text})
    with pytest.raises(ValueError):
        contained(s, t, (), ["id"])


def test_every_run_of_a_text_is_in_its_holder():
    r = random.Random(1)
    for _ in range(300):
        hay = bytes(r.choices(b"abc", k=r.randrange(12, 90)))
        lo = r.randrange(len(hay) - 11)
        part = hay[lo : lo + r.randrange(12, len(hay) - lo + 1)]
        own = picked_grams(np.frombuffer(part, np.uint8), np.array([len(part)]))[1]
        held = picked_grams(np.frombuffer(b"x" * 20 + hay, np.uint8), np.array([20, 20 + len(hay)]))
        assert len(own) and set(own.tolist()) <= set(held[1][held[0] == 1].tolist())
    assert not len(picked_grams(np.frombuffer(b"short", np.uint8), np.array([5]))[0])


def test_one_gram_in_most_texts(spark, monkeypatch):
    monkeypatch.setattr(contain, "HOT", 4)
    t = spark.range(900).selectExpr("id", "concat('the common line of all ', if(id % 3 = 0, 'and a rare one ', ''), id) as text")
    s = spark.createDataFrame([("the common line of all",), ("and a rare one 3",)], "form string")
    got = contained(s, t, (), ["id"])
    assert got.where("form like 'the%'").count() == 900
    assert {x.id for x in got.where("form like 'and%'").collect()} == {i for i in range(900) if i % 3 == 0 and str(i).startswith("3")}
    assert contained(s, t.limit(0), (), ["id"]).collect() == [] and contained(s.limit(0), t, (), ["id"]).collect() == []


def test_grams_written_grow_with_the_sought_side_and_not_with_the_texts(spark, monkeypatch):
    r = random.Random(5)
    words = ["la", "obra", "del", "plazo", "oferta", "pago", "acta", "de"]
    rows = [("d", i % 3, i, " ".join(r.choices(words, k=300))) for i in range(240)]
    rows += [("d", 0, 1000 + i, rows[0][3]) for i in range(20)]  # copies
    t = spark.createDataFrame(rows, "doc string, page long, id int, text string")
    s = spark.createDataFrame([(d, p, x[:90]) for d, p, i, x in rows] + [("d", 1, "del plazo oferta")], "doc string, page int, form string")
    seen, keep = {}, contain.written
    monkeypatch.setattr(contain, "written", lambda df, name: seen.setdefault(name, keep(df, name)))
    got = {tuple(x) for x in contained(s, t, ["doc", "page"], ["id"]).collect()}
    assert got == {(d, p, f[:90], i) for d, p, _, f in rows for d2, p2, i, text in rows if p == p2 and f[:90] in text} | {("d", 1, "del plazo oferta", i) for _, p, i, text in rows if p == 1 and "del plazo oferta" in text}
    assert seen["contain-held"].count() < 4 * contain.KEPT * len(rows)  # the texts have some 400 picked grams each


@pytest.mark.parametrize("sent", [60, 3000])
def test_candidates_go_to_the_texts_in_several_parts(spark, monkeypatch, sent):
    monkeypatch.setattr(contain, "SENT", sent)
    monkeypatch.setattr(contain, "PASSES", 100)
    t = spark.range(40).selectExpr("'d' as doc", "id", "concat('what number ', id, ' says about its own page, no other one does') as text")
    s = t.selectExpr("doc", "substring(text, 1, 45) as form").union(spark.createDataFrame([("d", "page")], "doc string, form string"))
    got = contained(s, t, ["doc"], ["id"])
    assert got.where("form <> 'page'").count() == 40 and got.where("form = 'page'").count() == 40
