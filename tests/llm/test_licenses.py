import random
import re

import duckdb
import pytest

from folioforge.llm import licenses as L
from folioforge.llm import queries as Q
from folioforge.llm.licenses import TEMPLATES, Index, compiled, scan_licenses, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text, templates=TEMPLATES):
    w = WORD.findall((text or "").translate(LOWER))
    base = [(i, label) for label, p in L.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    fits = {}
    for k, t in enumerate(compiled(templates, L.THRESHOLD)):
        half, b = t.window // 2, 0
        while w and (b == 0 or b * half + half < len(w)):
            c = len(t.words & set(w[b * half : b * half + t.window]))
            if c >= t.least:
                fits.setdefault((t.family, t.window, b), []).append((c / len(t.words), len(t.words), t.label))
            b += 1
    labels, score = {x for _, x in base}, 1.0 if base else 0.0
    for found in fits.values():
        top = {f for f in found if f[:2] == max(found)[:2]}
        labels |= {f[2] for f in top} if len({f[2] for f in top}) == 1 else set()
        score = max(score, *(f[0] for f in found))
    at = [i for i, _ in base]
    return len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score


def corpus():
    r = random.Random(8)
    common = ["the", "of", "and", "to", "in", "license", "under", "software", "été", "語", "x1", "a", "b", "by", "cc", "nc", "mit", "version", "2", "apache"]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(r.randrange(0, 4)):
            parts.append(" ".join(r.choices(common, k=r.randrange(0, 200))))
            notice = r.choice(TEMPLATES)[2].split()
            for _ in range(r.choice([0, 0, 1, 4, 9])):  # edits: some are too many
                notice[r.randrange(len(notice))] = r.choice(["foo", "the", "bar"])
            parts.append(r.choice(["\n# ", " ", "\n\n"]).join(notice) if r.random() < 0.8 else " ".join(notice[: len(notice) // 2]))
        rows.append((i, r.choice(["", "\n", ". "]).join(parts)))
    rows += [(900, None), (901, ""), (902, "\x00 -- ,"), (903, "UNDER the MIT-license, Under THE mit\nlicense cc.by.nc cc by nc Apache license, version 2"), (904, "under the mit"), (904, "under the mit"), (None, "CC BY-NC 4.0")]
    rows += [(905, "Licensed under CC BY-NC 4.0."), (906, "Licensed under CC BY 4.0."), (907, "This work is licensed under the GNU General Public License, version 3."), (908, "word " * 40_000 + TEMPLATES[2][2] + " word" * 40_000), (909, "GNU General Public License version")]
    return rows


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equal_to_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, n_words int, labels string").repartition(3)
    got = as_rows(Q.license_digest(docs))
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=repr)
    of = {x[0]: x for x in got}
    assert of[905][6] == "cc-by-nc" and of[906][6] == "cc-by" and of[907][6] == "gpl-3" and of[908][6] == "mit" and of[909][6] == ""


def test_query_equals_sql(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(f"SELECT doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score FROM ({Q.op11_sql()})").fetchall()
    assert as_rows(Q.op11_license_join(spark, str(tmp_path))) == sorted(want, key=repr)


def test_filters_lose_nothing():
    r = random.Random(1)
    known = compiled([("f", f"l{k}", " ".join(r.sample([f"w{i}" for i in range(60)], r.randrange(1, 16)))) for k in range(80)], 70)
    vocabulary = sorted({w for t in known for w in t.words})
    index = Index(known, vocabulary, {i: r.randrange(100) for i in range(len(vocabulary))})
    for _ in range(500):
        block = set(r.sample(vocabulary, r.randrange(1, 40)))
        ranks = sorted(int(index.rank[vocabulary.index(w)]) for w in block)
        assert index.match(32, ranks) == [(k, len(t.words & block)) for k, t in enumerate(known) if len(t.words & block) >= t.least]


def test_general_interface(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "six")], "doc_id long, text string")
    out = {x.doc_id: x for x in scan_licenses(docs, [("own", "mine", "two three four")], (("p", "four five"),), 100).collect()}
    assert out[1].labels == ["mine", "p"] and out[1].first_word == 3 and out[1].matches[0].shared == 3 and out[2].labels == [] and out[2].score == 0.0
    assert scan_licenses(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        compiled([("f", "l", "word " * 300)], 85)
    with pytest.raises(ValueError):
        compiled([("f", "l", "")], 85)
    assert words("Ab-é 語1") == ["ab", "é", "語1"]
