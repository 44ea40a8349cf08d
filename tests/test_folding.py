"""Folding in the JVM and in Python is the same, and what unicodedata says."""

import unicodedata

from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.functions.plain import fold_char, fold_text
from folioforge.operators.classify import Category, matches

RANGES = ((0x20, 0x250), (0x250, 0x530), (0x1D00, 0x2200), (0x2200, 0x2C00), (0x3000, 0x3400), (0xAC00, 0xAC40), (0xF900, 0xFB50), (0xFE00, 0xFFFE), (0x1D400, 0x1D800), (0x1F100, 0x1F200))


def test_every_character(spark):
    chars = [chr(i) for a, b in RANGES for i in range(a, b) if not 0xD800 <= i < 0xE000]
    rows = [(i, f"x{c}y{c}") for i, c in enumerate(chars)] + [(len(chars), None), (len(chars) + 1, "")]
    got = {r.i: r.f for r in spark.createDataFrame(rows, "i int, t string").select("i", T.fold(F.col("t")).alias("f")).collect()}
    assert got[len(chars)] is None and got[len(chars) + 1] == ""
    wrong = []
    for i, c in enumerate(chars):
        marks = unicodedata.normalize("NFKD", c)
        plain = "".join(x for x in marks if not unicodedata.combining(x)).lower()
        if not 0xAC00 <= ord(c) < 0xD7A4:  # syllables stay whole on both sides
            assert unicodedata.normalize("NFC", plain) == fold_char(c)
        if got[i] != f"x{fold_char(c)}y{fold_char(c)}":
            wrong.append(c)
    # letters that the two languages lower differently for want of one Unicode version
    assert len(wrong) <= 5, [hex(ord(c)) for c in wrong]


def test_examples(spark):
    texts = ["Canción ﬁnal", "Canción ﬁnal…", "ő ű Å ẞ Ω ά", "№ 5 ½ ™", "ＡＢＣ １２", "İzmir", "\ud55c\uad6d"]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.grounding_form(F.col("t")).alias("f")).collect()]
    assert got == [fold_text(t) for t in texts]
    assert got[:2] == ["cancion final", "cancion final..."] and got[4] == "abc 12"
    hits = spark.createDataFrame([("El órgano ﬁscal y el rőd",)], "t string").select(matches(F.col("t"), Category("x", ("órgano fiscal", "röd", "fiscal")).terms).alias("n"))
    assert hits.first().n == 3
