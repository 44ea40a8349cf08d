"""Where a citation stands on a page: words, lines and rectangles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.plain import fold_text
from folioforge.functions.text import alnum_form

SAME_LINE, WORD_GAP, LINE_STEP = 0.3, 1.5, 1.8
HEADING_STOP = frozenset("articulo art capitulo seccion anexo clausula punto inciso".split())
LEAST_FRAGMENT = 4


def word_hits(words: DataFrame, citations: DataFrame) -> DataFrame:
    """Every occurrence of a citation in the words of its page.

    ``words``: document_id, page_number, word_no, text.  ``citations``:
    citation_id, document_id, page_number, citation.  Compares letters and digits
    only.  Out: citation_id, occurrence (from 0), first_word, last_word;
    occurrences may overlap.  A page and its citations meet once: its words are
    one string, one automaton of all its citations reads it in one pass, and
    running lengths give the words of a place by binary search.
    """
    page = ["document_id", "page_number"]
    own = words.select(*page, F.col("word_no").cast("int").alias("word_no"), alnum_form(F.col("text")).alias("form"))
    asked = citations.select(*page, F.col("citation_id").cast("string").alias("citation_id"), alnum_form(F.col("citation")).alias("needle")).where("needle <> ''")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import ahocorasick

        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            left = left.filter(pc.not_equal(left["form"], "")).sort_by("word_no")
            numbers = left["word_no"].to_numpy()
            ends = np.cumsum(pc.utf8_length(left["form"]).to_numpy())
            of: dict[str, list[str]] = {}
            for c, needle in zip(right["citation_id"].to_pylist(), right["needle"].to_pylist()):
                of.setdefault(needle, []).append(c)
            index = ahocorasick.Automaton()
            for needle in of:
                index.add_word(needle, needle)
            index.make_automaton()
            seen = dict.fromkeys(of, 0)
            # matches of one citation end, and so begin, in ascending order
            for last, needle in index.iter("".join(left["form"].to_pylist())):
                a, b = np.searchsorted(ends, (last - len(needle) + 1, last), "right")
                out += [(c, seen[needle], int(numbers[a]), int(numbers[b])) for c in of[needle]]
                seen[needle] += 1
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["citation_id", "occurrence", "first_word", "last_word"])

    # both sides may come from one table: new columns keep them apart
    asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))
    return own.groupBy(*page).cogroup(asked.groupBy(*page)).applyInArrow(run, "citation_id string, occurrence int, first_word int, last_word int")


def line_regions(lines: DataFrame, citations: DataFrame) -> DataFrame:
    """Parts of read lines that the first occurrence of a citation covers.

    ``lines``: citation_id, line_no, x, y, width, height, t.  ``citations``:
    citation_id, citation.  A line's part is proportional to its letters; two
    decimals.
    """
    w = Window.partitionBy("citation_id").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("form", alnum_form(F.col("t"))).withColumn("n", F.length("form")).withColumn("start", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    text = rows.groupBy("citation_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "form"))).getField("form"), "").alias("text"))
    asked = citations.select("citation_id", alnum_form(F.col("citation")).alias("needle")).where("needle <> ''")
    found = text.join(asked, "citation_id").select("citation_id", (F.instr("text", F.col("needle")) - 1).alias("at"), F.length("needle").alias("size")).where("at >= 0")
    r = rows.join(found, "citation_id").where((F.col("n") > 0) & (F.col("start") < F.col("at") + F.col("size")) & (F.col("start") + F.col("n") > F.col("at")))
    a = F.greatest(F.lit(0), F.col("at") - F.col("start")) / F.col("n")
    b = F.least(F.col("n"), F.col("at") + F.col("size") - F.col("start")) / F.col("n")
    return r.select("citation_id", "line_no", F.round(F.col("x") + F.col("width") * a, 2).alias("x"), F.round("y", 2).alias("y"), F.round(F.col("width") * (b - a), 2).alias("width"), F.round("height", 2).alias("height"))


def group_occurrences(rects: DataFrame, key: str = "citation_id", order: str = "rect_no") -> DataFrame:
    """Adds occurrence: rectangles that follow on the line or on the next line."""
    w = Window.partitionBy(key).orderBy(order)
    prev = {c: F.lag(c).over(w) for c in ("x", "y", "width", "height")}
    h = F.greatest(prev["height"], F.lit(1.0))
    step, gap = F.col("y") - prev["y"], F.col("x") - prev["x"] - prev["width"]
    goes_on = F.when(F.abs(step) <= SAME_LINE * h, gap.between(0, WORD_GAP * h)).otherwise((step > 0) & (step <= LINE_STEP * h))
    fresh = rects.withColumn("__new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1))
    return fresh.withColumn("occurrence", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("__new")


def merge_lines(rects: list[dict]) -> list[dict]:
    """Rectangles of one line as one; a line is as high as what it has gathered."""
    out: list[list[float]] = []
    for r in sorted(rects, key=lambda r: (r["y"], r["x"])):
        x0, y0, x1, y1 = r["x"], r["y"], r["x"] + r["width"], r["y"] + r["height"]
        if out and abs(y0 - out[-1][1]) <= SAME_LINE * max(out[-1][3] - out[-1][1], 1.0):
            last = out[-1]
            last[:] = [min(last[0], x0), min(last[1], y0), max(last[2], x1), max(last[3], y1)]
        else:
            out.append([x0, y0, x1, y1])
    return [{"x": a, "y": b, "width": c - a, "height": d - b} for a, b, c, d in out]


REGION = "array<struct<x:double,y:double,width:double,height:double>>"


def regions(rects: DataFrame, keys: list[str]) -> DataFrame:
    """keys, regions: the merged lines of each occurrence."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["regions"] = [merge_lines([dict(x) for x in rs]) for rs in f.pop("rects")]
            yield f

    rows = rects.groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "width", "height")).alias("rects"))
    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", regions {REGION}")


def heading_words(text: str) -> set[str]:
    import re

    return {w for w in re.findall(r"[a-z0-9]+", fold_text(text)) if w not in HEADING_STOP and len(w) > 1}


def choose_occurrence(first_rects: list[dict], headings: list[dict], hint: str | None) -> int:
    """The occurrence nearest below a heading that shares words with the hint.

    Distance: twice the vertical plus half the horizontal, divided by one more
    than the words in common.  Without a fitting heading the topmost.
    """
    wanted = heading_words(hint or "")
    best = None
    for i, r in enumerate(first_rects):
        for h in headings:
            common = len(wanted & heading_words(h["text"]))
            if common and h["y"] <= r["y"]:
                far = (2 * abs(r["y"] - h["y"]) + 0.5 * abs(r["x"] - h["x"])) / (1 + common)
                best = min(best or (far, i), (far, i))
    return best[1] if best else min(range(len(first_rects)), key=lambda i: (first_rects[i]["y"], i))


def pick_occurrences(rects: DataFrame, headings: DataFrame, hints: DataFrame) -> DataFrame:
    """citation_id, occurrence.  ``rects``: citation_id, occurrence, rect_no, x, y;
    ``headings``: document_id, page_number, text, x, y; ``hints``: citation_id,
    document_id, page_number, section_hint."""
    first = rects.groupBy("citation_id", "occurrence").agg(F.min_by(F.struct("x", "y"), "rect_no").alias("r"))
    listed = first.groupBy("citation_id").agg(F.array_sort(F.collect_list(F.struct("occurrence", "r"))).alias("o"))
    per_page = headings.groupBy("document_id", "page_number").agg(F.collect_list(F.struct("text", "x", "y")).alias("h"))
    rows = listed.join(hints, "citation_id").join(per_page, ["document_id", "page_number"], "left").select("citation_id", "o", "h", "section_hint")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                i = choose_occurrence([dict(x["r"]) for x in r.o], [dict(x) for x in r.h] if r.h is not None else [], r.section_hint)
                out.append((r.citation_id, r.o[i]["occurrence"]))
            yield pd.DataFrame(out, columns=["citation_id", "occurrence"])

    return rows.mapInPandas(run, "citation_id string, occurrence int")


def source_of_regions(live: Column, ocr: Column, page_has_text: Column) -> Column:
    """struct(regions, method, reason): the page's own text first, read lines only
    where the page has no text."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    none = F.lit(None).cast(REGION)
    made = lambda r, m, why: F.struct(r.alias("regions"), F.lit(m).alias("method"), F.lit(why).alias("reason"))
    return F.when(some(live), made(live, "text", None)).when(page_has_text, made(none, "none", "not_found")).when(some(ocr), made(ocr, "ocr", None)).otherwise(made(none, "none", "no_text_layer"))


def coverage(rows: DataFrame, by: str) -> DataFrame:
    """Share of sources with regions, in percent."""
    return rows.groupBy(by).agg(F.round(100.0 * F.count_if(F.size("regions") > 0) / F.count("*"), 1).alias("coverage"))


def combine_regions(rects: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """Different rectangles of a page, scaled for display."""
    cols = ["x", "y", "width", "height"]
    return rects.dropDuplicates([*keys, *cols]).select(*keys, *[(F.col(c) * scale).alias(c) for c in cols])


def is_fragment(fragment: Column, citation: Column, stop: tuple[str, ...] = ()) -> Column:
    """Whole words of the citation, at least four letters, no stop word."""
    f = F.lower(F.trim(fragment))
    quoted = F.regexp_replace(f, r"([^\p{L}\p{N}\s])", r"\\$1")
    whole = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])"))
    return (F.length(f) >= LEAST_FRAGMENT) & ~f.isin(*(stop or ("",))) & F.rlike(F.lower(citation), whole)


