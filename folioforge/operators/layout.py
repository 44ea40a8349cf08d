"""From a layout reader's markdown, paragraphs and tables to blocks with geometry."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import dehyphenate
from folioforge.sources.schemas import BOX

TABLE_BASE, TABLE_STEP = 10_000_000, 1000
TOLERANCE, SHEET_TOLERANCE = 2.0, 1.0
#: Points that the smallest cells of a page's grid measure.
CELL = 32.0
EXACT_BELOW, PREFIX = 8, 40


def parse_markdown(pages: DataFrame) -> DataFrame:
    """document_id, markdown -> blocks (kind paragraph | table) in reading order.

    Running states over the lines of a document, all of them windows on one
    partitioning: page, inside a figure, inside a table, number of the paragraph.
    Rows of kind table are places for the table's rows; they have no content.
    """
    line = F.trim("raw")
    rows = pages.select("document_id", F.posexplode(F.split("markdown", r"\r\n|\n|\r")).alias("no", "raw")).withColumn("line", line)
    w = Window.partitionBy("document_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    is_break = F.col("line") == "<!-- PageBreak -->"
    rows = rows.withColumn("kind", F.when(is_break, "break").when(F.col("line").rlike(r"^<!--.*-->$"), "comment").when(F.col("line").rlike(r"(?i)^<figure\b.*>$"), "figure").when(F.col("line").rlike(r"(?i)^</figure>$"), "figure_end"))
    state = F.when(F.col("kind") == "figure", 1).when(F.col("kind") == "figure_end", 0)
    rows = rows.withColumn("page_number", 1 + F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(w)).withColumn("in_figure", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(0)))
    free = F.col("kind").isNull() & (F.col("in_figure") == 0)
    rows = rows.withColumn("kind", F.when(free & F.col("line").rlike(r"(?i)^<table\b.*>$"), "table").when(free & F.col("line").rlike(r"(?i)^</table>$"), "table_end").otherwise(F.col("kind")))
    state = F.when(F.col("kind") == "table", 1).when(F.col("kind") == "table_end", 0)
    rows = rows.withColumn("in_table", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(0)))
    free = F.col("kind").isNull() & (F.col("in_figure") == 0) & (F.col("in_table") == 0)
    rows = rows.withColumn("kind", F.when(free & F.col("line").rlike(r"^#+\s+\S"), "heading").when(free & (F.col("line") == ""), "blank").when(free, "text").otherwise(F.col("kind")))
    ends = F.col("kind").isin("break", "table", "heading", "blank")
    rows = rows.withColumn("part", F.sum(F.when(ends, 1).otherwise(0)).over(w))
    text = rows.where("kind = 'text'").groupBy("document_id", "page_number", "part")
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("no", "raw"))).getField("raw"), "\n")
    paragraphs = text.agg(F.min("no").alias("no"), F.trim(dehyphenate(joined)).alias("content")).where("content <> ''")
    paragraphs = paragraphs.select("document_id", "no", "page_number", F.lit("paragraph").alias("block_type"), "content", F.lit(None).cast("int").alias("heading_level"))
    headings = rows.where("kind = 'heading'").select("document_id", "no", "page_number", F.lit("paragraph").alias("block_type"), F.trim(F.regexp_replace("line", r"^#+\s+", "")).alias("content"), F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("heading_level"))
    tables = rows.where("kind = 'table'").select("document_id", "no", "page_number", F.lit("table").alias("block_type"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("int").alias("heading_level"))
    order = Window.partitionBy("document_id").orderBy("no")
    out = paragraphs.unionByName(headings).unionByName(tables)
    return out.withColumn("source_order", F.row_number().over(order) - 1).drop("no")


def unit_scale(unit: Column) -> Column:
    """Factor to points; null where lengths are no lengths (pixels, say)."""
    u = F.lower(F.trim(unit.cast("string")))
    return F.when(u.isin("inch", "inches", "in"), 72.0).when(u.isin("point", "points", "pt"), 1.0)


def bounding_box(polygon: Column, scale: Column, page: Column) -> Column:
    """The upright box of a polygon (x, y, x, y, ...) in points; null without a scale."""
    xs, ys = F.filter(polygon, lambda _, i: i % 2 == 0), F.filter(polygon, lambda _, i: i % 2 == 1)
    x, y = F.array_min(xs) * scale, F.array_min(ys) * scale
    box = F.struct(page.cast("int").alias("page"), x.alias("x"), y.alias("y"), (F.array_max(xs) * scale - x).alias("width"), (F.array_max(ys) * scale - y).alias("height"))
    return F.when(scale.isNotNull() & (F.size(polygon) >= 4), box)


def page_sizes(pages: DataFrame) -> DataFrame:
    s = unit_scale(F.col("unit"))
    return pages.where(s.isNotNull()).select("document_id", "page_number", (F.col("width") * s).alias("page_width"), (F.col("height") * s).alias("page_height"), s.alias("scale"))


def scaled(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows (document_id, page_number, polygon) with box in points; pages without a scale drop out."""
    return rows.join(page_sizes(pages), ["document_id", "page_number"]).withColumn("box", bounding_box(F.col("polygon"), F.col("scale"), F.col("page_number"))).where("box is not null")


def attach_lines(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines whose centre lies in a box of the block, two points tolerated.

    ``blocks``: document_id, block_no, bbox.  ``lines``: document_id,
    page_number, content, box.  A grid of several cell sizes: a box is in the few
    cells it touches of the size that fits it, a line in the one cell that its
    centre is in, of each size in use.  So a pair meets once, and only near pairs
    meet, however many boxes and lines a page has.
    """
    own = blocks.select("document_id", "block_no", F.explode("bbox").alias("b")).withColumn("page_number", F.col("b.page"))
    widest = F.greatest(F.col("b.width"), F.col("b.height"), F.lit(CELL)) + 2 * TOLERANCE
    own = own.withColumn("level", F.ceil(F.log2(widest / CELL)).cast("int"))
    levels = [r.level for r in own.select("level").distinct().collect() if r.level is not None]  # sizes double, so they are few
    side = CELL * F.pow(F.lit(2.0), F.col("level"))
    reach = lambda a, n: F.sequence(F.floor((F.col(a) - TOLERANCE) / side), F.floor((F.col(a) + F.col(n) + TOLERANCE) / side))
    own = own.withColumn("gx", F.explode(reach("b.x", "b.width"))).withColumn("gy", F.explode(reach("b.y", "b.height")))
    cx, cy = F.col("box.x") + F.col("box.width") / 2, F.col("box.y") + F.col("box.height") / 2
    at = lines.select("document_id", "page_number", "content", "box").withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    at = at.withColumn("gx", F.floor(cx / side)).withColumn("gy", F.floor(cy / side))
    inside = cx.between(F.col("b.x") - TOLERANCE, F.col("b.x") + F.col("b.width") + TOLERANCE) & cy.between(F.col("b.y") - TOLERANCE, F.col("b.y") + F.col("b.height") + TOLERANCE)
    hit = own.join(at, ["document_id", "page_number", "level", "gx", "gy"]).where(inside)
    line = F.struct(F.bround("box.y", 1).alias("o"), F.col("box.x").alias("x"), F.struct("box.x", "box.y", "box.width", "box.height", F.col("content").alias("t")).alias("line"))
    got = hit.groupBy("document_id", "block_no").agg(F.array_sort(F.collect_set(line)).getField("line").alias("lines"))
    return blocks.drop("lines").join(got, ["document_id", "block_no"], "left")


def table_rows(cells: DataFrame) -> DataFrame:
    """Rows of tables as "header: value" lines.

    ``cells``: document_id, table_id, row_index, column_index (from 0), kind,
    content.  Rows with header cells are no rows; a column without header is
    col_n; empty cells and rows go.  row_index counts from 1.
    """
    text = F.trim(F.coalesce("content", F.lit("")))
    c = cells.withColumn("content", text).where("content <> '' and row_index >= 0 and column_index >= 0")
    is_head = F.regexp_replace(F.lower(F.coalesce("kind", F.lit(""))), "[^a-z]", "").isin("columnheader", "stubhead")
    c = c.withColumn("head", is_head)
    key = ["document_id", "table_id"]
    cell = F.struct("column_index", "content", "head")
    rows = c.groupBy(*key, "row_index").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.max("head").alias("is_head"))
    # the header rows of a table are few; each of its rows looks its columns up in them
    named = F.transform(F.filter("cells", lambda x: x["head"]), lambda x: F.struct(x["column_index"].alias("c"), F.col("row_index").alias("r"), x["content"].alias("header")))
    rows = rows.withColumn("heads", F.flatten(F.collect_list(F.when(F.col("is_head"), named)).over(Window.partitionBy(*key)))).where("not is_head")
    own = lambda i: F.array_max(F.transform(F.filter("heads", lambda h: h["c"] == i), lambda h: F.struct(h["r"], h["header"].alias("header"))))["header"]
    header = lambda i: F.coalesce(own(i), F.concat(F.lit("col_"), (i + 1).cast("string")))
    fields = F.transform("cells", lambda x: F.struct(x["column_index"], header(x["column_index"]).alias("header"), x["content"]))
    out = rows.select(*key, "row_index", F.array_sort(fields).alias("f"))
    lines = F.transform("f", lambda x: F.concat_ws(": ", x["header"], x["content"]))
    ref = F.struct("table_id", (F.col("row_index") + 1).alias("row_index"), F.col("f.header").alias("headers"))
    return out.select(*key, (F.col("row_index") + 1).alias("row_index"), F.array_join(lines, "\n").alias("content"), ref.alias("table_ref"))


def place_tables(blocks: DataFrame, rows: DataFrame, tables: DataFrame) -> DataFrame:
    """Puts the rows of the n-th table at the n-th table place of the markdown.

    ``tables``: document_id, table_id, table_no (from 0), page_number.  A table
    without a place comes at the end of its page.
    """
    w = Window.partitionBy("document_id").orderBy("source_order")
    places = blocks.where("block_type = 'table'").withColumn("table_no", F.row_number().over(w) - 1).select("document_id", "table_no", F.col("page_number").alias("p"), "source_order")
    at = tables.join(places, ["document_id", "table_no"], "left")
    order = F.coalesce("source_order", F.lit(TABLE_BASE) + F.col("table_no") * TABLE_STEP)
    placed = rows.join(at.select("document_id", "table_id", F.coalesce("p", "page_number").alias("page_number"), order.alias("source_order")), ["document_id", "table_id"])
    placed = placed.select("document_id", "page_number", F.lit("table").alias("block_type"), "content", "source_order", F.col("row_index").alias("row_order"), "table_ref")
    rest = blocks.where("block_type <> 'table'").withColumn("row_order", F.lit(0))
    return rest.unionByName(placed, allowMissingColumns=True)


def paragraph_ids(paragraphs: DataFrame) -> DataFrame:
    """para_id (page, number on the page by span offset)."""
    w = Window.partitionBy("document_id", "page_number").orderBy("span_offset")
    return paragraphs.withColumn("para_id", F.struct(F.col("page_number").cast("int").alias("page"), (F.row_number().over(w) - 1).alias("idx")))


def same_text(a: str, b: str) -> bool:
    """Whether one of two paragraphs starts or ends with the other; short ones
    must be equal, long ones may agree on their first characters only."""
    return _agree(_plain(a), _plain(b))


def _plain(text: str | None) -> str:
    return re.sub(r"\\([\\`*_{}\[\]()#+\-.!|~>])", r"\1", " ".join((text or "").split()).lower())


def _agree(a: str, b: str) -> bool:
    short, long = sorted((a, b), key=len)
    if not short:
        return False
    if len(short) < EXACT_BELOW:
        return a == b
    return long.startswith(short) or long.endswith(short) or short[:PREFIX] == long[: min(PREFIX, len(short))]


def match_paragraphs(blocks: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(document_id, block_no, para_id, box): each paragraph serves one block.

    Forward from the last match first, then any that is free: a walk in reading
    order, per page.
    """

    def run(b: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        rows = p.sort_values("idx").to_dict("records")
        forms = [_plain(x["content"]) for x in rows]
        used, cursor, out = [False] * len(rows), -1, []
        for row in b.sort_values("block_no").itertuples(index=False):
            form = _plain(row.content)
            # forward first, then what was passed over
            for i in [*range(cursor + 1, len(rows)), *range(cursor + 1)]:
                if not used[i] and _agree(form, forms[i]):
                    used[i] = True
                    cursor = max(cursor, i)
                    out.append((row.document_id, row.block_no, row.page_number, rows[i]["idx"]))
                    break
        return pd.DataFrame(out, columns=["document_id", "block_no", "page_number", "idx"])

    p = paragraph_ids(paragraphs).withColumn("idx", F.col("para_id.idx"))
    left = blocks.where("block_type = 'paragraph'").select("document_id", "page_number", "block_no", "content").groupBy("document_id", "page_number")
    # both sides may come from one table: new columns keep them apart
    right = p.select(*(F.col(c).alias(c) for c in ("document_id", "page_number", "idx", "content"))).groupBy("document_id", "page_number")
    found = left.cogroup(right).applyInPandas(run, "document_id string, block_no int, page_number int, idx int")
    return found.join(p.select("document_id", "page_number", "idx", "para_id", *(["box"] if "box" in p.columns else [])), ["document_id", "page_number", "idx"]).drop("idx")


def valid_boxes(boxes: Column, width: Column, height: Column) -> Column:
    """Boxes with a size that lie on the sheet, one point tolerated."""
    t = SHEET_TOLERANCE
    return F.filter(boxes, lambda b: (b["width"] > 0) & (b["height"] > 0) & (b["x"] >= -t) & (b["y"] >= -t) & (b["x"] + b["width"] <= width + t) & (b["y"] + b["height"] <= height + t))


def with_geometry(blocks: DataFrame, paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds para_id and bbox (on the sheet, in points) of the paragraph that a block is.

    ``blocks`` need block_no.  A block without a paragraph, or on a page without
    a unit of length, has no box.
    """
    sizes = page_sizes(pages).select("document_id", "page_number", "page_width", "page_height")
    boxed = scaled(paragraphs, pages).select("document_id", "page_number", "span_offset", "box")
    found = match_paragraphs(blocks, paragraphs.join(boxed, ["document_id", "page_number", "span_offset"], "left")).select("document_id", "block_no", "para_id", "box")
    out = blocks.join(found, ["document_id", "block_no"], "left").join(sizes, ["document_id", "page_number"], "left")
    boxes = F.when(F.col("box").isNotNull(), valid_boxes(F.array("box"), F.col("page_width"), F.col("page_height")))
    return out.withColumn("bbox", F.coalesce(boxes, F.array().cast(f"array<{BOX}>"))).drop("box", "page_width", "page_height")


def row_boxes(cells: DataFrame, tables: DataFrame, pages: DataFrame) -> DataFrame:
    """document_id, table_id, row_index (from 1), box: around the cells of a row."""
    placed = scaled(cells.join(tables.select("document_id", "table_id", "page_number"), ["document_id", "table_id"]), pages)
    x, y = F.min("box.x"), F.min("box.y")
    wide, high = F.max(F.col("box.x") + F.col("box.width")) - x, F.max(F.col("box.y") + F.col("box.height")) - y
    box = F.struct(F.min("box.page").alias("page"), x.alias("x"), y.alias("y"), wide.alias("width"), high.alias("height"))
    return placed.groupBy("document_id", "table_id", (F.col("row_index") + 1).alias("row_index")).agg(box.alias("box"))


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_no, heading_level, content of headings and paragraphs of HTML.

    Tag soup of h1-h6 and p only, by expressions; a block ends where the next begins.
    """
    body = F.regexp_replace("html", r"(?is)<(script|style|nav|footer)\b.*?</\1>|<!--.*?-->", "")
    parts = F.split(F.regexp_replace(body, r"(?i)<(h[1-6]|p)(\s[^>]*)?>", "\u0001$1\u0002"), "\u0001")
    rows = pages.select("page_id", F.posexplode(F.slice(parts, 2, 1 << 30)).alias("block_no", "part"))
    tag, text = F.lower(F.substring_index("part", "\u0002", 1)), F.substring_index("part", "\u0002", -1)
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"<[^>]*>", " "), r"\s+", " "))
    level = F.when(tag.startswith("h"), F.substring(tag, 2, 1).cast("int"))
    return rows.select("page_id", F.col("block_no").cast("long").alias("block_no"), level.alias("heading_level"), text.alias("content")).where("content <> ''")


