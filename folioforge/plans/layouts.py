"""Queries over layout, sections, extraction, narratives and geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import chunking, extract, geometry, ground, layout, narrative, sections
from folioforge.sources import schemas

from .chunks import _folded
from .common import table
from .facts import _FORM


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    return layout.html_blocks(table(spark, d, "pages"))


HTML_BLOCKS = r"""
WITH b AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<nav\b.*?</nav>|<footer\b.*?</footer>|<!--.*?-->', '', 'g') AS body FROM pages),
p AS (SELECT page_id, string_split(regexp_replace(body, '(?i)<(h[1-6]|p)(\s[^>]*)?>', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM b),
r AS (SELECT page_id, unnest(range(1, len(parts))) AS no, parts FROM p),
x AS (SELECT page_id, no - 1 AS block_no, lower(split_part(parts[no + 1], chr(2), 1)) AS tag, split_part(parts[no + 1], chr(2), 2) AS t FROM r),
c AS (SELECT page_id, block_no, CASE WHEN tag[1] = 'h' THEN CAST(tag[2] AS INT) END AS heading_level, trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS content FROM x)
SELECT page_id, block_no, heading_level, content FROM c WHERE content <> ''
"""


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """The headings and paragraphs of the pages, three to a sheet."""
    b = html_blocks(spark, d)
    empty = lambda kind: F.lit(None).cast(kind)
    return b.select(
        F.col("page_id").cast("string").alias("document_id"),
        F.col("block_no").cast("int").alias("block_no"),
        (1 + F.floor(F.col("block_no") / 3)).cast("int").alias("page_number"),
        F.lit("paragraph").alias("block_type"),
        "content",
        F.col("block_no").cast("int").alias("source_order"),
        F.lit(0).alias("row_order"),
        "heading_level",
        empty(schemas.TABLE_REF).alias("table_ref"),
        empty(schemas.PARA_ID).alias("para_id"),
        F.array().cast(f"array<{schemas.BOX}>").alias("bbox"),
        empty(f"array<{schemas.LINE}>").alias("lines"),
    )


def contents_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as documents, line numbers as pages, their lines as entries that end
    in a page; of some suppliers the pages fall, or most lines have no number."""
    f = table(spark, d, "lineitem")
    kind, n = F.col("l_suppkey") % 4, F.col("l_quantity").cast("int")
    end = F.when(kind == 1, 60 - n).otherwise(n).cast("string")
    entry = F.concat_ws(" ", F.concat(F.col("l_linenumber").cast("string"), F.lit(".")), "l_linestatus", end)
    line = F.when((kind == 2) & (F.col("l_orderkey") % 3 > 0), F.col("l_linestatus")).when((kind == 3) & (F.col("l_orderkey") % 2 == 0), F.concat("l_linestatus", F.lit(" "), "l_returnflag")).otherwise(entry)
    rows = f.select(F.col("l_suppkey").cast("string").alias("document_id"), F.col("l_linenumber").cast("int").alias("page_number"), line.alias("content"), n.alias("source_order"), F.col("l_orderkey").cast("int").alias("row_order"))
    last = rows.select("document_id").distinct().select("document_id", F.lit(70).alias("page_number"), F.lit("end").alias("content"), F.lit(0).alias("source_order"), F.lit(0).alias("row_order"))
    blocks = rows.unionByName(last).select("*", F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast(schemas.TABLE_REF).alias("table_ref"))
    return sections.without_listings(blocks).groupBy("document_id").agg(F.count("*").alias("n_blocks"), F.count_distinct("page_number").alias("n_pages"))


CONTENTS_DROPPED = r"""
WITH l AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS d, l_suppkey % 4 AS kind, l_linenumber AS page, CAST(l_quantity AS INT) AS q, l_orderkey AS o, l_linestatus AS m, l_returnflag AS r FROM lineitem),
b AS (SELECT d, page, q, o, CASE WHEN kind = 2 AND o % 3 > 0 THEN m WHEN kind = 3 AND o % 2 = 0 THEN m || ' ' || r
                                 ELSE page || '. ' || m || ' ' || CASE WHEN kind = 1 THEN 60 - q ELSE q END END AS line FROM l),
t AS (SELECT *, TRY_CAST(regexp_extract(line, '(^| )(\d{1,3})$', 2) AS INT) AS target, regexp_matches(line, '^\d+(\.\d+)*\. ') AS numbered FROM b),
w AS (SELECT *, coalesce(target < max(target) OVER (PARTITION BY d, page ORDER BY q, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS falls FROM t),
g AS (SELECT d, page FROM w GROUP BY d, page HAVING count(*) >= 5 AND count(target) >= 0.75 * count(*) AND count(DISTINCT target) >= 3 AND NOT bool_or(falls)
      AND page < max(target) AND max(target) <= 70 AND count_if(numbered) >= 0.6 * count(*)),
k AS (SELECT d, page FROM b ANTI JOIN g USING (d, page) UNION ALL SELECT DISTINCT d, 70 FROM b)
SELECT d AS document_id, count(*) AS n_blocks, count(DISTINCT page) AS n_pages FROM k GROUP BY d
"""


def page_sections(spark: SparkSession, d: str) -> DataFrame:
    out = sections.build_sections(_blocks(spark, d))
    return out.select("document_id", "block_no", "page_number", "is_heading", F.array_join("heading_path", " > ").alias("path"), F.md5("content").alias("content_md5"))


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    out = chunking.create_chunks(sections.build_sections(_blocks(spark, d)), 60, 10)
    return out.select("document_id", "chunk_index", "chunk_type", "token_count", "section_path", F.md5("content").alias("content_md5"))


def repeated_furniture(spark: SparkSession, d: str) -> DataFrame:
    """Sources as documents, their documents as pages, lines as blocks."""
    lines = table(spark, d, "documents").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return sections.repeated_furniture(lines, "source", "doc_id", "line", share=0.15)


REPEATED_FURNITURE = r"""
WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT source, doc_id, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS f FROM l),
p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM f GROUP BY source),
o AS (SELECT source, f, count(DISTINCT doc_id) AS n FROM f WHERE length(f) BETWEEN 1 AND 120 GROUP BY source, f)
SELECT source AS document, f AS furniture, n AS n_pages FROM o JOIN p USING (source) WHERE pages >= 3 AND n >= greatest(3, CAST(floor(0.15 * pages) AS INT))
"""


def shaped_citations(spark: SparkSession, d: str) -> DataFrame:
    """The first words of each benchmark item, widened in the documents that hold it."""
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    found = ground.find_passages(items, docs)
    rows = found.join(items.select("item_id", F.substring_index("text", " ", 3).alias("citation")), "item_id").join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    return rows.select("item_id", "doc_id", ground.widen_column(F.col("citation"), F.col("content")).alias("citation"))


def split_facts(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as items that share parts of a supplier as chunks."""
    f = table(spark, d, "lineitem")
    rows = f.select(F.col("l_suppkey").cast("string").alias("analysis_id"), F.col("l_returnflag").alias("category"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("int").alias("item_no"), (F.col("l_linestatus") == "F").alias("weak"), F.array(F.col("l_partkey").cast("string")).alias("chunk_ids"))
    out = ground.merge_split_facts(rows)
    return out.groupBy("analysis_id", "category").agg(F.count("*").alias("n_items"), F.count_distinct("group_no").alias("n_facts"))


SPLIT_FACTS = """
WITH i AS (SELECT l_suppkey AS a, l_returnflag AS c, l_orderkey * 10 + l_linenumber AS n, l_linestatus = 'F' AS w, l_partkey AS p FROM lineitem),
f AS (SELECT a, c, p, n AS first_n, w AS first_w FROM i QUALIFY row_number() OVER (PARTITION BY a, c, p ORDER BY n, w) = 1),
g AS (SELECT a, c, CASE WHEN first_w OR w THEN first_n ELSE n END AS g FROM i JOIN f USING (a, c, p))
SELECT CAST(a AS VARCHAR) AS analysis_id, c AS category, count(*) AS n_items, count(DISTINCT g) AS n_facts FROM g GROUP BY a, c
"""


def word_positions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages among the words of the documents that hold them."""
    items, docs = table(spark, d, "benchmark"), table(spark, d, "documents")
    found = ground.find_passages(items, docs)
    words = docs.join(found.select("doc_id").distinct(), "doc_id").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.posexplode(F.split("text", r"\s+")).alias("word_no", "text"))
    asked = found.join(items, "item_id").select(F.concat_ws("-", "item_id", "doc_id").alias("citation_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.col("text").alias("citation"))
    return geometry.word_hits(words, asked)


WORD_POSITIONS = rf"""
WITH b AS (SELECT item_id, {_FORM.format("text")} AS f, regexp_replace({_folded("text")}, '[^a-z0-9]', '', 'g') AS needle FROM benchmark),
t AS (SELECT doc_id, text, {_FORM.format("text")} AS f FROM documents),
g AS (SELECT item_id, doc_id, needle FROM b JOIN t ON contains(t.f, b.f) AND length(b.f) >= 12 WHERE needle <> ''),
w AS (SELECT doc_id, unnest(range(0, len(s))) AS word_no, unnest(s) AS word
      FROM (SELECT doc_id, regexp_split_to_array(text, '\s+') AS s FROM t WHERE doc_id IN (SELECT doc_id FROM g))),
l AS (SELECT doc_id, word_no, regexp_replace({_folded("word")}, '[^a-z0-9]', '', 'g') AS form FROM w),
p AS (SELECT *, length(form) AS n, coalesce(sum(length(form)) OVER (PARTITION BY doc_id ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
j AS (SELECT doc_id, string_agg(form, '' ORDER BY word_no) AS page FROM l GROUP BY doc_id),
h AS (SELECT item_id, doc_id, length(needle) AS size, unnest(list_filter(range(0, length(page) - length(needle) + 1), lambda i: substr(page, i + 1, length(needle)) = needle)) AS pos
      FROM g JOIN j USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY pos) - 1 AS occurrence FROM h)
SELECT item_id || '-' || doc_id AS citation_id, CAST(occurrence AS INT) AS occurrence, CAST(min(word_no) AS INT) AS first_word, CAST(max(word_no) AS INT) AS last_word
FROM o JOIN p USING (doc_id) WHERE n > 0 AND start < pos + size AND start + n > pos GROUP BY item_id, doc_id, occurrence
"""


def occurrence_groups(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user as rectangles in order of time; values are their places."""
    e = table(spark, d, "events").select(F.col("user_id").alias("citation_id"), F.col("event_id").alias("rect_no"), (F.col("value") % 50).alias("x"), (F.floor(F.col("value") / 50) * 14.0).alias("y"), F.lit(20.0).alias("width"), F.lit(10.0).alias("height"))
    out = geometry.group_occurrences(e)
    return out.groupBy("citation_id").agg(F.max("occurrence").cast("long").alias("last_occurrence"), F.count("*").alias("n"))


OCCURRENCE_GROUPS = """
WITH r AS (SELECT user_id, event_id, value % 50 AS x, floor(value / 50) * 14.0 AS y FROM events),
l AS (SELECT *, x - lag(x) OVER w - 20.0 AS gap, y - lag(y) OVER w AS step FROM r WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT user_id, CASE WHEN step IS NULL THEN 1 WHEN abs(step) <= 3.0 THEN CASE WHEN gap BETWEEN 0 AND 15.0 THEN 0 ELSE 1 END WHEN step > 0 AND step <= 18.0 THEN 0 ELSE 1 END AS fresh FROM l)
SELECT user_id AS citation_id, CAST(sum(fresh) - 1 AS BIGINT) AS last_occurrence, count(*) AS n FROM n GROUP BY user_id
"""


def answer_items(spark: SparkSession, d: str) -> DataFrame:
    """Answers made of event properties, fenced or wordy, back to items."""
    e = table(spark, d, "events")
    item = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("tipo"), F.col("user_id").cast("string").alias("valor"), (F.col("value") / 100).alias("confidence"), F.lit("odd").alias("extraction_status"))).alias("items")))
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), item, F.lit("\n```"))).when(F.col("event_id") % 7 == 0, F.lit("no answer")).otherwise(F.concat(F.lit("Here: "), item))
    out = extract.normalise_items(e.select("event_id", answer.alias("answer")), ["event_id"])
    return out.select("event_id", "tipo", "valor", F.round("confidence", 6).alias("confidence"), "extraction_status")


ANSWER_ITEMS = """SELECT event_id, event_type AS tipo, CAST(user_id AS VARCHAR) AS valor, CASE WHEN value / 100 BETWEEN 0 AND 1 THEN round(value / 100, 6) END AS confidence, 'not_found' AS extraction_status
FROM events WHERE (event_id % 3 = 0 OR event_id % 7 <> 0)"""


def narrative_sources(spark: SparkSession, d: str) -> DataFrame:
    """Turns as statements on the items (other turns) before them."""
    c = table(spark, d, "conversations")
    ref = F.struct(F.col("conv_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.substring("text", 1, 100).alias("citation"), F.lit(None).cast("string").alias("block_id"), F.lit(None).cast("string").alias("chunk_id"))
    items = c.select(F.col("conv_id").cast("string").alias("category"), F.col("turn").cast("int").alias("item_no"), F.array(ref).alias("source_references"))
    elements = c.where("turn > 0").select(F.col("conv_id").cast("string").alias("category"), F.lit(0).alias("block_no"), F.col("turn").cast("int").alias("element_no"), "text", F.array((F.col("turn") - 1).cast("int"), F.lit(999)).alias("item_refs"))
    evidence = c.where("turn > 0").select(F.col("conv_id").cast("string").alias("category"), F.col("turn").cast("int").alias("evidence_no"), F.substring("text", 1, 40).alias("text"), F.array((F.col("turn") - 1).cast("int")).alias("item_refs"))
    out, _ = narrative.resolve(elements, evidence, items)
    return out.select("category", "element_no", F.array_join("source_ids", ",").alias("source_ids"))


QUERIES = {
    "html_blocks": (html_blocks, HTML_BLOCKS),
    "page_sections": (page_sections, None),
    "section_chunks": (section_chunks, None),
    "repeated_furniture": (repeated_furniture, REPEATED_FURNITURE),
    "contents_dropped": (contents_dropped, CONTENTS_DROPPED),
    "shaped_citations": (shaped_citations, None),
    "split_facts": (split_facts, SPLIT_FACTS),
    "word_positions": (word_positions, WORD_POSITIONS),
    "occurrence_groups": (occurrence_groups, OCCURRENCE_GROUPS),
    "answer_items": (answer_items, ANSWER_ITEMS),
    "narrative_sources": (narrative_sources, None),
}
