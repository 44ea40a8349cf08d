"""One query per step that has no table of its own: the tables stand in for its inputs.

The SQL says what the step is to give, from the same rows, in its own way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import catalog, chunking, classify, consolidate, extract, geometry, ground, layout, narrative, retrieve, tracking
from folioforge.plans import jobs
from folioforge.sources import store

from .common import table

_null = lambda kind: F.lit(None).cast(kind)


# layout ---------------------------------------------------------------------


def markdown_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a heading, its paragraphs, a page break, a table and a last line."""
    md = F.concat(F.lit("## "), F.col("source"), F.lit("\n\n"), F.regexp_replace("text", "\n", "\n\n"), F.lit("\n<!-- PageBreak -->\n<table>\n<tr><td>x</td></tr>\n</table>\n<figure>\nno text\n</figure>\n"), F.col("lang"))
    out = layout.parse_markdown(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), md.alias("markdown")))
    return out.select("document_id", "source_order", "page_number", "block_type", "heading_level", F.md5(F.coalesce("content", F.lit("-"))).alias("content_md5"))


MARKDOWN_BLOCKS = r"""
WITH l AS (SELECT doc_id, i, trim(string_split(text, chr(10))[i]) AS c FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
b AS (SELECT doc_id, 0 AS i, 1 AS page, 'paragraph' AS kind, 2 AS level, source AS c FROM documents
      UNION ALL SELECT doc_id, i, 1, 'paragraph', NULL, c FROM l WHERE c <> ''
      UNION ALL SELECT doc_id, 1000000, 2, 'table', NULL, NULL FROM documents
      UNION ALL SELECT doc_id, 1000001, 2, 'paragraph', NULL, lang FROM documents)
SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS source_order, page AS page_number, kind AS block_type, level AS heading_level, md5(coalesce(c, '-')) AS content_md5 FROM b
"""


def hyphens_joined(spark: SparkSession, d: str) -> DataFrame:
    """Every third space becomes a hyphen at a line end."""
    t = F.regexp_replace("text", r"(\S+) (\S+) (\S+) ", "$1 $2 $3-\n")
    return table(spark, d, "documents").select("doc_id", F.md5(T.dehyphenate(t)).alias("joined_md5"), (T.dehyphenate(t) != t).alias("changed"))


HYPHENS_JOINED = r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '(\S+) (\S+) (\S+) ', '\1 \2 \3-' || chr(10), 'g') AS t FROM documents),
j AS (SELECT doc_id, t, regexp_replace(regexp_replace(t, '(\p{L})-\n(\p{L})', '\1\2', 'g'), '(\p{L})-\n(\p{L})', '\1\2', 'g') AS j FROM t)
SELECT doc_id, md5(j) AS joined_md5, j <> t AS changed FROM j
"""


def polygon_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Prices as corners, flags as units."""
    f = table(spark, d, "lineitem")
    unit = F.when(F.col("l_returnflag") == "A", " Inch").when(F.col("l_returnflag") == "N", "pt").otherwise("pixel")
    q, t = F.col("l_quantity"), F.col("l_tax") * 100
    box = layout.bounding_box(F.array(q, t, q + 5, t - 1, q + 2, t + 7), layout.unit_scale(unit), F.col("l_linenumber"))
    return f.select("l_orderkey", "l_linenumber", box.alias("b")).where("b is not null").select("l_orderkey", "l_linenumber", "b.page", *[F.round(f"b.{c}", 4).alias(c) for c in ("x", "y", "width", "height")])


POLYGON_BOXES = """SELECT l_orderkey, l_linenumber, l_linenumber AS page, round(l_quantity * s, 4) AS x, round((l_tax * 100 - 1) * s, 4) AS y, CAST(5.0 * s AS DOUBLE) AS width, CAST(8.0 * s AS DOUBLE) AS height
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 72.0 WHEN 'N' THEN 1.0 END AS s FROM lineitem) WHERE s IS NOT NULL"""


def attached_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as lines of a page (their order), two boxes per order."""
    f = table(spark, d, "lineitem")
    box = lambda x, y: F.struct(F.col("l_orderkey").cast("int").alias("page"), x.alias("x"), y.alias("y"), F.lit(10.0).alias("width"), F.lit(4.0).alias("height"))
    lines = f.select(F.col("l_suppkey").alias("document_id"), F.col("l_orderkey").cast("int").alias("page_number"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("content"), box(F.col("l_quantity"), F.col("l_discount") * 100).alias("box"))
    pages = f.select("l_suppkey", "l_orderkey").distinct()
    boxes = F.array(*[F.struct(F.col("l_orderkey").cast("int").alias("page"), F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(20.0).alias("width"), F.lit(6.0).alias("height")) for x in (0.0, 30.0)])
    blocks = pages.select(F.col("l_suppkey").alias("document_id"), F.col("l_orderkey").alias("block_no"), boxes.alias("bbox"))
    out = layout.attach_lines(blocks, lines)
    return out.select("document_id", "block_no", F.array_join(F.transform("lines", lambda x: x["t"]), ",").alias("texts"))


ATTACHED_LINES = """
WITH l AS (SELECT l_suppkey AS s, l_orderkey AS o, l_quantity AS x, l_discount * 100 AS y, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS t FROM lineitem),
p AS (SELECT DISTINCT s, o FROM l),
h AS (SELECT DISTINCT s, o, x, y, t FROM l WHERE (x + 5 BETWEEN -2 AND 22 OR x + 5 BETWEEN 28 AND 52) AND y + 2 BETWEEN -2 AND 8)
SELECT s AS document_id, o AS block_no, string_agg(t, ',' ORDER BY round_even(y, 1), x, y, t) AS texts FROM p LEFT JOIN h USING (s, o) GROUP BY s, o
"""


#: Order lines that a task makes cells of.
LINES = 250_000


def table_lines(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tables of three columns, of which two have a header; no flag, no cell."""
    # orders are dealt before their lines become cells, so cells, rows and tables are made without another shuffle
    # a line is narrow where it is dealt and five sorted cells behind, so Spark would make the partitions too large
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), f.count() // LINES)
    f = f.repartition(n, "l_orderkey")
    row = F.col("l_linenumber")
    cell = lambda i, kind, c, r=row: F.struct(r.alias("row_index"), F.lit(i).alias("column_index"), F.lit(kind).cast("string").alias("kind"), c.alias("content"))
    body = (cell(0, "content", F.col("l_partkey").cast("string")), cell(1, None, F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise(" ")), cell(2, None, F.col("l_linestatus")))
    heads = (cell(0, "columnHeader", F.lit("Part"), F.lit(0)), cell(1, "column_header", F.lit("Flag "), F.lit(0)))
    cells = f.select(F.col("l_orderkey").alias("document_id"), F.lit("t").alias("table_id"), F.explode(F.array(*body, *heads)).alias("c")).select("document_id", "table_id", "c.*")
    one = cells.groupBy("document_id", "table_id", "row_index", "column_index").agg(F.min("content").alias("content"), F.min("kind").alias("kind"))
    return layout.table_rows(one).select("document_id", "row_index", "content", F.array_join("table_ref.headers", "|").alias("headers"))


TABLE_LINES = """
WITH c AS (SELECT l_orderkey AS o, l_linenumber AS r, min(CAST(l_partkey AS VARCHAR)) AS p, min(CASE WHEN l_returnflag <> 'N' THEN l_returnflag ELSE ' ' END) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY ALL)
SELECT o AS document_id, r + 1 AS row_index, 'Part: ' || p || CASE WHEN trim(f) <> '' THEN chr(10) || 'Flag: ' || f ELSE '' END || chr(10) || 'col_3: ' || s AS content,
       'Part' || CASE WHEN trim(f) <> '' THEN '|Flag' ELSE '' END || '|col_3' AS headers FROM c
"""


def placed_tables(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents; the first two of three tables have a place in the text."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"))
    kinds = F.array(*[F.struct(F.lit(i).alias("source_order"), F.lit(1 + i // 3).alias("page_number"), F.lit("table" if i in (1, 3) else "paragraph").alias("block_type"), F.lit(None if i in (1, 3) else f"p{i}").cast("string").alias("content")) for i in range(5)])
    blocks = o.select("document_id", F.explode(kinds).alias("b")).select("document_id", "b.*")
    tables = o.select("document_id", F.posexplode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("table_no", "table_id")).withColumn("page_number", F.lit(9))
    ref = F.struct("table_id", F.lit(1).alias("row_index"), F.array(F.lit("h")).alias("headers"))
    rows = tables.select("document_id", "table_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("row_index")).withColumn("content", F.concat_ws(":", "table_id", "row_index")).withColumn("table_ref", ref)
    out = layout.place_tables(blocks, rows, tables)
    return out.select("document_id", "page_number", "block_type", "content", "source_order", "row_order")


PLACED_TABLES = """
WITH b(page_number, block_type, content, source_order, row_order) AS (VALUES (1, 'paragraph', 'p0', 0, 0), (1, 'table', 'a:1', 1, 1), (1, 'table', 'a:2', 1, 2), (1, 'paragraph', 'p2', 2, 0),
  (2, 'table', 'b:1', 3, 1), (2, 'table', 'b:2', 3, 2), (2, 'paragraph', 'p4', 4, 0), (9, 'table', 'c:1', 10002000, 1), (9, 'table', 'c:2', 10002000, 2))
SELECT o_orderkey AS document_id, b.* FROM orders, b
"""


def matched_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Numbered lines of the documents, found again behind a line that no block has."""
    lines = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("n", "line"))
    text = F.concat_ws(" ", F.lpad(F.col("n").cast("string"), 6, "0"), "document_id", F.trim("line"))
    blocks = lines.select("document_id", F.lit(1).alias("page_number"), F.col("n").alias("block_no"), F.lit("paragraph").alias("block_type"), F.regexp_replace(text, " ", "  ").alias("content"))
    extra = lines.select("document_id").distinct().select("document_id", F.lit(1).alias("page_number"), F.lit(0).alias("span_offset"), F.lit("-").alias("content"))
    found = lines.select("document_id", F.lit(1).alias("page_number"), (F.col("n") + 1).alias("span_offset"), text.alias("content"))
    return layout.match_paragraphs(blocks, found.unionByName(extra)).select("document_id", "block_no", F.col("para_id.page").alias("page"), F.col("para_id.idx").alias("idx"))


MATCHED_PARAGRAPHS = """SELECT CAST(doc_id AS VARCHAR) AS document_id, n AS block_no, 1 AS page, n + 1 AS idx
FROM (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents)"""


def boxes_on_sheet(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem")
    box = lambda x: F.struct(F.lit(1).alias("page"), x.alias("x"), F.col("l_tax").alias("y"), (F.col("l_quantity") - 10).alias("width"), F.lit(5.0).alias("height"))
    kept = layout.valid_boxes(F.array(box(F.col("l_discount") * 100 - 3), box(F.col("l_quantity"))), F.lit(60.0), F.lit(40.0))
    return f.select("l_orderkey", "l_linenumber", "l_partkey", F.size(kept).alias("n"))


BOXES_ON_SHEET = """SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity - 10 > 0 AND l_discount * 100 - 3 >= -1 AND l_discount * 100 - 3 + l_quantity - 10 <= 61 AS INT) + CAST(l_quantity - 10 > 0 AND 2 * l_quantity - 10 <= 61 AS INT) AS n FROM lineitem"""


# facts ----------------------------------------------------------------------

#: Phrases and the type that each is expected to have, by category.
PHRASES = {
    "plazos_clave": (("Respuesta a CONSULTAS", "respuesta_consultas"), ("consultas", "consultas"), ("Visita a la obra", "visita_lugar"), ("Firma del contrato", "firma_contrato"), ("Entrega", "plazo_ejecucion"), ("sin más", "otro"), ("", "otro")),
    "garantias": (("Garantía de cumplimiento del contrato", "cumplimiento_contrato"), ("anticipo", "anticipo"), ("Caución de oferta", "mantenimiento_oferta"), ("x", "otra")),
    "identificacion": (("EXPEDIENTE nº", "expediente"), ("tipo de procedimiento", "tipo_procedimiento"), ("procedimiento", "numero_procedimiento"), ("jurisdiccion", "jurisdiccion"), ("zzz", None)),
    "causales_rechazo": (("Requisito formal", "formal"), ("muestra", "tecnica"), ("Precio vil", "economica"), ("inhabilitado", "legal"), ("corrupción", "etica"), ("nada", "otra")),
    "riesgos": (("multa", "economico"), ("demora", "plazos"), ("rescisión", "legal_contractual"), ("logística", "operativo"), ("¿?", "otro_explicito")),
}
_CASES = [(c, p, want) for c, ps in PHRASES.items() for p, want in ps]


def canonical_types(spark: SparkSession, d: str) -> DataFrame:
    cases = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(p).alias("tipo")) for c, p, _ in _CASES])
    e = table(spark, d, "events").select("event_id", F.get(cases, F.pmod("event_id", F.lit(len(_CASES))).cast("int")).alias("c")).select("event_id", "c.*")
    return e.select("event_id", "category", jobs.canonical(F.col("category"), F.col("tipo")).alias("tipo"))


_quoted = lambda x: "NULL" if x is None else f"'{x}'"
CANONICAL_TYPES = f"WITH c(no, category, tipo) AS (VALUES {', '.join(f'({no}, {_quoted(c)}, {_quoted(w)})' for no, (c, _, w) in enumerate(_CASES))}) SELECT event_id, category, tipo FROM events JOIN c ON no = event_id % {len(_CASES)}"


def broken_rules(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem")
    items = f.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") * 3).alias("monto_porcentaje"), F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).alias("monto_valor"), (F.col("l_discount") * 11).alias("confidence"), F.when(F.col("l_linestatus") == "O", F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("mayo").alias("fecha"), F.when(F.col("l_linenumber") > 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("source_references"))
    return consolidate.validate(items, consolidate.amount_rules()).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("broken", ",").alias("broken"))


BROKEN_RULES = """SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN l_quantity * 3 > 100 THEN 'percent_range' END, CASE WHEN l_returnflag = 'A' THEN 'percent_or_amount' END,
  CASE WHEN l_discount * 11 > 1 THEN 'confidence_range' END, CASE WHEN l_linestatus <> 'O' THEN 'date_shape' END, CASE WHEN l_linenumber <= 1 THEN 'has_source' END) AS broken FROM lineitem"""


def foreign_terms(spark: SparkSession, d: str) -> DataFrame:
    """Part names with words that belong to other categories (brands' first digits)."""
    p = table(spark, d, "part")
    items = p.select(F.lit("a").alias("analysis_id"), F.when(F.col("p_size") % 2 == 0, "even").otherwise("odd").alias("category"), F.col("p_partkey").alias("item_no"), F.col("p_type").alias("tipo"), F.col("p_name").alias("valor"))
    terms = spark.createDataFrame([(0, "even", 0, "Cold"), (0, "even", 1, "economy"), (1, "odd", 0, "small"), (1, "odd", 1, "widget")], "category_no int, category string, term_no int, term string")
    return consolidate.contamination(items, terms).select("item_no", F.col("foreign_term.category").alias("other"), F.col("foreign_term.term").alias("term"))


FOREIGN_TERMS = """
WITH p AS (SELECT p_partkey AS item_no, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS c, lower(p_type || ' ' || p_name) AS t FROM part)
SELECT item_no, CASE WHEN c = 'odd' AND (contains(t, 'cold') OR contains(t, 'economy')) THEN 'even' WHEN c = 'even' AND (contains(t, 'small') OR contains(t, 'widget')) THEN 'odd' END AS other,
  CASE WHEN c = 'odd' THEN CASE WHEN contains(t, 'cold') THEN 'Cold' WHEN contains(t, 'economy') THEN 'economy' END ELSE CASE WHEN contains(t, 'small') THEN 'small' WHEN contains(t, 'widget') THEN 'widget' END END AS term FROM p
"""


def citation_origins(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    final = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.substring("text", 1, 30))
    weak = ground.weak_identity(F.when(F.col("turn") % 5 == 0, " Otro ").otherwise(F.col("role")), F.when(F.col("turn") % 3 == 0, "partial").otherwise("success"), F.when(F.col("turn") % 2 == 0, 0.6).otherwise(0.7))
    return c.select("conv_id", "turn", ground.citation_origin(F.col("text"), final, F.col("turn") % 7 == 3).alias("origin"), weak.alias("weak"))


CITATION_ORIGINS = """SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN 'rescatada' WHEN turn % 2 = 1 AND length(text) > 30 THEN 'ensanchada' ELSE 'llm' END AS origin,
  turn % 5 = 0 OR (turn % 3 = 0 AND turn % 2 = 0) AS weak FROM conversations"""


def block_identity(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as blocks of one chunk; a reference cites a turn's first words."""
    c = table(spark, d, "conversations")
    blocks = c.groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["turn"].alias("block_id"), x["text"].alias("content"))).alias("blocks"))
    refs = c.select(F.col("conv_id").alias("chunk_id"), "turn", F.substring("text", 1, 25).alias("citation"))
    return ground.attach_identity(refs, blocks).select("chunk_id", "turn", "block_id")


BLOCK_IDENTITY = r"""
WITH f AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t, trim(regexp_replace(lower(left(text, 25)), '\s+', ' ', 'g')) AS c FROM conversations)
SELECT a.conv_id AS chunk_id, a.turn, min(b.turn) AS block_id FROM f a LEFT JOIN f b ON a.conv_id = b.conv_id AND contains(b.t, a.c) GROUP BY a.conv_id, a.turn, a.c
"""


def deduped_references(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as references: page = line status, citation = flag and supplier's last digit."""
    f = table(spark, d, "lineitem")
    ref = F.struct(F.col("l_orderkey").cast("string").alias("document_id"), F.when(F.col("l_linestatus") == "O", 1).alias("page_number"), F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.lit("É ")).otherwise(F.lit("e  ")), F.col("l_returnflag")).alias("citation"), F.col("l_linenumber").cast("string").alias("block_id"), F.col("l_partkey").cast("string").alias("chunk_id"))
    lists = f.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", ref.alias("r")))), lambda x: x["r"]).alias("refs"))
    out = lists.select("l_orderkey", consolidate.dedupe_references(F.col("refs")).alias("r"))
    return out.select("l_orderkey", F.array_join(F.transform("r", lambda x: F.concat_ws("/", x["block_id"], x["chunk_id"])), ",").alias("kept"))


DEDUPED_REFERENCES = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linestatus, l_returnflag ORDER BY l_linenumber, l_partkey) AS n FROM lineitem)
SELECT l_orderkey, string_agg(l_linenumber || '/' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS kept FROM r WHERE n = 1 GROUP BY l_orderkey
"""


def fact_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    kind = F.col("l_linenumber") % 3
    rows = f.select("l_orderkey", "l_linenumber", "l_partkey", F.when(kind == 0, "plazos_clave").when(kind == 1, "garantias").otherwise("riesgos").alias("category"), F.when(F.col("l_returnflag") == "A", day).otherwise("").alias("fecha"), F.when(F.col("l_returnflag") == "N", F.lit("Día  5 (hábil)")).alias("expresion_relativa"), F.lit("Textó").alias("texto_original"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).alias("monto_porcentaje"), F.lit(None).cast("double").alias("monto_valor"), F.concat(F.lit(" A  "), F.col("l_linestatus")).alias("valor"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", jobs.fingerprint(F.col("category")).alias("fingerprint"))


FACT_FINGERPRINTS = """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3
  WHEN 0 THEN CASE l_returnflag WHEN 'A' THEN strftime(l_shipdate, '%Y-%m-%d') WHEN 'N' THEN 'dia 5' ELSE 'texto' END
  WHEN 1 THEN CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS VARCHAR) ELSE 'None' END || '|None' ELSE 'a ' || lower(l_linestatus) END AS fingerprint FROM lineitem"""


def enforced_citations(spark: SparkSession, d: str) -> DataFrame:
    """Items with one citation of as many letters as the quantity says."""
    f = table(spark, d, "lineitem")
    refs = F.array(F.struct(F.repeat(F.lit("x"), (F.col("l_quantity") * F.when(F.col("l_returnflag") == "A", 5).otherwise(1)).cast("int")).alias("citation")))
    rows = f.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linestatus") == "O", "success").otherwise("partial").alias("extraction_status"), refs.alias("source_references"))
    return consolidate.enforce_citations(rows).select("l_orderkey", "l_linenumber", "l_partkey", "extraction_status", "penalised")


ENFORCED_CITATIONS = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' THEN 'success' ELSE 'partial' END AS extraction_status, false AS penalised
FROM lineitem WHERE l_quantity * CASE WHEN l_returnflag = 'A' THEN 5 ELSE 1 END BETWEEN 12 AND 120"""


def published_items(spark: SparkSession, d: str) -> DataFrame:
    """Parts of an order as facts with a date; the merge node's whole order of steps."""
    f = table(spark, d, "lineitem")
    ref = F.struct(F.col("l_suppkey").cast("string").alias("document_id"), F.col("l_linenumber").alias("page_number"), F.when(F.col("l_discount") > 0.02, "a citation that is long enough").otherwise("short").alias("citation"), _null("string").alias("block_id"), _null("string").alias("chunk_id"))
    rows = f.select(F.col("l_orderkey").cast("string").alias("analysis_id"), F.lit("plazos_clave").alias("category"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("item_no"), F.when(F.col("l_returnflag") == "A", "Apertura").otherwise("Visita a obra").alias("tipo"), *[_null("string").alias(c) for c in ("valor", "hora", "expresion_relativa", "texto_original", "lugar", "moneda")], *[_null("double").alias(c) for c in ("monto_porcentaje", "monto_valor")], F.date_format("l_shipdate", "yyyy-01-01").alias("fecha"), F.lit(0.5).alias("confidence"), F.lit("success").alias("extraction_status"), F.array(ref).alias("source_references"))
    good, _, _, _ = jobs.publish(rows)
    return good.select("analysis_id", "tipo", "fecha", "n_merged", "extraction_status", "confidence", F.size("source_references").alias("n_references"))


PUBLISHED_ITEMS = """
WITH r AS (SELECT l_orderkey AS a, CASE WHEN l_returnflag = 'A' THEN 'apertura_ofertas' ELSE 'visita_lugar' END AS t, strftime(l_shipdate, '%Y-01-01') AS f, l_discount > 0.02 AS ok, l_suppkey AS s, l_linenumber AS p FROM lineitem),
m AS (SELECT a, t, f, count(*) AS n, bool_or(ok) AS cited, count(DISTINCT (s, p, ok)) AS refs, count(DISTINCT (s, p)) FILTER (ok) AS usable FROM r GROUP BY a, t, f)
SELECT CAST(a AS VARCHAR) AS analysis_id, t AS tipo, f AS fecha, n AS n_merged, 'success' AS extraction_status, CAST(CASE WHEN refs = 1 THEN 0.7 ELSE 0.8 END AS DOUBLE) AS confidence, usable AS n_references FROM m WHERE cited
"""


def document_labels(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("analysis_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("filename"), (F.col("o_orderstatus") == "P").alias("is_primary"))
    return jobs.document_labels(o)


DOCUMENT_LABELS = """SELECT o_custkey AS analysis_id, o_orderkey AS document_id, o_orderpriority AS name, o_orderstatus = 'P' AS is_primary, count_if(o_orderstatus = 'P') OVER (PARTITION BY o_custkey) = 1 AS one_primary FROM orders"""


def confidence_avg(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), (F.col("value") / 200).alias("confidence"))
    return jobs.confidence_avg(e, "user_id")


CONFIDENCE_AVG = "SELECT user_id, round(avg(value / 200) FILTER (event_type <> 'error'), 3) AS confidence_avg FROM events GROUP BY user_id"


def mixed_not_found(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "view", "success").otherwise("not_found").alias("extraction_status"), F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.col("props")).alias("valor"))
    return consolidate.mixed_not_found(e, ["user_id"], extract.substantive(e)).select("event_id", "extraction_status")


MIXED_NOT_FOUND = """
WITH e AS (SELECT event_id, event_type = 'view' AS ok, bool_or(event_type = 'view') OVER (PARTITION BY user_id) AS found, event_id % 3 <> 0 AS filled FROM events)
SELECT event_id, CASE WHEN ok THEN 'success' WHEN found THEN 'partial' ELSE 'not_found' END AS extraction_status FROM e WHERE ok OR NOT found OR filled
"""


def stated_facts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as pages that state a file number; a customer is an analysis."""
    text = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("El  presente EXPEDIENTE: EX-"), F.col("o_orderkey").cast("string"), F.lit("/24 rige el llamado"))).otherwise(F.lit("Expediente: sin numero"))
    c = table(spark, d, "orders").select(F.col("o_custkey").alias("analysis_id"), F.lit("d").alias("document_id"), F.col("o_orderkey").alias("page_number"), F.lit(0).alias("chunk_index"), text.alias("content"))
    return extract.rule_facts(c).select("analysis_id", "tipo", "valor", "page_number", "confidence")


STATED_FACTS = """SELECT o_custkey AS analysis_id, 'expediente' AS tipo, 'EX-' || min(o_orderkey) || '/24' AS valor, min(o_orderkey) AS page_number, CAST(0.78 AS DOUBLE) AS confidence FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey"""


def number_forms(spark: SparkSession, d: str) -> DataFrame:
    """Prices written in three ways, and page numbers in words."""
    o = table(spark, d, "orders")
    whole = F.floor("o_totalprice").cast("string")
    written = F.when(F.col("o_orderkey") % 3 == 0, F.regexp_replace(whole, r"(\d)(?=(\d{3})+$)", "$1.")).when(F.col("o_orderkey") % 3 == 1, F.concat(whole, F.lit(",50"))).otherwise(F.concat(F.lit("$ "), whole))
    return o.select("o_orderkey", T.canonical_number(written).alias("number"), T.page_number(F.concat(F.lit("pág. "), F.col("o_orderkey").cast("string"), F.lit(" y 7"))).alias("page"))


NUMBER_FORMS = """SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) || CASE WHEN o_orderkey % 3 = 1 THEN '5' ELSE '' END AS number, CAST(o_orderkey AS INT) AS page FROM orders"""


# narratives -----------------------------------------------------------------


def contained_sources(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of turns: a turn, then its first half, then another text."""
    c = table(spark, d, "conversations")
    part = F.array(F.col("text"), F.substring("text", 3, 20), F.concat(F.lit("§"), F.col("text")))
    rows = c.select(F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("page_number"), F.posexplode(part).alias("source_id", "citation"))
    return narrative.contained_once(rows)


CONTAINED_SOURCES = """SELECT CAST(conv_id AS VARCHAR) AS document_id, CAST(turn AS INT) AS page_number, s AS source_id, 0 AS kept_id FROM (SELECT conv_id, turn, unnest([0, 1, 2]) AS s FROM conversations)"""


def conflict_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("tipo")).agg(F.collect_set(F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority"))).alias("v"), F.max((F.col("o_orderpriority") == "1-URGENT").cast("int")).alias("u"))
    rows = rows.select("o_custkey", "tipo", F.when(F.col("u") == 1, F.array_append("v", _null("string"))).otherwise(F.col("v")).alias("values"))
    return narrative.conflict_text(rows, "o_custkey")


CONFLICT_TEXTS = """
WITH v AS (SELECT DISTINCT o_custkey, o_orderstatus AS t, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS p FROM orders),
l AS (SELECT o_custkey, '- ' || t || ': ' || string_agg(coalesce(p, '∅'), ' / ' ORDER BY p NULLS LAST) AS line FROM v GROUP BY o_custkey, t)
SELECT o_custkey, string_agg(line, chr(10) ORDER BY line) AS conflict_text FROM l GROUP BY o_custkey
"""


def fallback_texts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("item_no"), F.concat(F.lit("tipo_"), F.col("o_orderstatus")).alias("tipo"), F.col("o_orderpriority").alias("valor"), F.when(F.col("o_orderstatus") == "P", "not_found").otherwise("success").alias("extraction_status"))
    return narrative.fallback(o, "o_custkey")


FALLBACK_TEXTS = """
WITH l AS (SELECT o_custkey, count(*) AS n, string_agg('tipo ' || o_orderstatus || ': ' || o_orderpriority, chr(10) || '- ' ORDER BY o_orderkey) AS t FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN n > 1 THEN '- ' || t ELSE t END AS text, CASE WHEN n > 1 THEN 'bullet_list' ELSE 'paragraph' END AS kind FROM l
"""


# geometry -------------------------------------------------------------------


def merged_lines(spark: SparkSession, d: str) -> DataFrame:
    """Words of ten by ten on lines twenty apart: every line is one rectangle."""
    f = table(spark, d, "lineitem")
    rects = f.select("l_orderkey", F.col("l_partkey").cast("double").alias("x"), (F.col("l_linenumber") * 20.0).alias("y"), F.lit(10.0).alias("width"), F.lit(10.0).alias("height"))
    out = geometry.regions(rects, ["l_orderkey"])
    return out.select("l_orderkey", F.explode("regions").alias("r")).select("l_orderkey", "r.*")


MERGED_LINES = "SELECT l_orderkey, CAST(min(l_partkey) AS DOUBLE) AS x, l_linenumber * 20.0::DOUBLE AS y, CAST(max(l_partkey) + 10 - min(l_partkey) AS DOUBLE) AS width, 10.0::DOUBLE AS height FROM lineitem GROUP BY l_orderkey, l_linenumber"


def chosen_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences one below the other, two headings, of which one fits the hint."""
    f = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("citation_id"), F.col("o_custkey").cast("string").alias("document_id"))
    rects = f.select("citation_id", F.posexplode(F.array(*[F.lit(float(y)) for y in (10, 110, 210)])).alias("occurrence", "y")).withColumns({"rect_no": F.lit(0), "x": F.lit(5.0)})
    heads = f.select("document_id").distinct().select("document_id", F.lit(1).alias("page_number"), F.explode(F.array(F.struct(F.lit("Artículo Garantías").alias("text"), F.lit(0.0).alias("x"), F.lit(100.0).alias("y")), F.struct(F.lit("Plazos").alias("text"), F.lit(0.0).alias("x"), F.lit(200.0).alias("y")))).alias("h")).select("document_id", "page_number", "h.*")
    hint = F.when(F.col("citation_id") % 3 == 0, "Pliego > garantias").when(F.col("citation_id") % 3 == 1, "PLAZOS").otherwise("artículo")
    return geometry.pick_occurrences(rects, heads, f.select("citation_id", "document_id", F.lit(1).alias("page_number"), hint.alias("section_hint")))


CHOSEN_OCCURRENCES = "SELECT CAST(o_orderkey AS VARCHAR) AS citation_id, CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS occurrence FROM orders"


def region_sources(spark: SparkSession, d: str) -> DataFrame:
    """What a page's own text, read lines and neither give; and the share with regions."""
    e = table(spark, d, "events")
    box = F.array(F.struct(*[F.col("value").alias(c) for c in ("x", "y", "width", "height")]))
    src = geometry.source_of_regions(F.when(F.col("event_id") % 4 == 0, box), F.when(F.col("event_id") % 3 == 0, box), F.col("event_id") % 5 == 0)
    rows = e.select("user_id", src.alias("s")).select("user_id", "s.*")
    n = rows.groupBy("user_id").agg(*[F.count_if(F.col("method") == m).alias(f"n_{m}") for m in ("text", "ocr", "none")], F.count_if(F.col("reason") == "not_found").alias("n_not_found"))
    return n.join(geometry.coverage(rows, "user_id"), "user_id")


REGION_SOURCES = """
WITH s AS (SELECT user_id, event_id % 4 = 0 AS live, event_id % 4 <> 0 AND event_id % 5 <> 0 AND event_id % 3 = 0 AS ocr, event_id % 4 <> 0 AND event_id % 5 = 0 AS missing FROM events)
SELECT user_id, count_if(live) AS n_text, count_if(ocr) AS n_ocr, count_if(NOT live AND NOT ocr) AS n_none, count_if(missing) AS n_not_found, round(100.0 * count_if(live OR ocr) / count(*), 1) AS coverage FROM s GROUP BY user_id
"""


def combined_regions(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").select("l_suppkey", *[F.col(c).cast("double").alias(n) for n, c in (("x", "l_linenumber"), ("y", "l_tax"), ("width", "l_discount"), ("height", "l_linenumber"))])
    return geometry.combine_regions(f, ["l_suppkey"], 2.0)


COMBINED_REGIONS = "SELECT DISTINCT l_suppkey, l_linenumber * 2.0::DOUBLE AS x, l_tax * 2.0 AS y, l_discount * 2.0 AS width, l_linenumber * 2.0::DOUBLE AS height FROM lineitem"


def fragments(spark: SparkSession, d: str) -> DataFrame:
    """Is a word of the document (or half of one) a fragment of its text?"""
    word = F.element_at(F.split("text", " "), 2)
    asked = F.when(F.col("doc_id") % 2 == 0, word).otherwise(F.left(word, F.length(word) - 1))
    docs = table(spark, d, "documents").where("size(split(text, ' ')) >= 2").withColumn("asked", F.regexp_replace(asked, r"[^\p{L}]", ""))
    return docs.select("doc_id", geometry.is_fragment(F.col("asked"), F.col("text"), ("that",)).alias("is_fragment"))


FRAGMENTS = r"""
WITH w AS (SELECT doc_id, text, string_split(text, ' ')[2] AS w FROM documents WHERE len(string_split(text, ' ')) >= 2),
a AS (SELECT doc_id, lower(text) AS t, lower(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN w ELSE left(w, length(w) - 1) END, '[^\p{L}]', '', 'g')) AS a FROM w)
SELECT doc_id, length(a) >= 4 AND a <> 'that' AND regexp_matches(' ' || t || ' ', '[^\p{L}\p{N}]' || a || '[^\p{L}\p{N}]') AS is_fragment FROM a
"""


def covered_lines(spark: SparkSession, d: str) -> DataFrame:
    """Turns as read lines; what the first of them says covers that line alone."""
    c = table(spark, d, "conversations")
    lines = c.select(F.col("conv_id").alias("citation_id"), F.col("turn").alias("line_no"), F.lit(10.0).alias("x"), (F.col("turn") * 12.0).alias("y"), F.lit(100.0).alias("width"), F.lit(10.0).alias("height"), F.col("text").alias("t"))
    asked = c.where("turn = 0").select(F.col("conv_id").alias("citation_id"), F.col("text").alias("citation"))
    return geometry.line_regions(lines, asked)


COVERED_LINES = "SELECT conv_id AS citation_id, 0 AS line_no, 10.0::DOUBLE AS x, 0.0::DOUBLE AS y, 100.0::DOUBLE AS width, 10.0::DOUBLE AS height FROM conversations WHERE turn = 0"


# index and lists ------------------------------------------------------------


def index_rows(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as chunks of a supplier: ids, parents, defaults, decoded JSON."""
    f = table(spark, d, "lineitem")
    ref = F.when(F.col("l_returnflag") == "A", '{"table_id":"t","row_index":3,"headers":["a","b"]}').when(F.col("l_returnflag") == "N", "{broken")
    rows = f.select(F.col("l_suppkey").cast("string").alias("document_id"), F.col("l_orderkey").alias("chunk_index"), F.when(F.col("l_linenumber") > 2, F.col("l_partkey")).alias("parent_chunk_index"), F.when(F.col("l_linestatus") == "O", "path").alias("section_path"), _null("string").alias("block_type"), _null("string").alias("chunk_type"), ref.alias("table_ref"))
    out = store.with_defaults(store.index_ids(rows.withColumn("blocks", _null("string")), "a"))
    return out.select("id", "parent_chunk_id", "section_path", "block_type", "chunk_type", F.col("table_ref.row_index").alias("row_index"), F.array_join("table_ref.headers", "|").alias("headers"))


INDEX_ROWS = """SELECT 'a--' || l_suppkey || '--' || l_orderkey AS id, CASE WHEN l_linenumber > 2 THEN 'a--' || l_suppkey || '--' || l_partkey END AS parent_chunk_id, CASE WHEN l_linestatus = 'O' THEN 'path' ELSE 'general' END AS section_path,
  'paragraph' AS block_type, 'normal' AS chunk_type, CASE WHEN l_returnflag = 'A' THEN 3 END AS row_index, CASE WHEN l_returnflag = 'A' THEN 'a|b' END AS headers FROM lineitem"""


def analysis_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents of one analysis, and one of them by its key."""
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("analysis_id"), F.col("o_orderkey").cast("string").alias("document_id"), F.col("o_orderdate").alias("uploaded_at"), (F.col("o_orderstatus") == "P").alias("deleted"))
    one = catalog.point_read(o, "document_id", "7").select("document_id", F.lit(True).alias("point"))
    return store.documents_of(o, "8").select("document_id", F.lit(False).alias("point")).unionByName(one)


ANALYSIS_DOCUMENTS = "SELECT CAST(o_orderkey AS VARCHAR) AS document_id, false AS point FROM orders WHERE o_custkey = 8 AND o_orderstatus <> 'P' UNION ALL SELECT CAST(o_orderkey AS VARCHAR), true FROM orders WHERE o_orderkey = 7 AND o_orderstatus <> 'P'"


def analysis_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of one analysis, without a cap."""
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("analysis_id"), F.col("l_orderkey").cast("string").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_partkey").alias("id"))
    rows, _ = store.chunks_of(f, "3")
    return rows.select("document_id", "chunk_index", "id")


ANALYSIS_CHUNKS = "SELECT CAST(l_orderkey AS VARCHAR) AS document_id, l_linenumber AS chunk_index, l_partkey AS id FROM lineitem WHERE l_suppkey = 3"


def optimistic_writes(spark: SparkSession, d: str) -> DataFrame:
    """Half of the writes have seen the present row, half an older one; some are new."""
    o = table(spark, d, "orders")
    kept = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"), F.lit("e1").alias("etag"))
    writes = o.select(F.col("o_orderkey").alias("id"), F.lit("new").alias("v"), F.when(F.col("o_orderkey") % 4 == 1, "e1").when(F.col("o_orderkey") % 4 == 2, "old").alias("etag"))
    new, bad = catalog.compare_and_put(kept, writes, ["id"])
    return new.select("id", "v", F.lit(True).alias("applied")).unionByName(bad.select("id", "v", F.lit(False).alias("applied")))


OPTIMISTIC_WRITES = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN 'new' ELSE o_orderstatus END AS v, true AS applied FROM orders
UNION ALL SELECT o_orderkey, 'new', false FROM orders WHERE o_orderkey % 4 >= 2"""


def upload_rules(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    n = F.col("o_orderkey") % 13
    status = F.element_at(F.array(F.lit("error"), F.lit("analyzing"), F.lit("completed")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    pages = F.floor(F.col("o_totalprice") / 400).cast("int")
    return o.select("o_orderkey", F.array_join(catalog.upload_problems(n, pages, F.repeat(F.lit("x"), (F.col("o_orderkey") % 300).cast("int"))), ",").alias("problems"), catalog.estimated_minutes(pages).alias("minutes"), catalog.delete_mode(status).alias("delete_mode"))


UPLOAD_RULES = """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 13 NOT BETWEEN 1 AND 10 THEN 'files' END, CASE WHEN floor(o_totalprice / 400) > 300 THEN 'pages' END, CASE WHEN o_orderkey % 300 > 255 THEN 'name' END) AS problems,
  CASE WHEN floor(o_totalprice / 400) > 100 THEN CAST(floor(floor(o_totalprice / 400) / 10) AS INT) END AS minutes, ['hard', 'refused', 'soft'][o_orderkey % 3 + 1] AS delete_mode FROM orders"""


def duplicate_decisions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    # rows that repeat an order may differ in status, and each has a decision of its own
    document = F.struct("o_orderkey", "o_orderstatus").alias("document_id")
    found = o.select(F.col("o_custkey").alias("analysis_id"), document, (F.col("o_orderkey") + 1).alias("duplicate_of"))
    # no element_at: of a null index it gives the element of the row before
    kind = F.col("o_custkey") % 3
    word = F.when(kind == 0, "view_existing").when(kind == 2, "cancel").when(kind.isNotNull(), "analyze_again")
    made = o.where("not (o_custkey % 5 = 0 and o_orderstatus = 'P')").select(F.col("o_custkey").alias("analysis_id"), document, word.alias("decision"))
    return catalog.decide(found, made)


DUPLICATE_DECISIONS = """
WITH d AS (SELECT o_custkey AS a, o_orderkey AS o, CASE WHEN NOT (o_custkey % 5 = 0 AND o_orderstatus = 'P') THEN o_custkey % 3 END AS k FROM orders),
g AS (SELECT a, count(*) AS n, count_if(k IS NULL) AS missing, min(o) FILTER (k = 0) + 1 AS redirect_to, count_if(k = 2) AS cancelled FROM d GROUP BY a)
SELECT a AS analysis_id, CASE WHEN missing > 0 THEN 'ask' WHEN redirect_to IS NOT NULL THEN 'view' WHEN cancelled = n THEN 'cancel' ELSE 'queue' END AS outcome, redirect_to, cancelled FROM g
"""


def status_views(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a = o.select(F.col("o_orderkey").alias("analysis_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("analyzing").alias("status"), F.when(F.col("o_orderstatus") != "P", "merge").alias("current_stage"), (F.col("o_orderkey") % 100).cast("int").alias("progress"), F.col("o_orderdate").alias("timeout_at"))
    return jobs.status_view(a).select("analysis_id", "label", "ended")


STATUS_VIEWS = "SELECT o_orderkey AS analysis_id, CASE WHEN o_orderstatus = 'P' THEN 'queued' ELSE 'merge' END || ' ' || o_orderkey % 100 || ' %' AS label, o_orderstatus = 'F' AS ended FROM orders"


def comment_list(spark: SparkSession, d: str) -> DataFrame:
    """Comments on one order's status, with the names of those who wrote them."""
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("comment_id"), F.lit("a").alias("analysis_id"), F.col("role").alias("category_key"), _null("string").alias("tracking_item_id"), F.col("text").alias("content"), (F.col("conv_id") % 30).alias("created_by"), F.col("turn").alias("created_at"), (F.col("turn") % 4 == 3).alias("deleted"))
    users = table(spark, d, "customer").where("c_custkey < 20").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return tracking.comments(c, users, "a", "user").select("comment_id", "name", tracking.valid_comment(F.col("content")).alias("valid"))


COMMENT_LIST = """SELECT conv_id || '-' || turn AS comment_id, c_name AS name, length(trim(text)) BETWEEN 1 AND 2000 AS valid
FROM conversations LEFT JOIN customer ON c_custkey = conv_id % 30 AND c_custkey < 20 WHERE role = 'user' AND turn % 4 <> 3"""


def displayed_items(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem")
    kind = F.col("l_linenumber") % 4
    rows = f.select("l_orderkey", "l_linenumber", "l_partkey", F.when(kind == 0, F.col("l_returnflag")).alias("valor"), F.when(kind == 1, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("fecha"), F.lit(" 10:00 ").alias("hora"), _null("string").alias("expresion_relativa"), F.when(kind == 2, F.col("l_quantity")).alias("monto_porcentaje"), _null("double").alias("monto_valor"), _null("string").alias("moneda"), _null("string").alias("texto_original"), F.when(F.col("l_linestatus") == "O", "SUCCESS").alias("extraction_status"), F.col("l_discount").alias("confidence"))
    return jobs.display(rows.withColumn("confidence", F.col("confidence") * 10)).select("l_orderkey", "l_linenumber", "l_partkey", "field_state", "display_value", "level")


DISPLAYED_ITEMS = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' THEN 'found' ELSE 'missing' END AS field_state,
  CASE l_linenumber % 4 WHEN 0 THEN l_returnflag WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d') || ' 10:00' WHEN 2 THEN CAST(l_quantity AS VARCHAR) || ' %' ELSE '-' END AS display_value,
  CASE WHEN l_discount * 10 >= 0.8 THEN 'alta' WHEN l_discount * 10 >= 0.6 THEN 'media' ELSE 'baja' END AS level FROM lineitem"""


# classification and retrieval ----------------------------------------------

HEADED = (classify.Category("plazos", ("dias",), ("plazo", "entrega")), classify.Category("garantias", ("oferta",), ("garantia",)))


def heading_categories(spark: SparkSession, d: str) -> DataFrame:
    """Paths made of order status and priority."""
    leaf = F.when(F.col("o_orderstatus") == "O", "Plazo de ENTREGA y garantía").when(F.col("o_orderstatus") == "F", "Anexo").otherwise("Garantía")
    root = F.when(F.col("o_orderpriority") == "1-URGENT", "Plazos").otherwise("General")
    return table(spark, d, "orders").select("o_orderkey", classify.heading_category(F.array(root, leaf), HEADED).alias("category"))


HEADING_CATEGORIES = "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'plazos' WHEN 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'plazos' END ELSE 'garantias' END AS category FROM orders"


def category_shares(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("primary_category"))
    return retrieve.category_distribution(hits)


CATEGORY_SHARES = """WITH n AS (SELECT user_id, CASE WHEN event_type <> 'error' THEN event_type END AS c, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id AS query_id, c AS primary_category, n, round(n / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM n"""


def prompt_fragments(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    text = retrieve.prompt_fragment((F.col("turn") + 1).cast("int"), F.when(F.col("turn") > 0, F.col("role")), F.col("conv_id").cast("int"), F.when(F.col("turn") % 2 == 0, F.lit("A > B")), F.lit("paragraph"), F.col("text"))
    return c.select("conv_id", "turn", F.md5(text).alias("fragment_md5"))


PROMPT_FRAGMENTS = """SELECT conv_id, turn, md5('[' || (turn + 1) || '] ' || CASE WHEN turn > 0 THEN role ELSE '?' END || ', p. ' || conv_id || ', ' || CASE WHEN turn % 2 = 0 THEN 'A > B' ELSE 'general' END || ' (paragraph)' || chr(10) || text) AS fragment_md5 FROM conversations"""


def field_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Two fields with statistics of their own, hits of the query's own language only."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", F.substring("text", 1, 200).alias("head"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 40).alias("query"), F.when(F.col("item_id") % 2 == 0, "en").otherwise("de").alias("lang"))
    return retrieve.bm25(asked, docs, "doc_id", ["head", "source"], "lang")


_W = r"list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(translate(lower({0}), 'äçèéêíñóöüáàâëìîïòôúùûãõ', 'aceeeinoouaaaeiiioouuuao'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '\s+'), lambda t: t <> '')"
FIELD_BM25 = rf"""
WITH t AS (SELECT doc_id AS id, lang, 0 AS field, {_W.format("left(text, 200)")} AS w FROM documents UNION ALL SELECT doc_id, lang, 1, {_W.format("source")} FROM documents),
st AS (SELECT field, count(*) AS n, avg(len(w)) AS mean FROM t GROUP BY field),
ix AS (SELECT id, lang, field, n_words, term, count(*) AS tf FROM (SELECT id, lang, field, len(w) AS n_words, unnest(w) AS term FROM t) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'en' ELSE 'de' END AS lang, unnest({_W.format("left(text, 40)")}) AS term FROM benchmark),
df AS (SELECT field, term, count(*) AS df FROM ix GROUP BY field, term)
SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_words / mean))), 6) AS score
FROM q JOIN ix USING (term, lang) JOIN df USING (field, term) JOIN st USING (field) GROUP BY query_id, id
"""


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders as blocks; their documents get names where there is an order."""
    b = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_number"))
    docs = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("filename"), (F.col("o_orderstatus") == "O").alias("is_primary"))
    return chunking.with_document(chunking.page_counts(b), docs)


PAGE_COUNTS = "SELECT l_orderkey AS document_id, max(l_linenumber) AS page_count, any_value(o_orderpriority) AS filename, any_value(o_orderstatus = 'O') AS is_primary FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderkey % 2 = 0 GROUP BY l_orderkey"


def declared_columns(spark: SparkSession, d: str) -> DataFrame:
    """A projection to the index' fields: what it does not declare is named, and gone."""
    from pyspark.sql.types import StructType

    kept, dropped = store.project(table(spark, d, "orders"), StructType.fromDDL("o_orderkey long, o_orderstatus string, other int"))
    return kept.withColumn("dropped", F.lit(",".join(dropped)))


DECLARED_COLUMNS = "SELECT o_orderkey, o_orderstatus, 'o_custkey,o_totalprice,o_orderdate,o_orderpriority' AS dropped FROM orders"

QUERIES = {n.lower(): (globals()[n.lower()], sql) for n, sql in list(globals().items()) if n.isupper() and not n.startswith("_") and isinstance(sql, str) and callable(globals().get(n.lower()))}
