"""Queries over grounding, consolidation, lists, tracking and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import catalog, consolidate, ground, tracking
from folioforge.streaming import activity

from . import jobs
from .chunks import _folded
from .common import table


def ground_citations(spark: SparkSession, d: str) -> DataFrame:
    return ground.find_passages(table(spark, d, "benchmark"), table(spark, d, "documents"))


_FORM = rf"trim(regexp_replace({_folded('{0}')}, '\s+', ' ', 'g'))"
_GROUND = f"""
b AS (SELECT item_id, {_FORM.format("text")} AS f FROM benchmark), t AS (SELECT doc_id, {_FORM.format("text")} AS f FROM documents),
g AS (SELECT item_id, doc_id FROM b JOIN t ON contains(t.f, b.f) AND length(b.f) >= 12)
"""
GROUND_CITATIONS = f"WITH {_GROUND} SELECT item_id, doc_id FROM g"


def grounding_status(spark: SparkSession, d: str) -> DataFrame:
    n = ground_citations(spark, d).groupBy("item_id").agg(F.count("*").alias("n_grounded"), F.min("doc_id").alias("first_doc"))
    out = table(spark, d, "benchmark").join(n, "item_id", "left").na.fill(0, ["n_grounded"])
    status = F.when(F.col("n_grounded") > 0, "success").otherwise("partial")
    confidence = consolidate.evidence_confidence(F.col("n_grounded"), status)
    return out.select("item_id", "n_grounded", "first_doc", status.alias("extraction_status"), confidence.alias("confidence"), ground.clip(F.col("text")).alias("citation"))


_CLIP = """CASE WHEN length(trim(text)) <= 120 THEN trim(text)
  WHEN 120 - instr(reverse(left(trim(text), 120)), ' ') >= 12 AND instr(left(trim(text), 120), ' ') > 0 THEN trim(left(trim(text), 120 - instr(reverse(left(trim(text), 120)), ' ')))
  ELSE trim(left(trim(text), 120)) END"""
GROUNDING_STATUS = f"""WITH {_GROUND}, n AS (SELECT item_id, count(*) AS n, min(doc_id) AS first_doc FROM g GROUP BY item_id)
SELECT item_id, coalesce(n, 0) AS n_grounded, first_doc, CASE WHEN n > 0 THEN 'success' ELSE 'partial' END AS extraction_status,
  CASE WHEN n IS NULL THEN 0.1 WHEN n = 1 THEN 0.7 ELSE 0.8 END::DOUBLE AS confidence, {_CLIP} AS citation FROM benchmark LEFT JOIN n USING (item_id)"""


def grounded_references(spark: SparkSession, d: str) -> DataFrame:
    """Every document cites the first line of the next with equal last digit of its source."""
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("source").alias("document_id"), (F.col("doc_id") % 10).cast("int").alias("page_number"), F.col("doc_id").alias("chunk_index"), F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(None).cast("struct<table_id:string,row_index:int,headers:array<string>>").alias("table_ref"))
    refs = docs.select(F.lit("a").alias("analysis_id"), F.col("lang").alias("category"), F.col("doc_id").alias("item_no"), F.lit(0).alias("ref_no"), F.col("source").alias("document_id"), (F.col("doc_id") % 10).cast("int").alias("page_number"), F.substring_index("text", "\n", 1).alias("citation"))
    return ground.verify_references(refs, chunks).select("item_no", "page_number", "chunk_id", "grounded")


GROUNDED_REFERENCES = f"""
WITH t AS (SELECT doc_id, source, doc_id % 10 AS page, {_FORM.format("text")} AS f, split_part(text, chr(10), 1) AS c FROM documents),
r AS (SELECT doc_id, source, page, {_FORM.format("c")} AS cf, length(trim(c)) AS n FROM t),
h AS (SELECT r.doc_id, min(t.doc_id) AS chunk_id FROM r JOIN t ON r.source = t.source AND r.page = t.page AND n >= 12 AND cf <> '' AND contains(t.f, cf) GROUP BY r.doc_id)
SELECT r.doc_id AS item_no, page AS page_number, chunk_id, chunk_id IS NOT NULL AS grounded FROM r LEFT JOIN h USING (doc_id)
"""


def settled_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of their own page; of each document an item that cites its
    beginning, states it only, or does neither, and of every second one a vague
    item that cites it too (one fact with the first, where that cites it)."""
    docs = table(spark, d, "documents").where("text is not null")
    doc = F.col("doc_id").cast("string").alias("document_id")
    index = docs.select(doc, F.lit(1).alias("page_number"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.lit(None).cast("struct<table_id:string,row_index:int,headers:array<string>>").alias("table_ref"), F.col("doc_id").cast("string").alias("id"))
    begin, kind = F.substring("text", 1, 60), F.col("doc_id") % 3
    ref = lambda c: F.array(F.struct(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), c.alias("citation"), F.lit(None).cast("string").alias("block_id"), F.lit(None).cast("string").alias("chunk_id")))
    cited = F.when(kind == 0, begin).otherwise(F.concat(F.lit("nowhere to be found "), F.md5("text")))
    made = lambda no, tipo, valor, r: F.struct((F.col("doc_id") * 2 + no).cast("int").alias("item_no"), F.lit(tipo).alias("tipo"), valor.alias("valor"), r.alias("source_references"))
    first = made(0, "dato", F.when(kind == 2, F.lit("no such words anywhere")).otherwise(begin), ref(cited))
    second = made(1, "otro", F.lit(None).cast("string"), ref(F.substring("text", 1, 50)))
    rows = docs.select(F.col("source").alias("analysis_id"), F.lit("identificacion").alias("category"), F.explode(F.when(F.col("doc_id") % 2 == 0, F.array(first, second)).otherwise(F.array(first))).alias("i"))
    items = rows.select("analysis_id", "category", "i.*", F.lit(0.9).alias("confidence"), F.lit("success").alias("extraction_status"))
    out, _ = jobs.settle(items, index)
    return out.select(F.col("item_no").cast("long").alias("item_no"), "n_merged", "n_refs", "n_grounded", "n_rescued", "extraction_status", "warning")


SETTLED_ITEMS = f"""
WITH t AS (SELECT doc_id, {_FORM.format("text")} AS f, left(text, 60) AS a, left(text, 50) AS b FROM documents WHERE text IS NOT NULL),
i AS (SELECT doc_id, doc_id * 2 AS no, false AS vague, CASE WHEN doc_id % 3 = 0 THEN a END AS cite, CASE WHEN doc_id % 3 < 2 THEN a END AS valor, f FROM t
      UNION ALL SELECT doc_id, doc_id * 2 + 1, true, b, NULL, f FROM t WHERE doc_id % 2 = 0),
g AS (SELECT *, coalesce(length(trim(cite)) >= 12 AND {_FORM.format("cite")} <> '' AND contains(f, {_FORM.format("cite")}), false) AS grounded,
             coalesce(length(trim(valor)) >= 12 AND {_FORM.format("trim(valor)")} <> '' AND contains(f, {_FORM.format("trim(valor)")}), false) AS stated FROM i),
m AS (SELECT *, CASE WHEN vague AND grounded AND bool_or(grounded AND NOT vague) OVER (PARTITION BY doc_id) THEN no - 1 ELSE no END AS item_no FROM g),
r AS (SELECT DISTINCT item_no, grounded, {_FORM.format("coalesce(cite, CAST(no AS VARCHAR))")} AS mark, bool_or(stated) OVER (PARTITION BY item_no) AS stated FROM m),
n AS (SELECT item_no, count(*) AS n_refs, count_if(grounded) AS n_grounded, count_if(stated AND NOT grounded) AS n_rescued FROM r GROUP BY item_no),
k AS (SELECT item_no, count(*) AS n_merged FROM m GROUP BY item_no)
SELECT item_no, n_merged, n_refs, n_grounded, n_rescued, CASE WHEN n_grounded = 0 THEN 'partial' ELSE 'success' END AS extraction_status,
       CASE WHEN n_grounded > 0 THEN NULL WHEN n_rescued > 0 THEN 'citation_rescued' ELSE 'citation_unverified' END AS warning
FROM n JOIN k USING (item_no)
"""


def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("redacted_md5"), (T.redact(F.col("text")) != F.col("text")).alias("changed"))


def _redacted(x: str) -> str:
    for p in T.REDACTED:
        x = f"regexp_replace({x}, '{p}', '\\1***', 'g')"
    return x


REDACT_SECRETS = f"SELECT doc_id, md5({_redacted('text')}) AS redacted_md5, {_redacted('text')} <> text AS changed FROM documents"


def strip_url_query(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.strip_query(F.col("url")).alias("url"))


STRIP_URL_QUERY = r"SELECT page_id, regexp_replace(url, '^([^?#]*)\?[^#]*', '\1') AS url FROM pages"

FACTS = (("email", r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]+)"), ("secret", r"token = \"([^\"]+)\""), ("licence", r"(Licensed under [^\n]*)"))


def regex_facts(spark: SparkSession, d: str) -> DataFrame:
    """The first hit of each kind per source, by document; a fact needs 12 characters."""
    docs = table(spark, d, "documents")
    found = docs.select("source", "doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("tipo"), F.regexp_extract("text", p, 1).alias("valor")) for k, p in FACTS])).alias("x"))
    kept = found.select("source", "doc_id", "x.*").where(F.length("valor") >= 12)
    return kept.groupBy("source", "tipo").agg(F.min("doc_id").alias("doc_id"), F.min_by("valor", "doc_id").alias("valor"))


REGEX_FACTS = (
    "WITH x AS (" + " UNION ALL ".join(f"SELECT source, doc_id, '{k}' AS tipo, regexp_extract(text, '{p.replace(chr(92) + chr(34), chr(34))}', 1) AS valor FROM documents" for k, p in FACTS) + ") "
    "SELECT source, tipo, min(doc_id) AS doc_id, arg_min(valor, doc_id) AS valor FROM x WHERE length(valor) >= 12 GROUP BY source, tipo"
)


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as extracted items of their part."""
    f = table(spark, d, "lineitem")
    return f.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_no"),
        F.col("l_partkey"),
        F.col("l_shipmode").alias("tipo") if "l_shipmode" in f.columns else F.col("l_returnflag").alias("tipo"),
        F.when(F.col("l_linestatus") == "O", "success").otherwise("partial").alias("extraction_status"),
        F.round(F.col("l_discount") * 10, 1).alias("confidence"),
        F.when(F.col("l_linenumber") > 2, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("").alias("fecha"),
        F.when(F.col("l_tax") > 0.04, F.col("l_tax")).alias("monto"),
    )


_ITEMS = """i AS (SELECT l_orderkey * 10 + l_linenumber AS item_no, l_partkey, l_returnflag AS tipo,
  CASE WHEN l_linestatus = 'O' THEN 'success' ELSE 'partial' END AS extraction_status, round(l_discount * 10, 1) AS confidence,
  CASE WHEN l_linenumber > 2 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS fecha, CASE WHEN l_tax > 0.04 THEN l_tax END AS monto FROM lineitem)"""


def dedupe_items(spark: SparkSession, d: str) -> DataFrame:
    out = consolidate.merge_items(_items(spark, d), ["l_partkey", "tipo"], ["fecha", "monto"])
    return out.select("l_partkey", "tipo", "first_no", "n_merged", "extraction_status", "confidence", "fecha", "monto")


DEDUPE_ITEMS = f"""WITH {_ITEMS},
r AS (SELECT *, CASE WHEN extraction_status = 'success' THEN 1 ELSE 0 END AS s, row_number() OVER (PARTITION BY l_partkey, tipo ORDER BY (extraction_status = 'success') DESC, confidence DESC, item_no) AS rk FROM i)
SELECT l_partkey, tipo, min(item_no) AS first_no, count(*) AS n_merged, arg_min(extraction_status, rk) AS extraction_status, arg_min(confidence, rk) AS confidence,
  coalesce(arg_min(fecha, rk) FILTER (rk = 1 AND fecha <> ''), arg_min(fecha, item_no) FILTER (fecha <> '')) AS fecha,
  coalesce(arg_min(monto, rk) FILTER (rk = 1), arg_min(monto, item_no) FILTER (monto IS NOT NULL)) AS monto FROM r GROUP BY l_partkey, tipo"""


def merge_first_nonnull(spark: SparkSession, d: str) -> DataFrame:
    """First value in order that is neither null nor empty."""
    i = _items(spark, d)
    ok = F.col("fecha") != ""
    return i.groupBy("l_partkey").agg(F.min_by(F.when(ok, F.col("fecha")), F.when(ok, F.col("item_no"))).alias("fecha"), F.min_by("monto", F.when(F.col("monto").isNotNull(), F.col("item_no"))).alias("monto"))


MERGE_FIRST_NONNULL = f"WITH {_ITEMS} SELECT l_partkey, arg_min(fecha, item_no) FILTER (fecha <> '') AS fecha, arg_min(monto, item_no) FILTER (monto IS NOT NULL) AS monto FROM i GROUP BY l_partkey"


def conflicts(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.conflicts(_items(spark, d), ["l_partkey", "tipo"], ["fecha", "monto"])


CONFLICTS = f"""WITH {_ITEMS} SELECT l_partkey, tipo, count(*) AS n_items, count(DISTINCT (fecha, coalesce(monto, -1))) AS n_values FROM i GROUP BY l_partkey, tipo HAVING n_items > 1 AND n_values > 1"""


def evidence_confidence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    n = table(spark, d, "lineitem").where("l_quantity > 30").groupBy("l_orderkey").agg(F.count("*").alias("n_refs"))
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "partial").otherwise("not_applicable")
    c = consolidate.evidence_confidence(F.coalesce("n_refs", F.lit(0)), status)
    return o.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", c.alias("confidence"), consolidate.confidence_level(c).alias("level"))


EVIDENCE_CONFIDENCE = """
WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY l_orderkey),
c AS (SELECT o_orderkey, coalesce(n, 0) AS n, o_orderstatus AS s FROM orders LEFT JOIN n ON l_orderkey = o_orderkey),
e AS (SELECT o_orderkey, CAST(CASE WHEN s NOT IN ('F', 'O') THEN CASE WHEN n > 0 THEN 0.7 ELSE 0.0 END
  ELSE CASE WHEN n = 0 THEN 0.3 WHEN n = 1 THEN 0.7 ELSE 0.8 END - CASE WHEN s = 'O' THEN 0.2 ELSE 0 END END AS DOUBLE) AS confidence FROM c)
SELECT o_orderkey, confidence, CASE WHEN confidence >= 0.8 THEN 'alta' WHEN confidence >= 0.6 THEN 'media' ELSE 'baja' END AS level FROM e
"""


def category_confidence(spark: SparkSession, d: str) -> DataFrame:
    i = _items(spark, d)
    return consolidate.category_confidence(i, ["tipo"]).join(consolidate.aggregate_status(i, ["tipo"]), "tipo")


CATEGORY_CONFIDENCE = f"""WITH {_ITEMS} SELECT tipo, coalesce(round(avg(confidence) FILTER (confidence > 0), 2), 0.0) AS confidence,
  CASE WHEN bool_or(extraction_status = 'success') THEN 'success' ELSE 'partial' END AS status FROM i GROUP BY tipo"""


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", catalog.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


EXACT_DUPLICATES = "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING n > 1"


def newest_duplicate(spark: SparkSession, d: str) -> DataFrame:
    """Recency is the identifier; a source owns its documents; a document in a language with e is analysed."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("analysis_id"), F.lit("u").alias("created_by"), catalog.content_hash(F.col("text")).alias("content_hash"), F.lit(False).alias("deleted"))
    made = docs.select(F.col("doc_id").alias("analysis_id"), F.lit("u").alias("created_by"), F.col("doc_id").alias("created_at"), F.when(F.col("doc_id") % 3 == 0, "draft").otherwise("completed").alias("status"), (F.col("doc_id") % 11 == 0).alias("deleted"))
    return catalog.duplicates(rows, made).select("document_id", "duplicate_of")


NEWEST_DUPLICATE = """
WITH t AS (SELECT doc_id, sha256(text) AS h, doc_id % 3 <> 0 AND doc_id % 11 <> 0 AS ok FROM documents)
SELECT a.doc_id AS document_id, max(b.doc_id) AS duplicate_of FROM t a JOIN t b ON a.h = b.h AND a.doc_id <> b.doc_id AND b.ok GROUP BY a.doc_id
"""


def list_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").where("o_orderstatus = 'O' and o_orderdate >= '1995-01-01' and o_orderdate < '1997-01-01'")
    return catalog.list_rows(rows.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", True, "o_orderkey", page=3)


LIST_PAGE = """
SELECT o_orderkey, o_custkey, o_totalprice, count(*) OVER () AS total FROM orders
WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 20
"""


def list_search(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.where(catalog.matches_search(" B ", [F.col("n_name"), F.col("c_mktsegment")])).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


LIST_SEARCH = """SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE contains(lower(n_name), 'b') OR contains(lower(c_mktsegment), 'b') GROUP BY n_name"""


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("version_number"), "o_totalprice", "o_orderstatus")
    return catalog.latest(o, "o_custkey", "version_number")


LATEST_VERSION = """SELECT o_custkey, o_orderkey AS version_number, o_totalprice, o_orderstatus, o_orderkey + 1 AS next_number FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1"""


def timeout_bucket(spark: SparkSession, d: str) -> DataFrame:
    pages = F.pmod("event_id", F.lit(260)).cast("int")
    e = table(spark, d, "events").select("event_id", pages.alias("page_count"), F.col("ts").alias("started_at"))
    out = catalog.with_timeouts(e)
    return out.groupBy(catalog.timeout_minutes(F.col("page_count")).alias("minutes")).agg(F.count("*").alias("n"), F.max("timeout_at").cast("string").alias("last_timeout"), F.min("timeout_warning_at").cast("string").alias("first_warning"))


TIMEOUT_BUCKET = """
WITH e AS (SELECT ts, event_id % 260 AS p FROM events), m AS (SELECT ts, CASE WHEN p <= 50 THEN 8 WHEN p <= 100 THEN 12 WHEN p <= 200 THEN 18 ELSE 25 END AS minutes FROM e)
SELECT minutes, count(*) AS n, CAST(max(ts + minutes * INTERVAL 1 MINUTE) AS VARCHAR) AS last_timeout, CAST(min(ts + (minutes - 2) * INTERVAL 1 MINUTE) AS VARCHAR) AS first_warning FROM m GROUP BY minutes
"""

_STAGE = {"click": 10, "view": 20, "signup": 30, "purchase": 80, "error": 5}


def progress_highwater(spark: SparkSession, d: str) -> DataFrame:
    base = F.create_map(*[x for k, v in _STAGE.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")]
    e = table(spark, d, "events").select("event_id", "user_id", "ts", base.alias("base"), F.pmod("event_id", F.lit(40)).alias("inc"))
    return catalog.progress(e, "user_id", ["ts", "event_id"], "base", "inc").select("event_id", "user_id", "progress")


PROGRESS_HIGHWATER = """SELECT event_id, user_id, least(100, max(event_id % 40 + CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 20 WHEN 'signup' THEN 30 WHEN 'purchase' THEN 80 ELSE 5 END)
 OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS progress FROM events"""


def first_terminal(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_terminal(table(spark, d, "events"), "user_id", "event_type", "event_id", ["error", "purchase"])


FIRST_TERMINAL = "SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id"


def tracking_seed_ids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    parts = [F.lit("v1"), F.col("event_type"), F.col("event_id"), F.col("user_id"), tracking.citation_hash(F.col("props"))]
    return e.where(F.col("event_type").isin("error", "signup")).select("event_id", tracking.item_id(*parts).alias("tracking_item_id"))


TRACKING_SEED_IDS = """SELECT event_id, left(sha256(concat_ws('|', 'v1', event_type, event_id, user_id, left(sha256(coalesce(props, '')), 16))), 24) AS tracking_item_id
FROM events WHERE event_type IN ('error', 'signup')"""


def comment_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    rows = c.where("role = 'user'").select("conv_id", (F.col("turn") % 9 == 0).alias("deleted"))
    return tracking.comment_counts(c.select("conv_id").distinct(), rows, ["conv_id"])


COMMENT_COUNTS = "SELECT conv_id, count(*) FILTER (role = 'user' AND turn % 9 <> 0) AS n_comments FROM conversations GROUP BY conv_id"


def tracking_summary(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "purchase", "closed").when(F.col("event_type") == "view", "in_review").otherwise("not_reviewed")
    return tracking.summary(table(spark, d, "events").select("user_id", state.alias("status")), "user_id", 101)


TRACKING_SUMMARY = """SELECT user_id, count_if(event_type NOT IN ('purchase', 'view')) AS not_reviewed, count_if(event_type = 'view') AS in_review, count_if(event_type = 'purchase') AS closed,
 CAST(round_even(100.0 * count_if(event_type = 'purchase') / 101, 0) AS INT) AS closed_percent FROM events GROUP BY user_id"""


def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    want = F.when(F.col("event_type") == "purchase", "closed").when(F.col("event_type") == "view", "in_review").otherwise("not_reviewed")
    e = table(spark, d, "events").select("user_id", "event_id", want.alias("target"))
    out = tracking.replay(e, ["user_id"], ["event_id"], "target")
    return out.groupBy("user_id").agg(F.count_if("accepted").alias("n_accepted"), F.max_by("state", "event_id").alias("state"))


STATUS_TRANSITIONS = """
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'closed' WHEN 'view' THEN 'in_review' END AS t FROM events),
k AS (SELECT *, lag(t, 1, 'not_reviewed') OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e WHERE t IS NOT NULL),
n AS (SELECT user_id, count_if(t <> before) AS n, arg_max(t, event_id) AS state FROM k GROUP BY user_id)
SELECT user_id, coalesce(n, 0) AS n_accepted, coalesce(state, 'not_reviewed') AS state FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN n USING (user_id)
"""


def timeline_days(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 50 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fecha"))
    return tracking.timeline(o, "fecha", F.lit("1996-01-01").cast("date")).withColumn("day", F.col("day").cast("string"))


TIMELINE_DAYS = """
WITH d AS (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS day, count(*) AS n FROM orders GROUP BY 1),
e AS (SELECT min(day) AS lo, max(day) AS hi FROM d)
SELECT CAST(day AS VARCHAR) AS day, n, round((day - lo) / greatest(hi - lo, 14), 6) AS position, day < DATE '1996-01-01' AS past FROM d, e
"""


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 50, "success").otherwise("partial")
    return tracking.field_states(table(spark, d, "events").select("event_type", s.alias("extraction_status")), ["event_type"])


CATEGORY_COUNTS = """
WITH s AS (SELECT event_type, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 50 THEN 'success' ELSE 'partial' END AS s FROM events)
SELECT event_type, count(*) AS n, count_if(s = 'success') AS found, count_if(s = 'partial') AS "partial", count_if(s = 'failed') AS missing, count_if(s IN ('partial', 'failed')) > 0 AS needs_review FROM s GROUP BY event_type
"""


def token_cost(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.when(F.col("role") != "assistant", n)).alias("p"), F.sum(F.when(F.col("role") == "assistant", n)).alias("c"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return c.select("conv_id", consolidate.token_cost(zero("p"), zero("c")).alias("cost_usd"))


TOKEN_COST = """SELECT conv_id, round(coalesce(sum(length(text)) FILTER (role <> 'assistant'), 0) / 1000 * 0.00015 + coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) / 1000 * 0.0006, 8) AS cost_usd
FROM conversations GROUP BY conv_id"""


def session_activity(spark: SparkSession, d: str) -> DataFrame:
    return activity.sessions(table(spark, d, "events"), 30).select("user_id", F.col("start").cast("string").alias("start"), "n", "total")


SESSION_ACTIVITY = """
WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM g)
SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, no
"""


def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    return activity.windowed(table(spark, d, "events"), "1 hour").select(F.col("start").cast("string").alias("start"), "event_type", "n", "total")


TUMBLING_COUNTS = "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"

QUERIES = {n.lower(): (globals()[n.lower()], sql) for n, sql in list(globals().items()) if n.isupper() and not n.startswith("_") and isinstance(sql, str) and n.lower() in globals()}
