"""Queries over chunking, classification and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import tables
from folioforge.functions.text import tokens
from folioforge.operators import chunking, classify, lexical, retrieve, vectors
from folioforge.sources import increment

from .common import GLOSSARY, table


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.window_rows(table(spark, d, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "window_no", F.col("n_words").cast("long").alias("n_words"), F.md5("window_text").alias("window_md5"))


WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda t: t <> '')"
CHUNK_WINDOWS = rf"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT *, unnest(range(0, 1 + CASE WHEN len(w) > 700 THEN CAST(ceil((len(w) - 700) / 580.0) AS BIGINT) ELSE 0 END)) AS window_no FROM w WHERE len(w) > 0)
SELECT doc_id, window_no, len(w[window_no * 580 + 1 : window_no * 580 + 700]) AS n_words,
       md5(array_to_string(w[window_no * 580 + 1 : window_no * 580 + 700], ' ')) AS window_md5 FROM i
"""


def windows_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """The windows by the table function, called laterally."""
    tables.register(spark)
    docs = table(spark, d, "documents")
    return spark.sql("SELECT t.doc_id, w.window_no, CAST(w.n_words AS BIGINT) AS n_words, md5(w.window_text) AS window_md5 FROM {docs} t, LATERAL text_windows(t.text, 700, 120) w", docs=docs)


def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.window_rows(table(spark, d, "documents").select("doc_id", "source", "text"))
    return rows.groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum("n_words").alias("n_words"), F.max("window_no").alias("last_index"), F.count_distinct("doc_id").alias("n_docs"))


CHUNK_COUNTS = rf"""
WITH w AS (SELECT source, doc_id, len({WORDS.format("coalesce(text, '')")}) AS n FROM documents),
i AS (SELECT *, unnest(range(0, 1 + CASE WHEN n > 700 THEN CAST(ceil((n - 700) / 580.0) AS BIGINT) ELSE 0 END)) AS window_no FROM w WHERE n > 0)
SELECT source, count(*) AS n_chunks, sum(least(700, n - window_no * 580)) AS n_words, max(window_no) AS last_index, count(DISTINCT doc_id) AS n_docs FROM i GROUP BY source
"""


def paragraph_packing(spark: SparkSession, d: str) -> DataFrame:
    """Lines as paragraphs, in pieces of 200 words with an overlap of 40."""
    docs = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("parts"))
    rows = docs.select("doc_id", F.posexplode(chunking.packed(F.col("parts"), 200, 40)).alias("piece_no", "piece"))
    return rows.select("doc_id", "piece_no", F.size(tokens(F.col("piece"))).alias("n_words"), F.md5("piece").alias("piece_md5"))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return classify.classify(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), GLOSSARY, path=None)


def term_hits(spark: SparkSession, d: str) -> DataFrame:
    docs = classify.term_counts(table(spark, d, "documents").select("doc_id", "text"), GLOSSARY, "text")
    return docs.select("doc_id", *[F.col(f"hits.{c.name}").cast("long").alias(f"n_{c.name}") for c in GLOSSARY])


def density_scores(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("doc_id", *[F.round(f"scores.{c.name}", 6).alias(c.name) for c in GLOSSARY])


def classify_primary(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).groupBy("primary_category").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def classify_secondary(spark: SparkSession, d: str) -> DataFrame:
    out = classified(spark, d)
    return out.select("doc_id", "primary_category", F.array_join("secondary_categories", ",").alias("secondary"), F.array_join("rivals", ",").alias("rivals"))


#: The marked letters that the tables have, for SQL (which has no decomposition).
ACCENTED, PLAIN = "äçèéêíñóöüáàâëìîïòôúùûãõ", "aceeeinoouaaaeiiioouuuao"


def _folded(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"


FORM = rf"trim(regexp_replace(regexp_replace({_folded('{0}')}, '[^\p{{{{L}}}}\p{{{{N}}}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _scores() -> str:
    hits = ",\n".join("(" + " + ".join(f"CAST(contains(f, ' {classify._folded(t)} ') AS INT)" for t in dict.fromkeys(c.terms)) + f") AS n_{c.name}" for c in GLOSSARY)
    score = ",\n".join(f"least(1.0, least(n_{c.name} / 4.0, 1.0) * least(n_{c.name} / greatest(n_words / 100.0, 1.0), 1.0) * {c.weight}) AS {c.name}" for c in GLOSSARY)
    return f"""
f AS (SELECT doc_id, ' ' || {FORM.format("text")} || ' ' AS f, len({WORDS.format("coalesce(text, '')")}) AS n_words FROM documents),
h AS (SELECT doc_id, n_words, {hits} FROM f),
s AS (SELECT doc_id, {score} FROM h),
p AS (SELECT *, greatest({", ".join(c.name for c in GLOSSARY)}) AS top,
  (SELECT arg_min(name, (-s, no)) FROM (VALUES {", ".join(f"({c.name}, {no}, '{c.name}', {c.primary})" for no, c in enumerate(GLOSSARY))}) v(s, no, name, least_s) WHERE s >= least_s AND s > 0) AS primary_category FROM s)
"""


TERM_HITS = f"WITH {_scores()} SELECT doc_id, {', '.join(f'n_{c.name}' for c in GLOSSARY)} FROM h"
DENSITY_SCORES = f"WITH {_scores()} SELECT doc_id, {', '.join(f'round({c.name}, 6) AS {c.name}' for c in GLOSSARY)} FROM s"
CLASSIFY_PRIMARY = f"WITH {_scores()} SELECT primary_category, count(*) AS n, min(doc_id) AS first_doc FROM p GROUP BY primary_category"
_LISTED = "array_to_string(list_filter([{0}], lambda x: x IS NOT NULL), ',')"
CLASSIFY_SECONDARY = f"""WITH {_scores()} SELECT doc_id, primary_category,
  {_LISTED.format(", ".join(f"CASE WHEN {c.name} >= {c.secondary} AND {c.name} > 0 AND primary_category IS DISTINCT FROM '{c.name}' THEN '{c.name}' END" for c in GLOSSARY))} AS secondary,
  {_LISTED.format(", ".join(f"CASE WHEN {c.name} >= 0.85 * top AND top > 0 THEN '{c.name}' END" for c in GLOSSARY))} AS rivals FROM p"""


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item is a query."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = _queries(spark, d)
    return lexical.search(lexical.build(table(spark, d, "documents"), queries=asked), asked, 10)


_BM25 = rf"""
t AS (SELECT doc_id AS id, {WORDS.format(FORM.format("text"))} AS w FROM documents),
st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
ix AS (SELECT id, n_words, term, count(*) AS tf FROM (SELECT id, len(w) AS n_words, unnest(w) AS term FROM t) GROUP BY ALL),
q AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format(FORM.format("text"))}) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM ix GROUP BY term),
sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_words / mean))), 6) AS score
       FROM q JOIN ix USING (term) JOIN df USING (term), st GROUP BY query_id, id)
"""
BM25_TOPK = f"WITH {_BM25} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 10"


def chunk_changes(spark: SparkSession, d: str) -> DataFrame:
    """Lines as chunks of two states: every fifth document has lost its first line,
    every seventh has its last line twice, every eleventh is gone."""
    lines = F.split("text", "\n")
    was = table(spark, d, "documents").select("doc_id", lines.alias("old"))
    now = F.when(F.col("doc_id") % 11 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 5 == 0, F.slice("old", 2, 1 << 30)).when(F.col("doc_id") % 7 == 0, F.concat("old", F.slice("old", -1, 1))).otherwise(F.col("old"))
    side = lambda c: was.select("doc_id", F.posexplode(c).alias("chunk_index", "line")).withColumn("digest", F.md5("line"))
    out = increment.difference(side(F.col("old")), side(now), "doc_id")
    return out.groupBy(F.col("document").alias("doc_id")).agg(*(F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("added", "removed", "moved", "kept")))


CHUNK_CHANGES = """
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS old FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, old, CASE WHEN doc_id % 11 = 0 THEN [] WHEN doc_id % 5 = 0 THEN old[2:] WHEN doc_id % 7 = 0 THEN list_concat(old, old[-1:]) ELSE old END AS now FROM t),
a AS (SELECT doc_id, unnest(range(0, len(old))) AS place, unnest(old) AS line FROM s), b AS (SELECT doc_id, unnest(range(0, len(now))) AS place, unnest(now) AS line FROM s),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) AS k FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY place) AS k FROM b)
SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, count_if(x.k IS NULL) AS n_added, count_if(y.k IS NULL) AS n_removed, count_if(coalesce(x.place <> y.place, false)) AS n_moved, count_if(coalesce(x.place = y.place, false)) AS n_kept
FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.line = y.line AND x.k = y.k GROUP BY 1
"""


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.knn(_vector_queries(spark, d), table(spark, d, "embeddings"), retrieve.knn_size(10))


_COS = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
cs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS score
       FROM v a, v b WHERE a.vec_id % 50 = 0),
cr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs QUALIFY rank <= 30)
"""
COSINE_TOPK = f"WITH {_COS} SELECT query_id, id, score, rank FROM cr"


def vector_lists_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same neighbours from stored lists: bounds tell which lists may be left out."""
    index = vectors.build(table(spark, d, "embeddings"))
    return vectors.search(index, _vector_queries(spark, d), retrieve.knn_size(10), exact=True)


def vector_lists_probed(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours in the lists of the nearest centres only; recall is tested."""
    index = vectors.build(table(spark, d, "embeddings"))
    return vectors.search(index, _vector_queries(spark, d), retrieve.knn_size(10))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    asked = _queries(spark, d)
    words = lexical.search(lexical.build(table(spark, d, "documents"), queries=asked), asked, 30)
    return retrieve.top(retrieve.fuse(words, cosine_topk(spark, d)), 20)


RRF_FUSION = f"""WITH {_BM25}, {_COS},
l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 30),
f AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT * FROM l UNION ALL SELECT query_id, id, rank FROM cr) GROUP BY query_id, id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 20"""


def overlap_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    hits = bm25_topk(spark, d).drop("rank")
    text = hits.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").join(_queries(spark, d), "query_id")
    scored = text.select("query_id", "id", F.round("score", 0).alias("score"), retrieve.token_overlap(F.col("query"), F.col("text")).cast("long").alias("overlap"))
    return retrieve.rank_with_overlap(scored)


OVERLAP_TIEBREAK = f"""WITH {_BM25},
h AS (SELECT query_id, id, score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10),
o AS (SELECT query_id, id, round(score, 0) AS score, (SELECT count(*) FROM q WHERE q.query_id = h.query_id AND length(q.term) > 2 AND list_contains(t.w, q.term)) AS overlap
      FROM h JOIN t USING (id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, overlap DESC, id) AS rank FROM o"""


def _scored_turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.length("text").alias("score"))


def parent_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Turn 0 of a conversation is the parent of its other turns; every tenth has none."""
    turns = _scored_turns(spark, d)
    chunks = turns.where("conv_id % 10 <> 0 or turn > 0").select("id", F.when(F.col("turn") > 0, F.col("conv_id") * 1000).alias("parent_id"))
    hits = retrieve.top(turns.select((F.col("conv_id") % 5).alias("query_id"), "id", "score"), 40)
    return retrieve.expand_parents(hits, chunks, 20)


PARENT_EXPANSION = """
WITH t AS (SELECT conv_id % 5 AS query_id, conv_id, turn, conv_id * 1000 + turn AS id, length(text) AS score FROM conversations),
c AS (SELECT DISTINCT id FROM t WHERE conv_id % 10 <> 0 OR turn > 0),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM t QUALIFY rank <= 40),
r AS (SELECT h.*, h.id AS matched_id, CASE WHEN turn > 0 AND conv_id * 1000 IN (FROM c) THEN conv_id * 1000 ELSE h.id END AS own FROM h),
b AS (SELECT query_id, own AS id, score, matched_id, rank AS r FROM r QUALIFY row_number() OVER (PARTITION BY query_id, own ORDER BY rank) = 1)
SELECT query_id, id, score, matched_id, row_number() OVER (PARTITION BY query_id ORDER BY r) AS rank FROM b QUALIFY rank <= 20
"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Vector hits with the label as category and the document's size."""
    rows = cosine_topk(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("c"), "label").alias("primary_category")), "id")
    return rows.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("token_count")), "id")


_HITS = f"""{_COS},
hits AS (SELECT query_id, id, score, rank, 'c' || label AS primary_category, n_chars AS token_count FROM cr JOIN embeddings ON vec_id = id JOIN documents ON doc_id = id)"""


def category_boost(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d).withColumn("secondary_categories", F.array(F.when(F.col("id") % 7 == 0, "c3").otherwise("x")))
    return retrieve.boost_category(hits, "c3", 10).select("query_id", "id", "boosted", "new_rank")


CATEGORY_BOOST = f"""WITH {_HITS}, b AS (SELECT *, round(score * CASE WHEN primary_category = 'c3' OR id % 7 = 0 THEN 1.2 ELSE 1.0 END, 6) AS boosted FROM hits)
SELECT query_id, id, boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank) AS new_rank FROM b QUALIFY new_rank <= 10"""


def relevance_cut(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.relevance_cut(_hits(spark, d)).select("query_id", "id", "rank")


RELEVANCE_CUT = f"""WITH {_HITS} SELECT query_id, id, rank FROM hits
QUALIFY count(*) OVER (PARTITION BY query_id) <= 10 OR row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) <= 10 OR score >= 0.4 * max(score) OVER (PARTITION BY query_id)"""


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.token_budget(_hits(spark, d)).select("query_id", "id", "rank", "token_count")


TOKEN_BUDGET = f"""WITH {_HITS} SELECT query_id, id, rank, token_count FROM hits
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1
     OR sum(token_count) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) <= 16000"""


def retrieval_purity(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.purity(_hits(spark, d), "c3")


RETRIEVAL_PURITY = f"""WITH {_HITS} SELECT query_id, count(*) AS n, count_if(primary_category = 'c3') AS n_target, round(count_if(primary_category = 'c3') / count(*), 6) AS purity FROM hits GROUP BY query_id"""

QUERIES = {
    "chunk_windows": (chunk_windows, CHUNK_WINDOWS),
    "windows_in_sql": (windows_in_sql, CHUNK_WINDOWS),
    "chunk_counts": (chunk_counts, CHUNK_COUNTS),
    "paragraph_packing": (paragraph_packing, None),
    "term_hits": (term_hits, TERM_HITS),
    "density_scores": (density_scores, DENSITY_SCORES),
    "classify_primary": (classify_primary, CLASSIFY_PRIMARY),
    "classify_secondary": (classify_secondary, CLASSIFY_SECONDARY),
    "bm25_topk": (bm25_topk, BM25_TOPK),
    "cosine_topk": (cosine_topk, COSINE_TOPK),
    "chunk_changes": (chunk_changes, CHUNK_CHANGES),
    "vector_lists_exact": (vector_lists_exact, COSINE_TOPK),
    "vector_lists_probed": (vector_lists_probed, None),
    "rrf_fusion": (rrf_fusion, RRF_FUSION),
    "overlap_tiebreak": (overlap_tiebreak, OVERLAP_TIEBREAK),
    "parent_expansion": (parent_expansion, PARENT_EXPANSION),
    "category_boost": (category_boost, CATEGORY_BOOST),
    "relevance_cut": (relevance_cut, RELEVANCE_CUT),
    "token_budget": (token_budget, TOKEN_BUDGET),
    "retrieval_purity": (retrieval_purity, RETRIEVAL_PURITY),
}
