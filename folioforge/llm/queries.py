"""The fixed queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .collocations import mine_collocations
from .common import table
from .decontaminate import flag_contaminated
from .exact_dedup import exact_dedup
from .fim import fill_in_middle, restore
from .html_extract import extract_main_text
from .licenses import PHRASES, TEMPLATES, THRESHOLD, compiled, scan_licenses
from .line_dedup import drop_recurring_lines
from .minhash import near_duplicates
from .pii import KINDS, sanitise
from .quality import score, train
from .secrets import count_kind, find_secrets, span_digest
from .warc import warc_round_trip


def op1_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS digest,
             max(page_id) OVER (PARTITION BY html) AS top
      FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM g
"""


def pii_digest(docs: DataFrame) -> DataFrame:
    found = sanitise(docs)
    return found.select(
        "doc_id",
        *(count_kind(F.col("spans"), k).alias(f"n_{k}") for k in KINDS),
        F.sha2(span_digest(F.col("spans"), KINDS), 256).alias("base_sha256"),
        span_digest(F.col("spans")).alias("spans"),
        (F.size("spans") > 0).alias("has_personal_data"),
    )


def op3_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def secrets_digest(docs: DataFrame) -> DataFrame:
    kinds = ("assign", "access", "hex")
    found = find_secrets(docs, with_text=False)
    return found.select(
        "doc_id",
        *(count_kind(F.col("spans"), k).alias(f"n_{k}") for k in kinds),
        F.sha2(span_digest(F.col("spans"), kinds), 256).alias("base_sha256"),
        span_digest(F.col("spans")).alias("spans"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(table(spark, sf_dir, "documents"))


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH l AS (
  SELECT DISTINCT doc_id, text, i - 1 AS line_no,
         regexp_replace(trim(regexp_replace(regexp_replace(string_split(text, chr(10))[i], '([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3041}-\x{30FF}\x{3400}-\x{9FFF}])', ' \1 ', 'g'),
           '[ \t\r\f\v]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS masked
  FROM (SELECT doc_id, coalesce(text, '') AS text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
t AS (SELECT *, string_split(masked, ' ') AS tok FROM l),
lines AS (SELECT doc_id, text, line_no, masked, len(tok) AS n, len(tok) || ' ' || array_to_string(tok[1:3], ' ') AS leaf
          FROM t WHERE regexp_matches(masked, '\p{L}')),
shared AS (SELECT leaf FROM lines GROUP BY leaf HAVING count(DISTINCT text) > 1),
kinds AS (SELECT leaf, masked, n, count(DISTINCT text) AS texts FROM lines SEMI JOIN shared USING (leaf) GROUP BY ALL),
placed AS (SELECT leaf, masked, n, texts, place, string_split(masked, ' ')[place] AS token
           FROM (SELECT *, unnest(range(1, n + 1)) AS place FROM kinds)),
constant AS (SELECT leaf, place, token FROM placed WHERE token <> '<*>' GROUP BY ALL HAVING sum(texts) >= 3),
templ AS (
  SELECT leaf, masked, CASE WHEN count(c.token) >= 0.5 * n THEN string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY p.place) ELSE masked END AS template
  FROM placed p LEFT JOIN constant c USING (leaf, place, token) GROUP BY leaf, masked, n),
given AS (SELECT leaf, template, n, doc_id, text, line_no FROM lines JOIN templ USING (leaf, masked)),
recurring AS (
  SELECT leaf, template, arg_min(text, doc_id) AS first_text FROM given GROUP BY leaf, template, n
  HAVING count(DISTINCT text) >= 3 OR (count(DISTINCT text) >= 2 AND n >= 50)),
gone AS (SELECT DISTINCT text, line_no FROM given JOIN recurring USING (leaf, template) WHERE text <> first_text),
left_over AS (
  SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n_lines,
         (SELECT list(line_no) FROM gone g WHERE g.text = d.text) AS dropped, d.text
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) d)
SELECT doc_id, n_lines, coalesce(len(dropped), 0) AS n_dropped,
       CASE WHEN dropped IS NULL THEN text
            ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(dropped, i - 1)), chr(10)), '') END AS text
FROM left_over
"""


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
           WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g
  FROM w),
n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
         FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
         WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n
          UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT doc_id, n AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
FROM n JOIN reach ON reach.a = doc_id GROUP BY doc_id, n
"""


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), with_ids=False, digests=True)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_bm25_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def license_digest(docs: DataFrame) -> DataFrame:
    found = scan_licenses(docs)
    joined = (F.array_join(c, ",").alias(c) for c in ("base_labels", "labels"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *joined, "score")


def op11_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(table(spark, sf_dir, "documents"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def op11_sql() -> str:
    """Windows, sets of words and shares by brute force."""
    known = compiled(TEMPLATES, THRESHOLD)
    words = ",\n  ".join(f"({k}, {_quoted(w)})" for k, t in enumerate(known) for w in sorted(t.words))
    heads = ",\n  ".join(f"({k}, {_quoted(t.family)}, {_quoted(t.label)}, {t.window}, {t.least}, {len(t.words)})" for k, t in enumerate(known))
    phrases = ", ".join(f"({_quoted(label)}, [{', '.join(map(_quoted, p.split()))}])" for label, p in PHRASES)
    return rf"""
WITH tw(tid, word) AS (VALUES
  {words}),
t(tid, family, label, size, least, n_own) AS (VALUES
  {heads}),
ph(label, p) AS (VALUES {phrases}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
base AS (
  SELECT r, label, unnest(list_filter(range(0, len(w) - len(p) + 1), lambda i: w[i + 1] = p[1] AND w[i + 1:i + len(p)] = p)) AS pos
  FROM d CROSS JOIN ph WHERE list_contains(w, p[1])),
per AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY r),
p AS (SELECT r, len(w) AS n, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM d),
hit AS (
  SELECT r, n, tid, word, unnest([pos // (size // 2), pos // (size // 2) - 1]) AS block
  FROM p JOIN tw USING (word) JOIN t USING (tid)),
fit AS (
  SELECT r, tid, block, count(DISTINCT word) AS c FROM hit JOIN t USING (tid)
  WHERE block >= 0 AND block < greatest(1, (hit.n + size // 2 - 1) // (size // 2) - 1)
  GROUP BY r, tid, block, least HAVING count(DISTINCT word) >= least),
ranked AS (
  SELECT r, label, CAST(c AS DOUBLE) / n_own AS share, family, block, size,
         rank() OVER (PARTITION BY r, size, block, family ORDER BY CAST(c AS DOUBLE) / n_own DESC, n_own DESC) AS place
  FROM fit JOIN t USING (tid)),
best AS (
  SELECT r, size, block, family, min(label) AS label FROM ranked WHERE place = 1 GROUP BY ALL HAVING min(label) = max(label)),
own AS (SELECT r, list(DISTINCT label) AS labels FROM best GROUP BY r),
top AS (SELECT r, max(share) AS share FROM ranked GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(per.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(per.labels, []), coalesce(own.labels, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN per USING (r) LEFT JOIN own USING (r) LEFT JOIN top USING (r)
"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    digests = (F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
c AS (
  SELECT doc_id, text, u, len(u) AS n,
         CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 100 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM t),
p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS prefix,
         array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(u[greatest(x, y) + 1:n], '') AS suffix
  FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS phrase
  FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k AS size, phrase, f AS a FROM f WHERE k > 1 AND f >= 30),
cut AS (SELECT c.*, i AS k, phrase[1:i] AS head, phrase[i + 1:size] AS tail FROM cand c, (VALUES (1), (2), (3)) AS place(i) WHERE i < size),
scored AS (
  SELECT c.lang, c.size, c.phrase, c.a, x.f AS l, y.f AS r, c.k, ((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cut c JOIN f x ON x.lang = c.lang AND x.phrase = c.head JOIN f y ON y.lang = c.lang AND y.phrase = c.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (
  SELECT lang, a, unnest(list_transform(range(1, size - m + 2), lambda i: phrase[i:i + m - 1])) AS phrase
  FROM cand CROSS JOIN (VALUES (2), (3)) AS sizes(m) WHERE m < size),
over_ AS (SELECT lang, phrase, max(a) AS within FROM part GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN over_ o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE within IS NULL OR 100::HUGEINT * within < 80::HUGEINT * a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank, array_to_string(phrase, ' ') AS phrase, a, l, r, score
  FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_mincut": op1_html_mincut,
        "op2_warc": op2_warc,
        "op3_pii_disclosure": op3_pii_disclosure,
        "op4_secret_scan": op4_secret_scan,
        "op5_line_templates": op5_line_templates,
        "op6_minhash": op6_minhash,
        "op7_bpe_tree": op7_bpe_tree,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_ordinal_quality": op9_ordinal_quality,
        "op10_bm25_wand": op10_bm25_wand,
        "op11_license_join": op11_license_join,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": OP2_SQL,
        "op5_line_templates": OP5_SQL,
        "op6_minhash": OP6_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op11_license_join": op11_sql(),
        "op12_fill_in_middle": OP12_SQL,
        "op13_collocations": OP13_SQL,
    }
