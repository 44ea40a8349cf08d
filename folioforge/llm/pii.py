"""Personal data: patterns, and terms that give protected entities away.

Base spans (email, ip, card, phone) are found by linear scans equal to their
regular expressions.  Each distinct matched string is a protected entity.  A
term may reveal an entity even where the entity is masked; how much is estimated
from the corpus: with p(e) the share of texts that hold entity e and p(e|t) its
share among the texts with term t, the term discloses

    D(e, t) = log(p(e|t) / p(e)) / log(1 / p(e))

of the entity's information content: 0 if the term tells nothing, 1 if whoever
reads it knows the entity.  In a document that holds e, terms with
D >= ``GENERALISE`` are replaced by their shape, terms with D >= ``REMOVE`` are
removed.

A text has a term if the term stands outside the text's base spans, in the
entity's texts and in the corpus alike.

Terms are all words, short ones and numbers included; common ones never reach the
bound.  Texts that are equal count once, so copies of one text make no evidence,
and a pair counts only with ``SUPPORT`` different texts behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, join_hot, materialize, text_slices

KINDS = ("email", "ip", "card", "phone")
GENERALISE, REMOVE, SUPPORT = 0.8, 0.95, 3
MASK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
# fewer than twelve digits never pass, and what begins inside such a run is
# shorter still
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,}+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and a domain with a dot.

    A local part holds no @, so every match is the run before some @; looking
    only there makes the scan linear.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        nxt = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = nxt = m.end()
        at = text.find("@", nxt)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = [(a, 0, e) for a, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0") or "0") < 4 and int(p) <= 255 for part in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def terms_of(text: str, spans: list[tuple[int, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Lower-cased terms outside the spans, and where they are."""
    out: dict[str, list[tuple[int, int]]] = {}
    k, reach = 0, 0
    for m in TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][2])
            k += 1
        if m.start() >= reach:
            out.setdefault(m[0].lower(), []).append((m.start(), m.end()))
    return out


ENTITY = "array<struct<kind:string,value:string>>"
FOUND = "doc_id long, text_key binary, starts array<long>, kinds array<int>, ends array<long>, entities " + ENTITY + ", text string"


def _scan(docs: DataFrame) -> DataFrame:
    """Base spans per document; entities and text only where there are spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string())]))
        for b in text_slices(batches, 1):
            texts = [t or "" for t in b.column(1).to_pylist()]
            spans = [base_spans(t) for t in texts]
            entities = [[{"kind": k, "value": v} for k, v in sorted({(KINDS[k], t[a:e]) for a, k, e in s})] for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([xxhash.xxh3_128_digest(t.encode()) for t in texts], pa.binary()),
                    pa.array([[x[0] for x in s] for s in spans], pa.list_(pa.int64())),
                    pa.array([[x[1] for x in s] for s in spans], pa.list_(pa.int32())),
                    pa.array([[x[2] for x in s] for s in spans], pa.list_(pa.int64())),
                    pa.array(entities, entity),
                    pa.array([t if s else None for t, s in zip(texts, spans)], pa.string()),
                ],
                ["doc_id", "text_key", "starts", "kinds", "ends", "entities", "text"],
            )

    return docs.mapInArrow(run, FOUND)


def _terms(rows: DataFrame) -> DataFrame:
    """text_key, term: the distinct terms of each text that holds entities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 4):
            keys, terms = [], []
            for key, starts, kinds, ends, text in zip(*(c.to_pylist() for c in b.columns)):
                own = sorted(terms_of(text, list(zip(starts, kinds, ends))))
                keys += [key] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(terms, pa.string())], ["text_key", "term"])

    return rows.select("text_key", "starts", "kinds", "ends", "text").mapInArrow(run, "text_key binary, term string")


def _term_counts(docs: DataFrame, wanted: DataFrame, found: DataFrame) -> DataFrame:
    """term, texts: in how many different texts of the corpus each term occurs
    outside the base spans, as in ``terms_of``.

    Every text is read.  Two bitmaps of bounded size tell which terms are wanted
    and which texts have copies.  Terms of texts without copies are counted where
    they are read and leave a task as one row per term; only for texts with
    copies do (term, text) pairs meet to be counted once.  What a bitmap lets
    through by chance costs a row more and changes no count: terms that are not
    wanted meet no entity later, and a lone text is a pair of its own.
    """
    spark = docs.sparkSession
    wanted = materialize(wanted, "pii-wanted")
    terms_held = spark.sparkContext.broadcast(_bits(wanted.select(F.xxhash64("term").alias("key")), wanted.count()))
    copied = materialize(found.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("text_key").alias("key")), "pii-copied")
    texts_held = spark.sparkContext.broadcast(_bits(copied, copied.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted_terms, copies = terms_held.value, texts_held.value
        known: dict[str, bool] = {}
        lone: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            rows = [list(lone), [None] * len(lone), list(lone.values())]
            lone.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.int64())], ["term", "text_key", "n"])

        for b in text_slices(batches, 1):
            terms, keys = [], []
            for text in b.column(1).to_pylist():
                if not text:
                    continue
                key = xxhash.xxh3_128_digest(text.encode())
                alone = not passes(copies, key)
                spans = base_spans(text)
                for t in terms_of(text, spans) if spans else set(map(str.lower, TERM.findall(text))):
                    ok = known.get(t)
                    if ok is None:
                        if len(known) > 100_000:
                            known.clear()
                        ok = known[t] = passes(wanted_terms, t.encode())
                    if not ok:
                        continue
                    if alone:
                        lone[t] = lone.get(t, 0) + 1
                    else:
                        terms.append(t)
                        keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(keys, pa.binary()), pa.array([1] * len(terms), pa.int64())], ["term", "text_key", "n"])
            if len(lone) > 100_000:
                yield flush()
        yield flush()

    hits = materialize(docs.mapInArrow(run, "term string, text_key binary, n long"), "pii-term-hits")
    pairs = hits.where("text_key is not null").distinct().select("term", "n")
    return hits.where("text_key is null").select("term", "n").union(pairs).groupBy("term").agg(F.sum("n").alias("texts"))


def _bits(keys: DataFrame, n_keys: int) -> np.ndarray:
    """The longs of a bitmap (at most four megabytes), for workers; with 32 bits for
    a key, as every word of every text is looked up."""
    return np.array(bitmap(keys, 4 * n_keys, "pii-bitmap").first().bits, np.int64)


def passes(bits: np.ndarray, key: bytes) -> bool:
    """Whether the bitmap may hold the hash that Spark has of ``key``."""
    h = xxhash.xxh64_intdigest(key, 42)
    return bool(int(bits[(h & (64 * len(bits) - 1)) >> 6]) >> (h & 63) & 1)


def disclosing_terms(docs: DataFrame, found: DataFrame, generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """entity (kind:value), term, disclosure, for pairs of at least ``generalise``.

    ``docs`` (doc_id, text) is the corpus, ``found`` the result of the scan.
    """
    entity = F.concat_ws(":", "e.kind", "e.value")
    with_any = found.where(F.size("entities") > 0)
    distinct = with_any.dropDuplicates(["text_key"])
    held = distinct.select("text_key", F.explode("entities").alias("e")).select("text_key", entity.alias("entity"))
    often = held.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    held = materialize(held.join(often, "entity"), "pii-entities")
    rows = distinct.join(held.select("text_key").distinct(), "text_key", "left_semi")
    terms = materialize(_terms(rows), "pii-text-terms")
    n_texts = found.agg(F.count_distinct("text_key").alias("n_texts"))
    n = max(2, n_texts.first()[0])
    # a term occurs in at least the texts looked at here, which bounds its
    # disclosure from above; so common words and lone ones meet no entity, and
    # need not be counted in the corpus
    most = materialize(held.where(F.col("n_entity") < n).agg(F.max("n_entity").alias("n_entity")), "pii-most")
    seen = terms.groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= support)
    seen = seen.join(F.broadcast(most), _bound(n) >= generalise).select("term", "texts", F.col("texts").alias("n_rows"))
    terms = join_hot(terms, materialize(seen, "pii-seen"), ["term"], terms.count()).drop("n_rows")
    pairs = held.join(terms, "text_key").where(_bound(n) >= generalise).groupBy("entity", "n_entity", "term", "texts").agg(F.count("*").alias("n_both"))
    pairs = pairs.where((F.col("n_both") >= support) & (_disclosure(n) >= generalise)).drop("texts")
    pairs = materialize(pairs, "pii-pairs")
    counts = _term_counts(docs, pairs.select("term").distinct(), found)
    scored = pairs.join(counts, "term").withColumn("disclosure", _disclosure(n))
    return scored.where(F.col("disclosure") >= generalise).select("entity", "term", "disclosure")


def _disclosure(n: int, both: Column | None = None) -> Column:
    """Of ``n`` texts, from n_entity, n_both and texts (those with the term)."""
    both = F.col("n_both") if both is None else both
    info = F.log(n / F.col("n_entity"))
    ratio = F.log(F.least(F.lit(1.0), both / F.col("texts")) * n / F.col("n_entity"))
    return F.when(info > 0, ratio / info).otherwise(0.0)


def _bound(n: int) -> Column:
    """The most a term in at least ``texts`` texts can disclose of an entity: if
    all texts of the rarer of the two have both."""
    return _disclosure(n, F.least("n_entity", "texts")) + 1e-9


SPANS = "array<struct<kind:string,start:long,end:long>>"
OUT = f"doc_id long, spans {SPANS}, sanitised string"


def _apply(rows: DataFrame, remove: float) -> DataFrame:
    """Rows (FOUND plus terms: array of struct<term, disclosure>) -> OUT."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 4):
            ids, all_spans, texts = [], [], []
            for doc_id, starts, kinds, ends, text, terms in zip(*(c.to_pylist() for c in b.columns)):
                spans = [(a, k, e, KINDS[k], MASK[KINDS[k]]) for a, k, e in zip(starts, kinds, ends)]
                if terms:
                    where = terms_of(text, list(zip(starts, kinds, ends)))
                    for t in terms:
                        for a, e in where.get(t["term"], ()):
                            gone = t["disclosure"] >= remove
                            spans.append((a, 4, e, "term", "" if gone else shape(text[a:e])))
                spans.sort()
                ids.append(doc_id)
                all_spans.append([{"kind": s[3], "start": s[0], "end": s[2]} for s in spans])
                texts.append(_replaced(text, spans) if spans else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(all_spans, span), pa.array(texts, pa.string())], ["doc_id", "spans", "sanitised"])

    return rows.select("doc_id", "starts", "kinds", "ends", "text", "terms").mapInArrow(run, OUT)


def shape(term: str) -> str:
    """A term's general form: its first letter's case and its length class."""
    size = "short" if len(term) < 6 else "middle" if len(term) < 10 else "long"
    return f"[{'Name' if term[0].isupper() else 'word'}:{size}]"


def _replaced(text: str, spans: list[tuple]) -> str:
    out, at = [], 0
    for a, _, e, _, new in spans:
        if a >= at:
            out += [text[at:a], new]
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """Personal data of every document, and its sanitised text.

    Columns: doc_id, spans array<struct<kind, start, end>> (code points, end
    exclusive, by start, then email, ip, card, phone, term), sanitised (null where
    nothing is replaced: the text stays as it is).  Null text = empty text
    without spans.  Base spans of different kinds may overlap; they are replaced
    as one, by the mask of the first.  Terms never overlap base spans.  Rows that
    repeat a text get equal results and count once as evidence.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = materialize(_scan(picked), "pii-scan")
    telling = materialize(disclosing_terms(picked, found, generalise, support), "pii-terms")
    # (text, term) for texts that hold both; keyed by text, so a text with
    # many copies is looked up once
    some = found.where(F.size("entities") > 0)
    once = some.dropDuplicates(["text_key"])
    held = once.select("text_key", F.explode("entities").alias("e")).select("text_key", F.concat_ws(":", "e.kind", "e.value").alias("entity"))
    held = held.join(telling.select("entity").distinct(), "entity", "left_semi")
    of_text = held.join(_terms(once.join(held.select("text_key").distinct(), "text_key", "left_semi")), "text_key").join(telling, ["entity", "term"])
    listed = of_text.groupBy("text_key", "term").agg(F.max("disclosure").alias("disclosure"))
    # a text's own terms: bounded by the text
    listed = listed.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("term", "disclosure"))).alias("terms"))
    joined = some.join(listed, "text_key", "left")
    none = found.where(F.size("entities") == 0).select("doc_id", F.array().cast(SPANS).alias("spans"), F.lit(None).cast("string").alias("sanitised"))
    return _apply(joined, remove).union(none)
