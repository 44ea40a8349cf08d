"""Extraction of items: an exchangeable extractor, and what is done to its output."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import collapse
from folioforge.sources.schemas import REFERENCE

from .ground import LEAST, widen

RAW = f"array<struct<tipo:string,valor:string,confidence:double,extraction_status:string,texto_original:string,source_references:array<{REFERENCE}>>>"
KNOWN = ("success", "partial", "not_applicable", "not_found", "failed")
CONFIDENCE = 0.78

# What the rule extractor looks for (group 1: value).
RULES = (
    ("organismo_convocante", r"(?i)\borganismo\b\s*[:\-]?\s*(.+?)(?=\bprocedimiento\b|\bobjeto\b|\bpresupuesto\b|\bexpediente\b|$)", False),
    ("expediente", r"(?i)\bexpediente\b\s*[:\-]?\s*([A-Z0-9][A-Z0-9\-\/.]{4,})", True),
    ("tipo_procedimiento", r"(?i)(licitaci[oó]n\s+p[úu]blica|licitaci[oó]n\s+privada|contrataci[oó]n\s+directa|concurso\s+de\s+precios|subasta\s+p[úu]blica)\s*(?:n[°ºo\.]?\s*)?[A-Z0-9\-\/.]+", False),
    ("numero_procedimiento", r"(?i)((?:licitaci[oó]n\s+p[úu]blica|licitaci[oó]n\s+privada|contrataci[oó]n\s+directa|concurso\s+de\s+precios|subasta\s+p[úu]blica)\s*(?:n[°ºo\.]?\s*)?[A-Z0-9\-\/.]+)", True),
    ("presupuesto_oficial", r"(?i)\bpresupuesto\s+oficial\b\s*[:\-]?\s*(.+?)(?=\bexpediente\b|\bprocedimiento\b|\bobjeto\b|\bapertura\b|\blugar\b|$)", True),
)


def rule_facts(chunks: DataFrame, known: DataFrame | None = None, by: str = "analysis_id") -> DataFrame:
    """First value of each kind per analysis, by page, document and chunk.

    ``known`` (analysis_id, tipo) are kinds that are there already.  Values that
    need a digit and have none don't count.  Out: by, tipo, valor, confidence,
    extraction_status, document_id, page_number, citation.
    """
    text = chunks.withColumn("__t", collapse(F.col("content")))
    hits = F.array(*[F.struct(F.lit(k).alias("tipo"), F.regexp_replace(F.regexp_extract("__t", p, 1), r"^[ .;:-]+|[ .;:-]+$", "").alias("valor"), F.lit(d).alias("digit")) for k, p, d in RULES])
    rows = text.select(by, "document_id", "page_number", "chunk_index", "__t", F.explode(hits).alias("x")).select("*", "x.*").drop("x")
    rows = rows.where((F.col("valor") != "") & (~F.col("digit") | F.col("valor").rlike(r"\d")))
    if known is not None:
        rows = rows.join(known.select(by, "tipo"), [by, "tipo"], "left_anti")
    at = F.struct("page_number", "document_id", "chunk_index")
    first = rows.groupBy(by, "tipo").agg(F.min_by(F.struct("valor", "document_id", "page_number", "__t"), at).alias("f"))
    cite = context_column(F.col("f.__t"), F.col("f.valor"))
    return first.select(by, "tipo", "f.valor", F.lit(CONFIDENCE).alias("confidence"), F.lit("success").alias("extraction_status"), "f.document_id", "f.page_number", cite.alias("citation")).where(F.length("citation") >= LEAST)


def context_column(content: Column, value: Column, least: int = LEAST) -> Column:
    """The value with whole words around it, as it stands in the text."""
    from pyspark.sql.types import StringType

    def run(ts: pd.Series, vs: pd.Series) -> pd.Series:
        return pd.Series([widen(t, at, at + len(v), least) if (at := t.find(v)) >= 0 else t[:120] for t, v in zip(ts, vs)], dtype=object)

    return F.pandas_udf(run, StringType())(content, value)


def json_of(c: Column) -> Column:
    """The JSON in a model's answer: fences go, else the outermost braces."""
    bare = F.trim(F.regexp_replace(c, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    good = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(good(bare), bare).when((inner != "") & good(inner), inner)


def normalise_items(answers: DataFrame, by: list[str], column: str = "answer", root: str = "items") -> DataFrame:
    """One row per item of each answer; what is no answer has none.

    A confidence outside 0..1 is null; an unknown status is partial with
    references and not_found without.
    """
    parsed = answers.withColumn("__x", F.from_json(F.get_json_object(json_of(F.col(column)), f"$.{root}"), RAW))
    rows = parsed.select(*by, F.posexplode("__x").alias("item_no", "i")).select(*by, "item_no", "i.*").where("i is not null")
    refs = F.coalesce("source_references", F.array().cast(f"array<{REFERENCE}>"))
    status = F.lower(F.trim("extraction_status"))
    return rows.withColumn("source_references", refs).withColumn("confidence", F.when(F.col("confidence").between(0, 1), F.col("confidence"))).withColumn(
        "extraction_status", F.when(status.isin(*KNOWN), status).when(F.size("source_references") > 0, "partial").otherwise("not_found")
    )


def substantive(items: DataFrame) -> Column:
    """Whether an item says anything besides its status."""
    texts = [c for c in ("valor", "fecha", "hora", "expresion_relativa", "texto_original", "lugar") if c in items.columns]
    numbers = [c for c in ("monto_porcentaje", "monto_valor") if c in items.columns]
    out = F.lit(False)
    for c in texts:
        out = out | (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    for c in numbers:
        out = out | F.col(c).isNotNull()
    if "metadata" in items.columns:
        out = out | F.coalesce(F.exists(F.map_values("metadata"), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""), F.lit(False))
    return out


#: Names under which models report what they have read and written.
USAGE = {"prompt_tokens": ("prompt_tokens", "input_tokens"), "completion_tokens": ("completion_tokens", "output_tokens")}
LONGEST_WAIT = 10.0


def run_extractor(work: DataFrame, extractor: Callable[[str, list[dict]], list[dict] | dict], tries: int = 3, wait: float = 2.0) -> DataFrame:
    """work: analysis_id, category, chunks (array of struct) -> answer, status,
    error, prompt_tokens, completion_tokens.

    ``extractor(category, chunks)`` is the model or a stand-in; it gives items, or
    a dict with items and usage.  Tries are ``wait`` seconds apart, doubled each
    time up to LONGEST_WAIT.  Whatever it raises after the last makes that row
    failed, with no items.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                chunks = [c.asDict() if hasattr(c, "asDict") else dict(c) for c in (r.chunks if r.chunks is not None else [])]
                answer, error, usage = None, None, {}
                for i in range(tries):
                    try:
                        made = extractor(r.category, chunks)
                        made = made if isinstance(made, dict) else {"items": made}
                        usage = made.get("usage") or {}
                        answer, error = json.dumps({"items": made["items"]}), None
                        break
                    except Exception as e:  # noqa: BLE001  becomes the row's error
                        error = f"{type(e).__name__}: {e}"
                        if i + 1 < tries:
                            time.sleep(min(LONGEST_WAIT, wait * 2**i))
                n = [next((int(usage[k]) for k in names if usage.get(k) is not None), 0) for names in USAGE.values()]
                out.append((r.analysis_id, r.category, answer, "failed" if error else "success", error, *n))
            yield pd.DataFrame(out, columns=["analysis_id", "category", "answer", "status", "error", *USAGE])

    return work.select("analysis_id", "category", "chunks").mapInPandas(run, "analysis_id string, category string, answer string, status string, error string, prompt_tokens long, completion_tokens long")


class HashEmbedder:
    """A deterministic stand-in for an embedding model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % self.dim] += 1.0 if h & 0x10000 else -1.0
            n = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / n for x in v])
        return out


def batch_size(mean_tokens: float, most: int = 16, budget: int = 20_000) -> int:
    """Inputs per request: as many as fit the token budget, one at least."""
    return min(most, max(1, int(budget / mean_tokens))) if mean_tokens else most


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], dim: int, batch: int | None = None, strict: bool = True) -> DataFrame:
    """Adds embedding, of the title, a blank line and the content.

    Requests have ``batch`` inputs, or as many as :func:`batch_size` allows for the
    first hundred texts of an Arrow batch.  Without ``strict`` the inputs of a
    request that fails have a null vector (and are found by their words alone).
    """
    from pyspark.sql.types import ArrayType, FloatType

    def run(s: pd.Series) -> pd.Series:
        texts, out = list(s), []
        some = [len((t or "").split()) for t in texts[:100]]
        step = batch or batch_size(sum(some) / len(some) if some else 0)
        for i in range(0, len(texts), step):
            part = texts[i : i + step]
            try:
                made = embedder(part)
                if any(len(v) != dim for v in made):
                    raise ValueError(f"a vector without {dim} numbers")
            except Exception:
                if strict:
                    raise
                made = [None] * len(part)
            out += made
        return pd.Series(out, dtype=object)

    text = F.when(F.coalesce(F.trim("title"), F.lit("")) != "", F.concat("title", F.lit("\n\n"), "content")).otherwise(F.col("content"))
    return chunks.withColumn("embedding", F.pandas_udf(run, ArrayType(FloatType()))(text))
