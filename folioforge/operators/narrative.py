"""Narratives: every statement keeps the sources that carry it, or goes."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import grounding_form, tokens

LEAST = 12


def item_stubs(items: DataFrame) -> DataFrame:
    """category, item_ref, stub_no, document_id, page_number, citation, chunk_id
    of the references that have a usable citation."""
    rows = items.select("category", F.col("item_no").alias("item_ref"), F.posexplode("source_references").alias("stub_no", "r"))
    return rows.where(F.length(F.trim(F.coalesce("r.citation", F.lit("")))) >= LEAST).select("category", "item_ref", "stub_no", "r.document_id", "r.page_number", "r.citation", "r.chunk_id")


def overlap_ratio(needle: Column, haystack: Column) -> Column:
    """Share of the different words of ``needle`` that ``haystack`` has."""
    a, b = (F.array_distinct(tokens(grounding_form(c))) for c in (needle, haystack))
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(0.0)


def anchor_evidence(evidence: DataFrame, stubs: DataFrame) -> DataFrame:
    """The source of each evidence among the stubs of its own items.

    ``evidence``: category, evidence_no, text, item_refs.  First a stub that
    holds the text, else the one with most words in common (ties: first).
    """
    rows = evidence.select("category", "evidence_no", "text", F.posexplode("item_refs").alias("ref_no", "item_ref")).join(stubs, ["category", "item_ref"])
    holds = F.contains(grounding_form(F.col("citation")), grounding_form(F.col("text"))) | F.contains(grounding_form(F.col("text")), grounding_form(F.col("citation")))
    share = overlap_ratio(F.col("text"), F.col("citation"))
    w = Window.partitionBy("category", "evidence_no").orderBy(F.desc(holds), F.desc(F.when(holds, 1.0).otherwise(share)), "ref_no", "stub_no")
    return rows.withColumn("__at", F.row_number().over(w)).where("__at = 1").select("category", "evidence_no", "item_ref", "stub_no", "document_id", "page_number", "citation", "chunk_id")


def number_sources(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources without repeats and their dense numbers in order of first use.

    ``links``: category, block_no, element_no, document_id, page_number,
    citation, chunk_id.  Returns (sources, links with source_id).
    """
    key = ["category", "document_id", "page_number", "form"]
    rows = links.withColumn("form", grounding_form(F.col("citation")))
    first = rows.groupBy(*key).agg(F.min_by(F.struct("citation", "chunk_id", F.struct("block_no", "element_no").alias("at")), F.struct("block_no", "element_no", "citation")).alias("s"))
    w = Window.partitionBy("category").orderBy("s.at", "document_id", "page_number", "form")
    sources = first.withColumn("source_id", F.row_number().over(w) - 1)
    out = rows.join(sources.select(*key, "source_id"), key).select("category", "block_no", "element_no", "source_id").distinct()
    return sources.select("category", "source_id", "document_id", "page_number", "s.citation", "s.chunk_id"), out


def resolve(elements: DataFrame, evidence: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements with source_ids, sources) of each category's narrative.

    By evidence where that loses no element of the category, else by the items
    that an element names.  References out of range lead nowhere; an element
    without a source is dropped.  ``elements``: category, block_no, element_no,
    text, item_refs.
    """
    stubs = item_stubs(items)
    found = anchor_evidence(evidence, stubs).join(evidence.select("category", "evidence_no", F.col("item_refs").alias("e_refs")), ["category", "evidence_no"])
    own = elements.select("category", "block_no", "element_no", "item_refs")
    by_evidence = own.join(found, "category").where(F.arrays_overlap("item_refs", "e_refs"))
    by_items = own.withColumn("item_ref", F.explode("item_refs")).join(stubs, ["category", "item_ref"])
    cols = ["category", "block_no", "element_no", "document_id", "page_number", "citation", "chunk_id"]
    n_all = elements.groupBy("category").agg(F.count("*").alias("n_all"))
    n_e = by_evidence.select("category", "block_no", "element_no").distinct().groupBy("category").agg(F.count("*").alias("n_e"))
    whole = n_all.join(n_e, "category").where("n_all = n_e").select("category")
    links = by_evidence.join(whole, "category", "left_semi").select(*cols).unionByName(by_items.join(whole, "category", "left_anti").select(*cols))
    sources, of = number_sources(links)
    ids = of.groupBy("category", "block_no", "element_no").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    return elements.join(ids, ["category", "block_no", "element_no"]), sources


def contained_once(rows: DataFrame) -> DataFrame:
    """(document_id, page_number, source_id, kept_id): of texts that contain each
    other the longer stays.  Order decides, so each page is walked in turn."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        to: dict[int, int] = {}
        for r in f.sort_values("source_id").itertuples(index=False):
            hit = next((k for k in kept if r.form in k[1] or k[1] in r.form), None)
            if hit is None:
                kept.append([r.source_id, r.form])
                to[r.source_id] = r.source_id
                continue
            if len(r.form) > len(hit[1]):
                hit[1] = r.form
            to[r.source_id] = hit[0]
        return pd.DataFrame([(f.document_id.iloc[0], f.page_number.iloc[0], a, b) for a, b in to.items()], columns=["document_id", "page_number", "source_id", "kept_id"])

    picked = rows.select("document_id", "page_number", "source_id", grounding_form(F.col("citation")).alias("form"))
    return picked.groupBy("document_id", "page_number").applyInPandas(run, "document_id string, page_number int, source_id int, kept_id int")


def conflict_text(conflicts: DataFrame, by: str) -> DataFrame:
    """One text per category: a line per conflicting type with its values."""
    line = F.format_string("- %s: %s", "tipo", F.array_join(F.transform(F.array_sort("values"), lambda v: F.coalesce(v, F.lit("∅"))), " / "))
    return conflicts.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("conflict_text"))


def fallback(items: DataFrame, by: str) -> DataFrame:
    """A plain narrative of found items: one sentence, or a list of several."""
    ok = items.where(F.col("extraction_status").isin("success", "partial", "not_applicable"))
    line = F.concat_ws(": ", F.regexp_replace("tipo", "_", " "), "valor")
    out = ok.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("item_no", line.alias("t")))).getField("t").alias("lines"))
    return out.select(by, F.when(F.size("lines") > 1, F.concat(F.lit("- "), F.array_join("lines", "\n- "))).otherwise(F.get("lines", F.lit(0))).alias("text"), F.when(F.size("lines") > 1, "bullet_list").otherwise("paragraph").alias("kind"))


