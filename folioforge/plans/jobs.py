"""Whole jobs: from layouts to an index, and from raw items to published ones."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators import chunking, classify, consolidate, contain, extract, ground, layout, lexical, retrieve, sections
from folioforge.sources import schemas, scratch, store

FIELDS = ("valor", "fecha", "hora", "expresion_relativa", "texto_original", "lugar", "monto_porcentaje", "monto_valor", "moneda")


def document_blocks(layouts: DataFrame) -> DataFrame:
    """Layouts (document_id, markdown and any of schemas.LAYOUT) -> schemas.BLOCK.

    With cells, tables become "header: value" rows at their place in the text;
    with paragraphs and pages, blocks get paragraph ids, boxes and lines.  What a
    reader does not give is null; tables without cells are left out.
    """
    part = lambda name: layouts.select("document_id", F.explode(name).alias("x")).select("document_id", "x.*")
    has = lambda *names: all(n in layouts.columns for n in names)
    blocks = layout.parse_markdown(layouts.where(F.col("markdown").isNotNull()))
    if has("cells", "tables"):
        blocks = layout.place_tables(blocks, layout.table_rows(part("cells")), part("tables"))
    else:
        blocks = blocks.where("block_type <> 'table'").withColumns({"row_order": F.lit(0), "table_ref": F.lit(None).cast(schemas.TABLE_REF)})
    order = Window.partitionBy("document_id").orderBy("source_order", "row_order")
    blocks = blocks.withColumn("block_no", F.row_number().over(order) - 1)
    if not has("paragraphs", "pages"):
        return blocks.withColumns({"para_id": F.lit(None).cast(schemas.PARA_ID), "bbox": F.array().cast(f"array<{schemas.BOX}>"), "lines": F.lit(None).cast(f"array<{schemas.LINE}>")})
    blocks = layout.with_geometry(blocks, part("paragraphs"), part("pages"))
    if has("cells", "tables"):
        rows = layout.row_boxes(part("cells"), part("tables"), part("pages")).select(F.col("document_id").alias("__d"), F.col("table_id").alias("__t"), F.col("row_index").alias("__r"), "box")
        same = (F.col("document_id") == F.col("__d")) & (F.col("table_ref.table_id") == F.col("__t")) & (F.col("row_order") == F.col("__r"))
        blocks = blocks.join(rows, same, "left").withColumn("bbox", F.when(F.col("box").isNotNull(), F.array("box")).otherwise(F.col("bbox"))).drop("__d", "__t", "__r", "box")
    if has("lines"):
        return layout.attach_lines(blocks, layout.scaled(part("lines"), part("pages")))
    return blocks.withColumn("lines", F.lit(None).cast(f"array<{schemas.LINE}>"))


def ingest(layouts: DataFrame, analysis_id: str, glossary: Sequence[classify.Category], embedder: Callable, dim: int, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(index rows, failed documents) of an analysis.

    ``layouts``: document_id, markdown, error, and what else the reader gives.  A
    document that could not be read is reported and does not keep the others
    from the index.
    """
    failed = layouts.where(F.col("error").isNotNull()).select("document_id", "error")
    blocks = document_blocks(layouts.where(F.col("error").isNull() & F.col("markdown").isNotNull()))
    chunks = chunking.create_chunks(sections.build_sections(blocks), size, overlap)
    labelled = classify.classify(chunks, glossary)
    return store.index_ids(extract.embed(labelled, embedder, dim), analysis_id), failed


def extract_facts(
    questions: DataFrame, index: DataFrame, extractor: Callable, top_k: int | dict[str, int] = 25, tries: int = 3, wait: float = 2.0, exclusive: DataFrame | None = None, lexical_index: lexical.LexicalIndex | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, references, runs): one extractor run per analysis and category.

    ``questions``: analysis_id, category, query, query_vec (may be null).
    ``index``: what :func:`ingest` makes.  Retrieval inside the analysis over all
    text fields, children giving way to their parents, the category's chunks
    raised, the relevance cut, the token budget, the model, its answer as items,
    and what :func:`settle` does with them.  ``top_k`` may differ by category.  A
    question for which nothing is retrieved is a run with the status not_found and
    no tokens; the model is not asked.
    """
    each = top_k if isinstance(top_k, dict) else {}
    default = 25 if isinstance(top_k, dict) else top_k
    most = max([default, *each.values()])
    own_k = F.lit(default)
    for name, k in each.items():
        own_k = F.when(F.col("category") == name, k).otherwise(own_k)
    asked = questions.withColumn("query_id", F.concat_ws("\x1f", "analysis_id", "category"))
    fields = index.withColumn("heading", F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), " "))
    hits = retrieve.hybrid(asked, fields, 3 * most, ("content", "title", "section_path", "heading"), "analysis_id", lexical_index)
    if "parent_chunk_id" in index.columns:
        hits = retrieve.expand_parents(hits.select("query_id", "id", "score", "rank"), index.select("id", F.col("parent_chunk_id").alias("parent_id")), 3 * most)
    more = index.select("id", "primary_category", "secondary_categories", "token_count", "document_id", "page_number", "content", "section_path")
    hits = hits.join(more, "id").join(asked.select("query_id", "analysis_id", "category"), "query_id")
    best = retrieve.boost_category(hits, F.col("category"), own_k).withColumns({"score": F.col("boosted"), "rank": F.col("new_rank")})
    kept = retrieve.token_budget(retrieve.relevance_cut(best))
    shown = F.struct("rank", "id", "document_id", "page_number", "section_path", "content")
    work = scratch.written(kept.groupBy("analysis_id", "category").agg(F.array_sort(F.collect_list(shown)).alias("chunks")), "extractor-work")  # bounded by the budget
    runs = scratch.written(extract.run_extractor(work, extractor, tries, wait), "extractor-runs")
    none = questions.select("analysis_id", "category").distinct().join(work, ["analysis_id", "category"], "left_anti")
    none = none.select("analysis_id", "category", F.lit(None).cast("string").alias("answer"), F.lit("not_found").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"))
    items = extract.normalise_items(runs.where("status = 'success'"), ["analysis_id", "category"])
    return *settle(items, index, exclusive), runs.unionByName(none)


def _references(items: DataFrame) -> DataFrame:
    rows = items.select("analysis_id", "category", "item_no", F.posexplode("source_references").alias("ref_no", "r"))
    return rows.select("analysis_id", "category", "item_no", "ref_no", "r.document_id", "r.page_number", "r.citation")


def settle(items: DataFrame, index: DataFrame, exclusive: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, references): what follows the model's answer.

    Where a category has findings, a not_found with content is partial and one
    without goes.  Items that share a grounding chunk are one fact if one of them
    says little of itself.  Of the merged items every citation is verified in the
    chunks of its page; one that is nowhere gives way to the item's own words if
    the page has those; a short one takes words around it from its chunk, a long
    one is cut to where it states the value.  References get origin, chunk and
    block; items their status, warning and, with ``exclusive`` (terms of other
    categories), the first foreign term, which is then the warning.
    """
    key = ["analysis_id", "category", "item_no"]
    chunks = index.select("document_id", "page_number", "chunk_index", "content", "table_ref", "id")
    numbers = ("monto_porcentaje", "monto_valor")
    items = items.withColumns({c: F.lit(None).cast("double" if c in numbers else "string") for c in FIELDS if c not in items.columns})
    said = scratch.written(consolidate.mixed_not_found(items, key[:2], extract.substantive(items)), "settle-items")
    texts = ground.page_texts(chunks)
    held = ground.verify_references(_references(said), chunks, texts).where("grounded").groupBy(*key).agg(F.collect_set("chunk_id").alias("chunk_ids"))
    weak = ground.weak_identity(F.col("tipo"), F.col("extraction_status"), F.col("confidence"))
    groups = ground.merge_split_facts(said.join(held, key, "left").select(*key, weak.alias("weak"), "chunk_ids"))
    merged = consolidate.merge_items(said.join(groups, key), [*key[:2], "group_no"], ["tipo", *FIELDS])
    merged = scratch.written(merged.withColumnRenamed("group_no", "item_no"), "settle-merged")
    checked = scratch.written(ground.verify_references(_references(merged), chunks, texts), "settle-checked")
    found = scratch.written(ground.rescue(checked, merged, chunks, texts), "settle-found")
    # the words of the chunk are needed where a citation is too short, the value where it is too long
    brief = F.when(F.length("citation") < ground.PREFERRED, F.col("chunk_id"))
    wanted = found.select(brief.alias("__brief")).where("__brief is not null").distinct()
    size = wanted.agg(F.sum(F.octet_length("__brief") + 64)).first()[0] or 0
    text = chunks.select(F.col("id").alias("__brief"), F.col("content").alias("__content"))
    text = text.join(F.broadcast(wanted) if size <= contain.SENT else wanted, "__brief", "left_semi")
    shaped = found.withColumn("__brief", brief).join(text, "__brief", "left").drop("__brief").join(merged.select(*key, F.col("valor").alias("__value")), key, "left")
    wide = F.when(F.col("chunk_id").isNotNull() & (F.length("citation") < ground.PREFERRED), ground.widen_column(F.col("citation"), F.col("__content"))).otherwise(F.col("citation"))
    shaped = shaped.withColumn("__wide", wide)
    final = F.when(F.col("chunk_id").isNotNull() & (F.length("__wide") > ground.MOST), ground.shorten(F.col("__wide"), F.col("__value"))).otherwise(F.col("__wide"))
    original = checked.select(*key, "ref_no", F.col("citation").alias("original_citation"))
    shaped = shaped.withColumn("citation", final).drop("__wide", "__content", "__value").join(original, [*key, "ref_no"])
    shaped = shaped.withColumn("origin", ground.citation_origin(F.col("original_citation"), F.col("citation"), F.col("rescued")))
    if "blocks" in index.columns:
        # a block's name is its paragraph's place
        place = lambda p: F.when(p.isNotNull(), F.concat_ws("--", "document_id", p["page"].cast("string"), p["idx"].cast("string")))
        blocks = F.transform("blocks", lambda b: F.struct(place(b["para_id"]).alias("block_id"), b["content"].alias("content")))
        shaped = ground.attach_identity(shaped, index.select("id", blocks.alias("blocks")))
    refs = scratch.written(shaped, "settle-references")
    out = ground.item_status(refs, merged)
    if exclusive is not None:
        out = consolidate.contamination(out, exclusive).withColumn("warning", F.when(F.col("foreign_term").isNotNull(), "foreign_term").otherwise(F.col("warning")))
    return out, refs


def canonical(category: Column, tipo: Column, strict: bool = False) -> Column:
    """The type of an item in the vocabulary of its category."""
    return (
        F.when(category == "plazos_clave", consolidate.deadline_type(tipo))
        .when(category == "garantias", consolidate.guarantee_type(tipo))
        .when(category == "identificacion", consolidate.identity_type(tipo))
        .when(category == "causales_rechazo", consolidate.cause_type(tipo, strict))
        .when(category == "riesgos", consolidate.risk_type(tipo))
        .otherwise(tipo)
    )


def fingerprint(category: Column) -> Column:
    """What makes two items of a type the same fact."""
    return (
        F.when(category == "plazos_clave", consolidate.deadline_key(F.col("fecha"), F.col("expresion_relativa"), F.col("texto_original")))
        .when(category == "garantias", consolidate.guarantee_key(F.col("monto_porcentaje"), F.col("monto_valor")))
        .otherwise(consolidate.value_key(F.col("valor")))
    )


def publish(items: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, rejected, categories, conflicts) from verified items.

    Order of the steps: usable citations, confidence from evidence, canonical
    types, merging of equal facts, the citation contract, validation, confidence
    of categories, conflicts.  ``strict`` keeps the confidence from before the
    merge; otherwise references gained by merging count.
    """
    conf = lambda: consolidate.evidence_confidence(F.size("source_references"), F.col("extraction_status"))
    some = F.exists("source_references", lambda r: F.length(F.trim(F.coalesce(r["citation"], F.lit("")))) >= 12)
    weak = (F.col("extraction_status") == "success") & ~F.coalesce(some, F.lit(False))
    rows = items.withColumn("extraction_status", F.when(weak, "partial").otherwise(F.col("extraction_status"))).withColumn("confidence", conf())
    rows = rows.withColumn("tipo", canonical(F.col("category"), F.col("tipo"), strict)).withColumn("fingerprint", fingerprint(F.col("category")))
    key = ["analysis_id", "category", "tipo", "fingerprint"]
    merged = consolidate.merge_items(rows, key, FIELDS)
    if not strict:
        merged = merged.withColumn("confidence", conf())
    cited = consolidate.enforce_citations(merged)
    rules = consolidate.amount_rules() | {"known_type": F.col("tipo").isNotNull()}
    checked = consolidate.validate(cited, {k: (F.when(F.col("category") == "plazos_clave", r) if k == "date_shape" else r) for k, r in rules.items()})
    checked = checked.withColumn("broken", F.filter("broken", lambda x: ~((x == "date_shape") & (F.coalesce(F.col("fecha"), F.lit("")) == ""))))
    good, bad = checked.where(F.size("broken") == 0).drop("broken", "penalised"), checked.where(F.size("broken") > 0)
    by = ["analysis_id", "category"]
    categories = consolidate.category_confidence(good, by).join(consolidate.aggregate_status(good, by), by)
    dates = consolidate.conflicts(good.where("category = 'plazos_clave'"), [*by, "tipo"], ["fecha"])
    amounts = consolidate.conflicts(good.where("category = 'garantias'"), [*by, "tipo"], ["monto_porcentaje", "monto_valor"])
    return good, bad, categories, dates.unionByName(amounts)


def confidence_avg(categories: DataFrame, by: str = "analysis_id") -> DataFrame:
    """Mean confidence of the categories that succeeded, three decimals; null without any."""
    return categories.groupBy(by).agg(F.round(F.avg(F.when(F.col("status") == "success", F.col("confidence"))), 3).alias("confidence_avg"))


def document_labels(documents: DataFrame) -> DataFrame:
    """document_id, name, is_primary, and whether its analysis has one principal."""
    n = documents.groupBy("analysis_id").agg(F.count_if("is_primary").alias("n_primary"))
    out = documents.join(n, "analysis_id")
    return out.select("analysis_id", "document_id", F.col("filename").alias("name"), "is_primary", (F.col("n_primary") == 1).alias("one_primary"))


def stamp_names(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds filename and is_primary to every reference of every item.

    The labels of an analysis' documents (ten at most) travel as one map per
    analysis, so references are not exploded.
    """
    maps = labels.groupBy("analysis_id").agg(F.map_from_entries(F.collect_set(F.struct("document_id", F.struct("name", "is_primary")))).alias("__m"))
    stamped = F.transform("source_references", lambda r: r.withField("filename", F.try_element_at("__m", r["document_id"])["name"]).withField("is_primary", F.try_element_at("__m", r["document_id"])["is_primary"]))
    return items.join(maps, "analysis_id", "left").withColumn("source_references", F.when(F.col("__m").isNull(), F.transform("source_references", lambda r: r.withField("filename", F.lit(None).cast("string")).withField("is_primary", F.lit(None).cast("boolean")))).otherwise(stamped)).drop("__m")


STATE = {"success": "found", "partial": "partial", "not_applicable": "not_applicable", "not_found": "missing", "failed": "failed"}


def display(items: DataFrame) -> DataFrame:
    """One shape for old and new items: field_state, display_value, level."""
    state = F.create_map(*[F.lit(x) for kv in STATE.items() for x in kv])[F.lower(F.coalesce("extraction_status", F.lit("not_found")))]
    percent = F.when(F.col("monto_porcentaje").isNotNull(), F.format_string("%s %%", F.col("monto_porcentaje").cast("string")))
    amount = F.when(F.col("monto_valor").isNotNull(), F.concat_ws(" ", "moneda", F.format_number("monto_valor", 2)))
    full = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    when = F.when(full("fecha").isNotNull(), F.concat_ws(" ", full("fecha"), full("hora")))
    value = F.coalesce(full("valor"), when, full("expresion_relativa"), percent, amount, full("texto_original"), F.lit("-"))
    return items.withColumn("field_state", F.coalesce(state, F.lit("missing"))).withColumn("display_value", value).withColumn("level", consolidate.confidence_level(F.coalesce("confidence", F.lit(0.0))))


def status_view(analyses: DataFrame) -> DataFrame:
    """What a client polls: state, progress, its label, whether it has ended."""
    from folioforge.operators.catalog import TERMINAL

    label = F.concat_ws(" ", F.coalesce("current_stage", F.lit("queued")), F.concat(F.col("progress").cast("string"), F.lit(" %")))
    return analyses.select("analysis_id", "status", "current_stage", "progress", label.alias("label"), F.col("status").isin(*TERMINAL).alias("ended"), "timeout_at")
