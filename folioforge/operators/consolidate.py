"""Items of one fact: canonical types, merging, confidence, conflicts, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import collapse, grounding_form, null_if_empty

ABSENT = "∅"
STATUS = ("success", "partial", "not_applicable", "not_found", "failed")


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[Sequence[str]]]], otherwise: str | None) -> Column:
    """The first rule of which some group of words is wholly in the folded text."""
    form = grounding_form(F.coalesce(text, F.lit("")))
    out = None
    for name, groups in rules:
        hit = F.lit(False)
        for words in groups:
            every = F.lit(True)
            for w in words:
                every = every & F.contains(form, F.lit(w))
            hit = hit | every
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(form == "", otherwise).otherwise(out.otherwise(otherwise))


# Types and the words (folded) that stand for them, in order.
DEADLINES = (
    ("respuesta_consultas", [("respuesta", "consulta")]),
    ("consultas", [("consulta",)]),
    ("visita_lugar", [("visita", "obra")]),
    ("apertura_ofertas", [("apertura",)]),
    ("mantenimiento_oferta", [("mantenimiento", "oferta")]),
    ("adjudicacion", [("adjudic",)]),
    ("firma_contrato", [("firma", "contrato")]),
    ("impugnacion", [("impugn",)]),
    ("plazo_ejecucion", [("ejecucion",), ("entrega",), ("provision",), ("suministro",)]),
    ("presentacion_ofertas", [("fecha limite de presentacion",), ("presentacion", "oferta"), ("recepcion", "oferta")]),
)
GUARANTEES = (
    ("cumplimiento_contrato", [("cumplimiento", "contrato")]),
    ("anticipo", [("anticipo",)]),
    ("mantenimiento_oferta", [("mantenimiento",), ("seriedad",), ("garantia", "oferta"), ("caucion", "oferta"), ("fianza", "oferta")]),
)
IDENTITIES = (
    ("organismo_convocante", [("organismo",), ("convocante",)]),
    ("expediente", [("expediente",)]),
    ("presupuesto_oficial", [("presupuesto",)]),
    ("jurisdiccion", [("jurisdicc",)]),
    ("denominacion", [("denomina",), ("nombre del llamado",), ("nombre_del_llamado",)]),
    ("tipo_procedimiento", [("proced", "tipo")]),
    ("numero_procedimiento", [("proced",)]),
)
CAUSES = (
    ("formal", [("formal",), ("document",), ("garantia",), ("presentacion",), ("termino",)]),
    ("tecnica", [("tecnic",), ("especificacion",), ("muestra",)]),
    ("economica", [("econom",), ("precio",), ("cotizacion",)]),
    ("legal", [("legal",), ("inhabilit",), ("registro",), ("juridic",)]),
)
MORE_CAUSES = (("etica", [("etica",), ("conflicto",), ("corrup",), ("integridad",)]),)
RISKS = (
    ("incumplimiento", [("incumplimiento",), ("incumplir",), ("falta",), ("omision",)]),
    ("plazos", [("plazo",), ("demora",), ("retraso",), ("vencimiento",), ("termino",)]),
    ("economico", [("econom",), ("financier",), ("multa",), ("penaliza",), ("sancion monetaria",), ("pago",)]),
    ("tecnico", [("tecnic",), ("especificacion",), ("calidad",), ("norma tecnica",)]),
    ("legal_contractual", [("legal",), ("contractual",), ("juridic",), ("rescision",), ("clausula",)]),
    ("operativo", [("operativ",), ("gestion",), ("administra",), ("logistic",)]),
    ("ejecucion", [("ejecucion",), ("ejecutar",), ("cumplir contrato",), ("entrega",)]),
)


def deadline_type(c: Column) -> Column:
    return first_rule(c, DEADLINES, "otro")


def guarantee_type(c: Column) -> Column:
    return first_rule(c, GUARANTEES, "otra")


def identity_type(c: Column) -> Column:
    """Null for what is no known type."""
    form = grounding_form(F.coalesce(c, F.lit("")))
    return F.when(form.isin(*[name for name, _ in IDENTITIES]), form).otherwise(first_rule(c, IDENTITIES, None))


def cause_type(c: Column, strict: bool = False) -> Column:
    """``strict`` leaves what the four kinds don't cover without a type."""
    blank = F.when(grounding_form(F.coalesce(c, F.lit(""))) == "", "otra")
    return F.coalesce(blank, first_rule(c, CAUSES, None) if strict else first_rule(c, CAUSES + MORE_CAUSES, "otra"))


def risk_type(c: Column) -> Column:
    return first_rule(c, RISKS, "otro_explicito")


def deadline_key(fecha: Column, expression: Column, text: Column) -> Column:
    raw = F.coalesce(null_if_empty(fecha), null_if_empty(expression), null_if_empty(text), F.lit(""))
    return collapse(F.regexp_replace(grounding_form(raw), r"\([\p{L}\p{N}_]+\)", ""))


def guarantee_key(percent: Column, amount: Column) -> Column:
    show = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat(show(percent), F.lit("|"), show(amount))


def value_key(value: Column) -> Column:
    return collapse(F.lower(F.coalesce(value, F.lit(""))))


def merge_items(items: DataFrame, key: Sequence[str], fields: Sequence[str], order: str = "item_no") -> DataFrame:
    """One row per key: the best item, empty fields filled from the others.

    Best: success first, then confidence, then order.  ``fields`` (strings or
    numbers) that are null or empty take the first value in order that is not.
    References of all items are joined in order and deduped by document, page and
    folded citation.  Adds first_no, n_merged.
    """
    rank = F.struct((F.col("extraction_status") == "success").cast("int").alias("s"), F.coalesce("confidence", F.lit(0.0)).alias("c"), (-F.col(order)).alias("o"))
    full = lambda f: (F.col(f).isNotNull()) & (F.col(f).cast("string") != "")
    aggs = [F.min(order).alias("first_no"), F.count("*").alias("n_merged"), F.max_by("extraction_status", rank).alias("extraction_status"), F.max_by("confidence", rank).alias("confidence")]
    for f in fields:
        own = F.max_by(F.when(full(f), F.col(f)), rank)
        aggs.append(F.coalesce(own, F.min_by(F.when(full(f), F.col(f)), F.when(full(f), F.col(order)))).alias(f))
    if "source_references" in items.columns:
        aggs.append(F.flatten(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("source_references").alias("r")))).getField("r")).alias("source_references"))
    out = items.groupBy(*key).agg(*aggs)
    return out.withColumn("source_references", dedupe_references(F.col("source_references"))) if "source_references" in items.columns else out


def dedupe_references(refs: Column) -> Column:
    """First of each (document, page, folded citation), order kept."""
    mark = lambda r: F.concat_ws("\x1f", F.coalesce(r["document_id"], F.lit("")), F.coalesce(r["page_number"], F.lit(0)).cast("string"), grounding_form(F.coalesce(r["citation"], F.lit(""))))
    marks = F.transform(refs, mark)
    return F.filter(refs, lambda r, i: F.array_position(marks, F.get(marks, i)) == i + 1)


def evidence_confidence(n_refs: Column, status: Column) -> Column:
    """From the evidence alone: none .3, one .7, more .8; partial .2 less."""
    base = F.when(n_refs == 0, 0.3).when(n_refs == 1, 0.7).otherwise(0.8)
    out = (
        F.when(status.isin("failed", "not_found"), 0.0)
        .when(status == "not_applicable", F.when(n_refs > 0, 0.7).otherwise(0.0))
        .when(status == "partial", F.greatest(F.lit(0.0), base - 0.2))
        .otherwise(base)
    )
    return F.round(out, 2)


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.8, "alta").when(c >= 0.6, "media").otherwise("baja")


def category_confidence(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of the confidences above zero; 0 without any."""
    c = F.col("confidence")
    return items.groupBy(*by).agg(F.coalesce(F.round(F.avg(F.when(c > 0, c)), 2), F.lit(0.0)).alias("confidence"))


def aggregate_status(items: DataFrame, by: Sequence[str]) -> DataFrame:
    rank = F.array_position(F.lit(list(STATUS)), F.col("extraction_status"))
    known = F.when(rank > 0, rank)
    return items.groupBy(*by).agg(F.coalesce(F.min_by("extraction_status", known), F.lit("unknown")).alias("status"))


def conflicts(items: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Types with several items whose values differ; null is a value of its own."""
    shown = F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit(ABSENT)) for v in values])
    out = items.groupBy(*by).agg(F.count("*").alias("n_items"), F.count_distinct(shown).alias("n_values"))
    return out.where("n_items > 1 and n_values > 1")


def enforce_citations(items: DataFrame, least: int = 12, most: int = 120) -> DataFrame:
    """References keep only usable citations; items without any are dropped.

    Adds penalised: a success left without a long enough citation was made
    partial before (and is dropped here unless another reference remains).
    """
    usable = F.filter("source_references", lambda r: F.length(F.trim(F.coalesce(r["citation"], F.lit("")))).between(least, most))
    some = F.exists("source_references", lambda r: F.length(F.trim(F.coalesce(r["citation"], F.lit("")))) >= least)
    out = items.withColumn("penalised", ~F.coalesce(some, F.lit(False)) & (F.col("extraction_status") == "success")).withColumn("source_references", usable)
    out = out.withColumn("extraction_status", F.when(F.col("penalised"), "partial").otherwise(F.col("extraction_status")))
    return out.where(F.size("source_references") > 0)


def validate(items: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds broken: the names of the rules that an item breaks (null counts as kept)."""
    marks = [F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules.items()]
    return items.withColumn("broken", F.filter(F.array(*marks), lambda x: x.isNotNull()))


def amount_rules() -> dict[str, Column]:
    return {
        "percent_range": F.col("monto_porcentaje").between(0, 100),
        "percent_or_amount": ~(F.col("monto_porcentaje").isNotNull() & F.col("monto_valor").isNotNull()),
        "confidence_range": F.col("confidence").between(0, 1),
        "date_shape": F.length(F.regexp_replace("fecha", "[^-]", "")) == 2,
        "has_source": F.size("source_references") > 0,
    }


def contamination(items: DataFrame, exclusive: DataFrame) -> DataFrame:
    """Adds foreign_term: the first term of another category in type and value.

    ``exclusive``: category_no, category, term_no, term (a small table of checked
    size is broadcast by the planner).  Letters keep their marks.
    """
    key = ["analysis_id", "category", "item_no"]
    text = F.lower(F.concat_ws(" ", "tipo", "valor"))
    terms = exclusive.select(F.col("category").alias("__other"), "category_no", "term_no", "term")
    hit = items.select(*key, text.alias("__t")).join(terms, (F.col("category") != F.col("__other")) & F.contains(F.col("__t"), F.lower("term")))
    first = hit.groupBy(*key).agg(F.min_by(F.struct(F.col("__other").alias("category"), "term"), F.struct("category_no", "term_no")).alias("foreign_term"))
    return items.join(first, key, "left")


def mixed_not_found(items: DataFrame, by: Sequence[str], substantive: Column) -> DataFrame:
    """Where a category has findings, a not_found with content is partial and
    one without is dropped."""
    w = Window.partitionBy(*by)
    missing = F.col("extraction_status") == "not_found"
    out = items.withColumn("__any", F.max((~missing).cast("int")).over(w)).withColumn("__sub", substantive)
    out = out.where(~(missing & (F.col("__any") == 1) & ~F.col("__sub")))
    return out.withColumn("extraction_status", F.when(missing & (F.col("__any") == 1), "partial").otherwise(F.col("extraction_status"))).drop("__any", "__sub")


def token_cost(prompt: Column, completion: Column) -> Column:
    """In dollars, at fixed prices per thousand tokens."""
    return F.round(prompt / 1000 * 0.00015 + completion / 1000 * 0.0006, 8)
