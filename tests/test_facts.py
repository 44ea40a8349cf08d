import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions import plain, text
from folioforge.operators import catalog, classify, consolidate, extract, geometry, ground, narrative, retrieve, tracking
from folioforge.sources import schemas


def values(spark, expr, col="x"):
    return spark.range(1).select(expr.alias(col)).first()[0]


def lit(x):
    return F.lit(x)


def test_normal_forms(spark):
    assert values(spark, text.matching_form(lit("  Garantía, de-la  OFERTA: ñ_1 "))) == "garantia de la oferta n_1"
    assert values(spark, text.search_form(lit("a – b—c"))) == "a - b-c"
    assert values(spark, text.alnum_form(lit("Nº 12/ÁB"))) == "no12ab"
    for t, want in (("12.000.000", "12000000"), ("12000000.0", "12000000"), ("3,50", "35"), ("AR$ 7", "7"), ("1.234,", "1234"), ("", "")):
        assert values(spark, text.canonical_number(lit(t))) == want == plain.canonical_number(t)
    assert values(spark, text.page_number(lit("pág. 12 y 13"))) == 12 and values(spark, text.page_number(lit("x"))) == 0
    assert values(spark, text.redact(lit("api_key=abc, token: t1; sig=zz&x password = p AccountKey=q;"))) == "api_key=***, token: ***; sig=***&x password = *** AccountKey=***;"
    assert values(spark, text.strip_query(lit("https://h/p?a=1&b=2#f"))) == "https://h/p#f"


def test_term_matching(spark):
    m = lambda t, *terms: values(spark, classify.matches(lit(t), terms))
    assert m("La garantía de oferta", "garantía de oferta") == 1 and m("oferta de garantía", "garantia de oferta") == 0
    assert m("anexos", "anexo") == 0 and m("Anexo, y otro", "anexo", "ANEXO") == 1
    s = lambda n, words, w=1.0: values(spark, classify.density_score(lit(n), lit(words), w))
    assert s(1, 50) == 0.25 and s(4, 50) == 1.0 and s(4, 800) == 0.5 and s(0, 5) == 0.0 and s(4, 50, 2.0) == 1.0
    g = (classify.Category("a", ("uno",), ("plazo", "entrega")), classify.Category("b", ("dos",), ("garantia",)))
    h = lambda *p: values(spark, classify.heading_category(F.array(*map(lit, p)), g))
    assert h("GARANTÍAS", "Plazo de entrega") == "a" and h("Garantía", "otro") == "b" and h("nada") is None and h("garantia y plazo") == "b"


def test_relevance_and_budget(spark):
    def cut(scores):
        df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores)], "query_id int, rank int, score double")
        return [r["rank"] for r in retrieve.relevance_cut(df).orderBy("rank").collect()]

    assert len(cut([0.032 - 0.0005 * i for i in range(10)] + [0.005] * 20)) == 10
    assert len(cut([0.01] * 30)) == 30 and len(cut([0.01] * 10)) == 10 and len(cut([None] * 30)) == 30
    assert len(cut([1.0] + [0.001] * 29)) == 10 and 25 in cut([1.0] + [0.001] * 24 + [None])
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([20_000, 5, 5])], "query_id int, rank int, token_count int")
    assert retrieve.token_budget(df).count() == 1
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate([10_000, 7_000, 5])], "query_id int, rank int, token_count int")
    assert retrieve.token_budget(df).count() == 1


def test_hybrid(spark):
    chunks = spark.createDataFrame([(i, t, [float(i == 0), float(i == 1)]) for i, t in enumerate(["garantia de oferta", "plazo de entrega", "otra cosa"])], "id int, content string, embedding array<double>")
    q = spark.createDataFrame([(1, "garantía", [1.0, 0.0]), (2, "inexistente", None)], "query_id int, query string, query_vec array<double>")
    got = retrieve.hybrid(q, chunks, 2).orderBy("query_id", "rank").collect()
    assert got[0].id == 0 and got[0].overlap == 1 and [r.id for r in got if r.query_id == 2] == [0, 1, 2]


def test_parents(spark):
    chunks = spark.createDataFrame([("p", None), ("c1", "p"), ("c2", "p"), ("lost", "gone")], "id string, parent_id string")
    hits = spark.createDataFrame([(1, x, 1.0 - i / 10, i + 1) for i, x in enumerate(["c2", "p", "lost", "c1"])], "query_id int, id string, score double, rank int")
    got = retrieve.expand_parents(hits, chunks, 3).orderBy("rank").collect()
    assert [(r.id, r.matched_id, r.score) for r in got] == [("p", "c2", 1.0), ("lost", "lost", 0.8)]


def chunk_df(spark):
    rows = [("d", 1, 0, "k0", "El plazo de entrega será de 30 días.", None), ("d", 1, 1, "k1", "El  PLAZO de entrega\nsera de 30 dias. Y más.", None), ("d", 2, 2, "k2", "Item: tornillo\nCantidad: 40", ("t", 3, ["Item", "Cantidad"]))]
    return spark.createDataFrame(rows, f"document_id string, page_number int, chunk_index int, id string, content string, table_ref {schemas.TABLE_REF}")


def test_grounding(spark):
    cites = ["plazo de entrega SERÁ de 30", "corto", "una cita que nadie escribió", "Encabezado: Item | Fila: 3 | Valor: Tornillo", "Encabezado: Item | Fila: 2 | Valor: tornillo", "Encabezado: Otra | Fila: 3 | Valor: tornillo"]
    pages = [1, 1, 1, 2, 2, 2]
    refs = spark.createDataFrame([("a", "plazos_clave", i, 0, "d", p, c) for i, (c, p) in enumerate(zip(cites, pages))], "analysis_id string, category string, item_no int, ref_no int, document_id string, page_number int, citation string")
    done = ground.verify_references(refs, chunk_df(spark))
    assert {r.item_no: r.chunk_id for r in done.collect()} == {0: "k0", 1: None, 2: None, 3: "k2", 4: None, 5: None}
    items = spark.createDataFrame([("a", "plazos_clave", i, "success", "x", "plazo de entrega será" if i == 2 else None) for i in range(6)], "analysis_id string, category string, item_no int, extraction_status string, valor string, texto_original string")
    saved = ground.rescue(done, items, chunk_df(spark))
    assert {r.item_no for r in saved.where("rescued").collect()} == {2}
    states = {r.item_no: (r.extraction_status, r.warning) for r in ground.item_status(saved, items).collect()}
    assert states[0] == ("success", None) and states[1] == ("partial", "citation_unverified") and states[2] == ("partial", "citation_rescued")


def test_citation_shapes(spark):
    long = "palabra " * 30
    assert len(values(spark, ground.clip(lit(long)))) <= 120 and values(spark, ground.clip(lit(long))) == ground.clip_text(long)
    assert ground.clip_text("x" * 200) == "x" * 120 == values(spark, ground.clip(lit("x" * 200)))
    content = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce"
    at = content.find("cinco")
    wide = ground.widen(content, at, at + 5, 40)
    assert "cinco" in wide and 40 <= len(wide) <= 120 and wide in content
    text_ = "relleno " * 20 + "monto de $ 12.000.000 finales " + "cola " * 20
    cut = ground.shorten_text(text_, "12000000.0 ARS")
    assert "12.000.000" in cut and len(cut) <= 120
    assert ground.anchor("Municipalidad x Jurisdicción: Municipal", "Municipal") == 30


def test_split_facts(spark):
    rows = [("a", "c", 0, False, ["1"]), ("a", "c", 1, True, ["1", "2"]), ("a", "c", 2, False, ["2"]), ("a", "c", 3, True, ["2"]), ("a", "x", 0, True, None)]
    df = spark.createDataFrame(rows, "analysis_id string, category string, item_no int, weak boolean, chunk_ids array<string>")
    got = {(r.category, r.item_no): r.group_no for r in ground.merge_split_facts(df).collect()}
    assert got == {("c", 0): 0, ("c", 1): 0, ("c", 2): 2, ("c", 3): 0, ("x", 0): 0}


def folded(rows):
    """The fold as it is stated: earlier groups are looked at one after the other."""
    groups, out = {}, set()
    for a, c, no, weak, chunks in sorted(rows, key=lambda x: x[2]):
        mine, own = groups.setdefault((a, c), []), set(chunks or ())
        g = next((g for g in mine if g[0] & own and (g[1] or weak)), None)
        if g is None:
            mine.append(g := (set(), weak, no))
        g[0].update(own)
        out.add((a, c, no, g[2]))
    return out


@pytest.mark.parametrize("most", [1, 3])
def test_split_facts_are_the_fold(spark, most):
    r = random.Random(most)
    rows = []
    for no in range(3000):
        pool = r.choice([4, 60, 900])
        chunks = [r.choice(["hot", f"{pool}-{r.randrange(pool)}"]) if pool > 4 else f"{pool}-{r.randrange(pool)}" for _ in range(r.choice([0, 1, 1, 1, most]))]
        rows.append((r.choice(["a", "b", None]), r.choice("xy"), no, r.random() < 0.3, chunks if r.random() < 0.98 else None))
    df = spark.createDataFrame(rows, "analysis_id string, category string, item_no int, weak boolean, chunk_ids array<string>").repartition(5)
    got = ground.merge_split_facts(df).collect()
    assert len(got) == len(rows) and {tuple(x) for x in got} == folded(rows)


def test_split_facts_query_has_every_line(spark):
    from folioforge.plans import layouts

    d = "/root/testdata/sf0.001"
    assert layouts.split_facts(spark, d).agg({"n_items": "sum"}).first()[0] == spark.read.parquet(f"{d}/lineitem.parquet").count()


def test_types(spark):
    t = lambda f, x: values(spark, f(lit(x)))
    assert t(consolidate.deadline_type, "Respuesta a Consultas") == "respuesta_consultas" and t(consolidate.deadline_type, "Plazo de Ejecución") == "plazo_ejecucion" and t(consolidate.deadline_type, "") == "otro"
    assert t(consolidate.guarantee_type, "Garantía de la oferta") == "mantenimiento_oferta" and t(consolidate.guarantee_type, "x") == "otra"
    assert t(consolidate.identity_type, "tipo de procedimiento") == "tipo_procedimiento" and t(consolidate.identity_type, "zzz") is None
    assert t(consolidate.cause_type, "Conflicto de interés") == "etica" and values(spark, consolidate.cause_type(lit("nada"), strict=True)) is None
    assert t(consolidate.risk_type, "Multa por demora") == "plazos"
    assert values(spark, consolidate.deadline_key(lit(""), lit("12 (doce)  Meses"), lit(None))) == "12 meses"


REFS = "array<struct<document_id:string,page_number:int,citation:string>>"


def test_merging_items(spark):
    rows = [(1, "k", "partial", 0.9, "", 5.0, [("d", 1, "Una cita larga")]), (2, "k", "success", 0.7, "v2", None, [("d", 1, "UNA  cita larga"), ("d", 2, "otra cita mas")]), (3, "k", "success", 0.7, "v3", 7.0, [])]
    df = spark.createDataFrame(rows, f"item_no int, key string, extraction_status string, confidence double, valor string, monto double, source_references {REFS}")
    r = consolidate.merge_items(df, ["key"], ["valor", "monto"]).first()
    assert (r.extraction_status, r.confidence, r.valor, r.monto, r.n_merged, r.first_no) == ("success", 0.7, "v2", 5.0, 3, 1)
    assert [(x.page_number, x.citation) for x in r.source_references] == [(1, "Una cita larga"), (2, "otra cita mas")]
    kept = consolidate.enforce_citations(df).collect()
    assert [x.item_no for x in kept] == [1, 2]


def test_confidence_and_conflicts(spark):
    c = lambda n, s: values(spark, consolidate.evidence_confidence(lit(n), lit(s)))
    assert [c(0, "success"), c(1, "success"), c(3, "success"), c(1, "partial"), c(2, "failed"), c(0, "not_applicable"), c(1, "not_applicable")] == [0.3, 0.7, 0.8, 0.5, 0.0, 0.0, 0.7]
    rows = [("a", "x"), ("a", None), ("b", "x"), ("b", "x"), ("c", "x")]
    df = spark.createDataFrame(rows, "tipo string, fecha string")
    assert [r.tipo for r in consolidate.conflicts(df, ["tipo"], ["fecha"]).collect()] == ["a"]
    items = spark.createDataFrame([("k", "not_found", "v"), ("k", "not_found", ""), ("k", "success", "w"), ("z", "not_found", "")], "category string, extraction_status string, valor string")
    got = sorted((r.category, r.extraction_status, r.valor) for r in consolidate.mixed_not_found(items, ["category"], F.col("valor") != "").collect())
    assert got == [("k", "partial", "v"), ("k", "success", "w"), ("z", "not_found", "")]
    assert {r.category: r.status for r in consolidate.aggregate_status(items, ["category"]).collect()} == {"k": "success", "z": "not_found"}
    bad = spark.createDataFrame([(120.0, None, 0.5, "2020-01-02", 1), (5.0, 9.0, 2.0, "ayer", 0)], "monto_porcentaje double, monto_valor double, confidence double, fecha string, n int").withColumn("source_references", F.when(F.col("n") > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    assert [r.broken for r in consolidate.validate(bad, consolidate.amount_rules()).collect()] == [["percent_range"], ["percent_or_amount", "confidence_range", "date_shape", "has_source"]]
    terms = spark.createDataFrame([(0, "plazos", 0, "vencimiento"), (1, "garantias", 0, "póliza")], "category_no int, category string, term_no int, term string")
    it = spark.createDataFrame([("a", "plazos", 1, "tipo", "una PÓLIZA"), ("a", "plazos", 2, "t", "vencimiento")], "analysis_id string, category string, item_no int, tipo string, valor string")
    assert {r.item_no: r.foreign_term and r.foreign_term.term for r in consolidate.contamination(it, terms).collect()} == {1: "póliza", 2: None}


def test_rule_extractor(spark):
    rows = [("a", "d", 2, 1, "Organismo: Ministerio de Obras Objeto: puente"), ("a", "d", 1, 0, "Expediente: EX-2020-77 y Licitación Pública N° 12/2020 para obras"), ("a", "d", 3, 2, "Expediente: OTRO-2021-1 Presupuesto oficial: a definir")]
    df = spark.createDataFrame(rows, "analysis_id string, document_id string, page_number int, chunk_index int, content string")
    got = {r.tipo: r.valor for r in extract.rule_facts(df).collect()}
    assert got == {"organismo_convocante": "Ministerio de Obras", "expediente": "EX-2020-77", "tipo_procedimiento": "Licitación Pública", "numero_procedimiento": "Licitación Pública N° 12/2020"}
    known = spark.createDataFrame([("a", "expediente")], "analysis_id string, tipo string")
    assert "expediente" not in {r.tipo for r in extract.rule_facts(df, known).collect()}


def test_extractor_and_embedder(spark):
    def model(category, chunks):
        if category == "bad":
            raise RuntimeError("down")
        return [{"tipo": "x", "valor": c["content"], "confidence": 7, "extraction_status": "?", "source_references": []} for c in chunks]

    work = spark.createDataFrame([("a", "good", [("uno",), ("dos",)]), ("a", "bad", [("x",)])], "analysis_id string, category string, chunks array<struct<content:string>>")
    out = extract.run_extractor(work, model, wait=0.0)
    assert {r.category: r.status for r in out.collect()} == {"good": "success", "bad": "failed"}
    items = extract.normalise_items(out, ["analysis_id", "category"]).collect()
    assert [(r.valor, r.confidence, r.extraction_status) for r in items] == [("uno", None, "not_found"), ("dos", None, "not_found")]
    chunks = spark.createDataFrame([("t", "c"), (None, "c")], "title string, content string")
    a, b = extract.embed(chunks, extract.HashEmbedder(8), 8).collect()
    assert [r.embedding for r in extract.embed(chunks, lambda texts: [[0.0]] * len(texts), 8, strict=False).collect()] == [None, None]
    assert len(a.embedding) == 8 and a.embedding != b.embedding and extract.batch_size(3000) == 6 and extract.batch_size(50_000) == 1


def test_narrative(spark):
    ref = [("d", 1, "una cita bastante larga", None, "k1")]
    items = spark.createDataFrame([("c", 0, ref), ("c", 1, [("d", 1, "una  CITA bastante larga", None, "k1"), ("d", 2, "otra cita distinta", None, "k2")])], f"category string, item_no int, source_references array<{schemas.REFERENCE.removeprefix('')}>")
    elements = spark.createDataFrame([("c", 0, 0, "x", [0, 99]), ("c", 0, 1, "y", [1]), ("c", 1, 0, "z", [77])], "category string, block_no int, element_no int, text string, item_refs array<int>")
    evidence = spark.createDataFrame([("c", 0, "otra cita distinta", [1])], "category string, evidence_no int, text string, item_refs array<int>")
    out, sources = narrative.resolve(elements, evidence, items)
    assert {r.text: r.source_ids for r in out.collect()} == {"x": [0], "y": [0, 1]}
    assert [(r.source_id, r.page_number) for r in sources.orderBy("source_id").collect()] == [(0, 1), (1, 2)]
    rows = spark.createDataFrame([("d", 1, 0, "corta cita"), ("d", 1, 1, "una corta cita más"), ("d", 1, 2, "distinta")], "document_id string, page_number int, source_id int, citation string")
    assert {r.source_id: r.kept_id for r in narrative.contained_once(rows).collect()} == {0: 0, 1: 0, 2: 2}


def test_geometry(spark):
    words = spark.createDataFrame([("d", 1, i, t) for i, t in enumerate("La Garan- tía de oferta. la garantía de OFERTA".split())], "document_id string, page_number int, word_no int, text string")
    cites = spark.createDataFrame([("q", "d", 1, "garantía de oferta"), ("none", "d", 1, "zzz")], "citation_id string, document_id string, page_number int, citation string")
    assert sorted(tuple(r) for r in geometry.word_hits(words, cites).collect()) == [("q", 0, 1, 4), ("q", 1, 6, 8)]
    lines = spark.createDataFrame([("q", 0, 10.0, 5.0, 100.0, 8.0, "abcdefghij"), ("q", 1, 10.0, 15.0, 50.0, 8.0, "klmno")], "citation_id string, line_no int, x double, y double, width double, height double, t string")
    got = geometry.line_regions(lines, spark.createDataFrame([("q", "HIJ kl")], "citation_id string, citation string")).orderBy("line_no").collect()
    assert [tuple(r)[2:] for r in got] == [(80.0, 5.0, 30.0, 8.0), (10.0, 15.0, 20.0, 8.0)]
    rects = spark.createDataFrame([("q", i, *r) for i, r in enumerate([(0.0, 0.0, 10.0, 10.0), (15.0, 1.0, 5.0, 10.0), (0.0, 12.0, 5.0, 10.0), (0.0, 80.0, 5.0, 10.0)])], "citation_id string, rect_no int, x double, y double, width double, height double")
    occ = geometry.group_occurrences(rects)
    assert [r.occurrence for r in occ.orderBy("rect_no").collect()] == [0, 0, 0, 1]
    reg = {r.occurrence: len(r.regions) for r in geometry.regions(occ, ["citation_id", "occurrence"]).collect()}
    assert reg == {0: 2, 1: 1}
    hints = spark.createDataFrame([("q", "d", 1, "Artículo 9: Garantías finales")], "citation_id string, document_id string, page_number int, section_hint string")
    heads = spark.createDataFrame([("d", 1, "GARANTÍAS FINALES", 0.0, 70.0)], "document_id string, page_number int, text string, x double, y double")
    assert geometry.pick_occurrences(occ, heads, hints).first().occurrence == 1
    assert geometry.choose_occurrence([{"x": 0, "y": 9}, {"x": 0, "y": 3}], [], None) == 1
    frag = lambda f, c: values(spark, geometry.is_fragment(lit(f), lit(c)))
    assert frag("oferta", "la oferta única") and not frag("ofer", "la oferta") and not frag("la", "la oferta")


def test_catalog(spark):
    t = dt.datetime
    made = [("a1", "Puente", "u", "completed", t(2024, 1, 5, 23, 30), False), ("a2", "Ruta", "u", "draft", t(2024, 1, 6), False), ("a3", "Old", "u", "completed", t(2023, 1, 1), True), ("a4", "x", "v", "completed", t(2024, 1, 5), False), ("a5", "Canal", "u", "analyzed", t(2024, 2, 1), False)]
    analyses = spark.createDataFrame(made, "analysis_id string, analysis_name string, created_by string, status string, created_at timestamp, deleted boolean")
    docs = spark.createDataFrame([("d1", "a1", "Pliego_100%.pdf", "h", "u", False), ("d2", "a2", "b.pdf", "h", "u", False), ("d3", "a5", "c.pdf", "h", "u", None), ("d4", "a4", "d.pdf", "h", "v", False)], "document_id string, analysis_id string, filename string, content_hash string, created_by string, deleted boolean")
    ids = lambda **k: [r.analysis_id for r in catalog.list_analyses(analyses, docs, "u", **k).orderBy("created_at").collect()]
    assert ids() == ["a1", "a2", "a5"] and ids(status="draft") == ["a2"] and ids(date_to="2024-01-05") == ["a1"] and ids(date_from="2024-01-06") == ["a2", "a5"]
    assert ids(search="100%") == ["a1"] and ids(search=" CANAL ") == ["a5"] and ids(search="_1") == ["a1"] and ids(page=2, per_page=2) == ["a1"]
    assert catalog.list_analyses(analyses, docs, "u", per_page=1).first().total == 3
    dup = {r.document_id: r.duplicate_of for r in catalog.duplicates(docs, analyses).collect()}
    assert dup == {"d1": "a5", "d2": "a5", "d3": "a1"}
    found = spark.createDataFrame([("n1", "x", "a1"), ("n1", "y", "a5"), ("n2", "x", "a1"), ("n3", "x", "a1")], "analysis_id string, document_id string, duplicate_of string")
    dec = spark.createDataFrame([("n1", "x", "analyze_again"), ("n1", "y", "view_existing"), ("n2", "x", "cancel")], "analysis_id string, document_id string, decision string")
    assert {r.analysis_id: (r.outcome, r.redirect_to) for r in catalog.decide(found, dec).collect()} == {"n1": ("view", "a5"), "n2": ("cancel", None), "n3": ("ask", None)}
    # rows that repeat count once each; without any decision nothing is known to be cancelled
    again = catalog.decide(found.union(found), dec.union(dec))
    assert {r.analysis_id: (r.outcome, r.cancelled) for r in again.collect()} == {"n1": ("view", 0), "n2": ("cancel", 2), "n3": ("ask", None)}
    stop = lambda s, c, p, late: tuple(values(spark, catalog.stop_check(lit(s), lit(c), lit(1), lit(2 if late else 0), lit(p))))
    assert stop("completed", True, 100, True) == (True, "completed", 100) and stop("analyzing", True, 10, True) == (True, "cancelled", 35)
    assert stop("analyzing", False, 99, True) == (True, "error", 95) and stop("analyzing", None, 50, False) == (False, "analyzing", 50)
    store = spark.createDataFrame([("k", "1", "e1"), ("l", "1", "e2")], "id string, v string, etag string")
    writes = spark.createDataFrame([("k", "2", "e1"), ("l", "2", "old"), ("m", "2", None)], "id string, v string, etag string")
    new, bad = catalog.compare_and_put(store, writes, ["id"])
    assert {r.id: r.v for r in new.collect()} == {"k": "2", "l": "1", "m": "2"} and [r.id for r in bad.collect()] == ["l"]
    # of two writes of one key with the same etag one is applied; null is not the empty text
    twice = spark.createDataFrame([("k", "2", "e1"), ("k", "3", "e1"), ("n", None, None), ("n", "", None), ("l", "9", "e2")], "id string, v string, etag string")
    new, bad = catalog.compare_and_put(store, twice, ["id"])
    kept = {r.id: (r.v, r.etag) for r in new.collect()}
    assert len(new.collect()) == 3 and kept["l"][0] == "9" and sorted(r.id for r in bad.collect()) == ["k", "n"]
    one, two = (catalog.compare_and_put(store.limit(0), spark.createDataFrame([x], store.schema), ["id"])[0].first().etag for x in (("n", None, None), ("n", "", None)))
    assert one != two
    assert catalog.date_preset("last_7_days", "2024-03-03") == ("2024-02-26", "2024-03-03") and catalog.date_preset("all", "2024-03-03") == (None, None)
    assert [values(spark, catalog.timeout_minutes(lit(p))) for p in (50, 51, 150, 201)] == [8, 12, 18, 25]


def test_tracking(spark):
    ev = spark.createDataFrame([("i", n, s) for n, s in enumerate(["closed", "closed", "not_reviewed", "in_review", "in_review", "closed"])], "item string, no int, target string")
    got = tracking.replay(ev, ["item"], ["no"], "target").orderBy("no").collect()
    assert [r.accepted for r in got] == [True, False, False, True, False, True] and got[-1].state == "closed"
    cats = spark.createDataFrame([("a", s) for s in ["closed"] * 3 + ["in_review"] + ["not_reviewed"] * 3], "analysis_id string, status string")
    assert tuple(tracking.summary(cats, "analysis_id").first()) == ("a", 3, 1, 3, 43)
    v = spark.createDataFrame([("v", "plazos", [("t", "x", "c", "d", 1), ("t", "x", "c", "d", 1)]), ("v", "otros", [("t", "x", "c", "d", 1)])], "version_id string, category_key string, items array<struct<tipo:string,valor:string,citation:string,document_id:string,page_number:int>>")
    ids = [r.tracking_item_id for r in tracking.seed(v, ["plazos"]).collect()]
    assert len(set(ids)) == 2 and all(len(i) == 24 for i in ids)


def test_duplicate_decisions_of_odd_orders_equal_sql(spark, tmp_path):
    import duckdb

    from folioforge import registry

    # an undecided customer, a repeated order, one that repeats with another status, null keys, and one below zero
    rows = [(5, 1, "P"), (3, 2, "F"), (3, 2, "F"), (2, 4, "O"), (2, 4, "O"), (10, 7, "P"), (10, 7, "F"), (None, 8, "F"), (8, None, "F"), (8, 9, "F"), (6, None, "O"), (-1, 11, "O")]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_orderstatus string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.sql(f"create view orders as select * from read_parquet('{tmp_path}/orders.parquet/*.parquet')")
    want = con.sql(registry.oracle_sql()["duplicate_decisions"])
    got = registry.queries()["duplicate_decisions"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
