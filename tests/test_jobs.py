from pyspark.sql import functions as F

from folioforge.operators.classify import Category
from folioforge.operators.extract import HashEmbedder
from folioforge.plans import jobs
from folioforge.sources import schemas, store


def test_ingest_to_index(spark, tmp_path):
    md = "# Pliego\n\nIntro.\n\n## Plazo de entrega\n\nEl plazo es de 30 días.\n\n## Garantía\n\nGarantía de oferta: 5 %."
    rows = [("d1", md, None), ("d2", None, "empty text")]
    layouts = spark.createDataFrame(rows, "document_id string, markdown string, error string")
    glossary = (Category("plazos", ("dias",), ("plazo",)), Category("garantias", ("oferta",), ("garantia",)))
    index, failed = jobs.ingest(layouts, "a", glossary, HashEmbedder(16), 16)
    assert [r.document_id for r in failed.collect()] == ["d2"]
    got = index.orderBy("chunk_index").collect()
    assert [(r.section_path, r.primary_category) for r in got] == [("Pliego", None), ("Pliego > Plazo de entrega", "plazos"), ("Pliego > Garantía", "garantias")]
    store.write_index(index, str(tmp_path / "i"))
    assert spark.read.parquet(str(tmp_path / "i")).count() == 3


def test_tables_and_boxes_reach_the_index(spark):
    md = "# Pliego\n\nEl plazo de entrega es de 30 días.\n\n<table>\n<tr><td>x</td></tr>\n</table>\n\nFin del documento."
    square = lambda x, y, w=2.0, h=0.5: [float(v) for v in (x, y, x + w, y, x + w, y + h, x, y + h)]
    rows = [
        (
            "d1",
            md,
            None,
            [(1, "inch", 8.0, 11.0)],
            [(1, 0, "Pliego", square(1.0, 1.0)), (1, 10, "El plazo de entrega es de 30 días.", square(1.0, 2.0)), (1, 90, "Fin del documento.", square(7.5, 9.0))],
            [("t", 0, 1)],
            [("t", 0, 0, "columnHeader", "Renglón", square(1, 3)), ("t", 0, 1, "columnHeader", "Precio", square(3, 3)), ("t", 1, 0, None, "Papel", square(1, 4)), ("t", 1, 1, None, "$ 5", square(3, 4))],
            [(1, "El plazo de entrega", square(1.1, 2.1, 1.0, 0.2)), (1, "elsewhere", square(5, 9))],
        )
    ]
    kinds = ", ".join(f"{n} {k}" for n, k in schemas.LAYOUT.items())
    layouts = spark.createDataFrame(rows, f"document_id string, markdown string, error string, {kinds}")
    blocks = {r.content: r for r in jobs.document_blocks(layouts).collect()}
    assert blocks["Pliego"].bbox[0].asDict() == {"page": 1, "x": 72.0, "y": 72.0, "width": 144.0, "height": 36.0} and blocks["Pliego"].para_id.idx == 0
    assert [x.t for x in blocks["El plazo de entrega es de 30 días."].lines] == ["El plazo de entrega"]
    assert blocks["Fin del documento."].bbox == []  # beyond the sheet
    row = blocks["Renglón: Papel\nPrecio: $ 5"]
    assert row.block_type == "table" and row.table_ref.asDict() == {"table_id": "t", "row_index": 2, "headers": ["Renglón", "Precio"]} and row.bbox[0].width == 4 * 72.0
    index, _ = jobs.ingest(layouts, "a", (Category("plazos", ("dias",), ("plazo",)),), HashEmbedder(16), 16)
    got = {r.block_type: r for r in index.collect()}
    assert got["table"].table_ref.headers == ["Renglón", "Precio"] and "Precio: $ 5" in got["table"].content and len(got["table"].blocks[0].bbox) == 1


def test_extractor_run(spark):
    md = "# Pliego\n\n## Plazo de entrega\n\nEl plazo de entrega es de 30 días corridos.\n\n## Garantía\n\nLa garantía de oferta es del 5 % del total."
    layouts = spark.createDataFrame([("d1", md, None), ("d2", "# Otro\n\nNada.", None)], "document_id string, markdown string, error string")
    glossary = (Category("plazos", ("plazo de entrega", "dias"), ("plazo",)), Category("garantias", ("oferta",), ("garantia",)))
    embedder = HashEmbedder(16)
    index, _ = jobs.ingest(layouts, "a", glossary, embedder, 16)
    asked = spark.createDataFrame([("a", "plazos", "plazo de entrega", embedder(["plazo de entrega"])[0]), ("a", "garantias", "garantía de oferta", None), ("a", "roto", "plazo", None)], "analysis_id string, category string, query string, query_vec array<double>")

    def model(category, chunks):
        if category == "roto":
            raise RuntimeError("no model")
        text = chunks[0]["content"]
        ref = {"document_id": chunks[0]["document_id"], "page_number": chunks[0]["page_number"], "citation": text if category == "plazos" else "una cita que nadie escribió"}
        return {"items": [{"tipo": "t", "valor": text, "confidence": 0.9, "extraction_status": "success", "source_references": [ref]}], "usage": {"input_tokens": 7, "completion_tokens": 2}}

    items, refs, runs = jobs.extract_facts(asked, index, model, top_k=3, tries=2, wait=0.0)
    got = {r.category: (r.extraction_status, r.n_grounded, r.warning) for r in items.collect()}
    assert got == {"plazos": ("success", 1, None), "garantias": ("partial", 0, "citation_rescued")}  # its value is on the page
    assert {r.category: (r.status, r.prompt_tokens, r.completion_tokens) for r in runs.collect()} == {"plazos": ("success", 7, 2), "garantias": ("success", 7, 2), "roto": ("failed", 0, 0)}
    assert {r.grounded for r in refs.collect()} == {True, False}
    # nothing to retrieve: no call, no tokens; fewer chunks for one category
    seen = []
    other = spark.createDataFrame([("none", "plazos", "plazo", None), ("a", "plazos", "plazo de entrega garantía", None)], asked.schema)
    items, _, runs = jobs.extract_facts(other, index, lambda c, chunks: {"items": [{"tipo": "n", "valor": str(len(chunks)), "extraction_status": "success"}]}, {"plazos": 1}, wait=0.0)
    assert {(r.analysis_id, r.status, r.prompt_tokens) for r in runs.collect()} == {("none", "not_found", 0), ("a", "success", 0)}
    assert [r.valor for r in items.collect()] == ["1"] and not seen


def test_settle(spark):
    text = "El plazo de entrega de los bienes es de 30 días corridos desde la orden de compra. " + "Otra cláusula sigue aquí. " * 8 + "La multa por mora es del 2 % por día."
    block = lambda i, t: (None, None, t) if i is None else ((1, i), [], t)
    index = spark.createDataFrame(
        [("d", 1, 0, text, None, "c0", [block(0, text[:82]), block(1, text[82:])]), ("d", 2, 1, "La garantía de oferta es del 5 % del total ofertado.", None, "c1", [block(0, "La garantía de oferta es del 5 % del total ofertado.")])],
        f"document_id string, page_number int, chunk_index int, content string, table_ref {schemas.TABLE_REF}, id string, blocks array<{schemas.SOURCE_BLOCK}>",
    )
    rows = [
        item(0, "plazos_clave", "entrega", valor="30 días", refs=(("d", 1, "30 días corridos"),)),
        item(1, "plazos_clave", "otro", expresion_relativa="desde la orden", refs=(("d", 1, "orden de compra"),)),  # the same fact
        item(2, "plazos_clave", "mora", valor="La multa por mora es del 2 %", refs=(("d", 1, "nadie escribió esta cita en el pliego"),)),
        item(3, "plazos_clave", "sin cita", valor="zz", refs=(("d", 1, "tampoco esta otra cita tan larga"),)),
        item(4, "plazos_clave", "nada", status="not_found", refs=()),
        item(5, "garantias", "oferta", valor="multa por mora", refs=(("d", 1, text),)),
    ]
    items = spark.createDataFrame(rows, schemas.ITEM)
    exclusive = spark.createDataFrame([(0, "garantias", 0, "multa")], "category_no int, category string, term_no int, term string")
    out, refs = jobs.settle(items, index, exclusive)
    got = {(r.category, r.item_no): (r.extraction_status, r.warning, r.n_merged, r.n_grounded, r.n_rescued) for r in out.collect()}
    assert got == {
        ("plazos_clave", 0): ("success", None, 2, 2, 0),
        ("plazos_clave", 2): ("partial", "foreign_term", 1, 0, 1),
        ("plazos_clave", 3): ("partial", "citation_unverified", 1, 0, 0),
        ("garantias", 5): ("success", None, 1, 1, 0),
    }
    by = {(r.category, r.item_no, r.ref_no): r for r in refs.collect()}
    assert by["plazos_clave", 0, 0].origin == "ensanchada" and "30 días corridos" in by["plazos_clave", 0, 0].citation and len(by["plazos_clave", 0, 0].citation) >= 40
    assert by["plazos_clave", 2, 0].origin == "rescatada" and "multa por mora" in by["plazos_clave", 2, 0].citation and by["plazos_clave", 2, 0].chunk_id == "c0"
    assert by["plazos_clave", 3, 0].origin == "llm" and by["plazos_clave", 3, 0].chunk_id is None
    assert by["plazos_clave", 0, 0].block_id == "d--1--0" and by["plazos_clave", 2, 0].block_id == "d--1--1" and by["plazos_clave", 3, 0].block_id is None
    long = by["garantias", 5, 0]
    assert long.origin == "ensanchada" and len(long.citation) <= 120 and "2 %" in long.citation and long.citation in text


def item(no, category, tipo, status="success", refs=(("d", 1, "una cita bastante larga"),), **k):
    base = dict.fromkeys("valor fecha hora expresion_relativa texto_original lugar monto_porcentaje monto_valor moneda".split()) | k
    return ("a", category, no, tipo, *[base[c] for c in ("valor", "fecha", "hora", "expresion_relativa", "texto_original", "lugar", "monto_porcentaje", "monto_valor", "moneda")], {}, 0.5, status, [(*r, None, None) for r in refs])


def test_publish(spark):
    rows = [
        item(0, "plazos_clave", "Apertura de ofertas", fecha="2024-05-01"),
        item(1, "plazos_clave", "apertura", fecha="2024-05-01", refs=(("d", 2, "otra cita bastante larga"),)),
        item(2, "plazos_clave", "APERTURA", fecha="2024-06-01"),
        item(3, "garantias", "Garantía de oferta", monto_porcentaje=5.0),
        item(4, "garantias", "Anticipo", monto_porcentaje=5.0, monto_valor=9.0),
        item(5, "identificacion", "zzz", valor="x"),
        item(6, "riesgos", "multa", valor="v", refs=(("d", 1, "corta"),)),
    ]
    df = spark.createDataFrame(rows, schemas.ITEM)
    good, bad, categories, conflicts = jobs.publish(df)
    kept = {(r.category, r.tipo, r.fecha): (r.n_merged, r.confidence, len(r.source_references)) for r in good.collect()}
    assert kept == {("plazos_clave", "apertura_ofertas", "2024-05-01"): (2, 0.8, 2), ("plazos_clave", "apertura_ofertas", "2024-06-01"): (1, 0.7, 1), ("garantias", "mantenimiento_oferta", None): (1, 0.7, 1)}
    assert sorted(tuple(r.broken) for r in bad.collect()) == [("known_type",), ("percent_or_amount",)]
    assert {r.category: (r.confidence, r.status) for r in categories.collect()} == {"plazos_clave": (0.75, "success"), "garantias": (0.7, "success")}
    assert [(r.tipo, r.n_items) for r in conflicts.collect()] == [("apertura_ofertas", 2)]
    strict = {r.fecha: r.confidence for r in jobs.publish(df, strict=True)[0].where("category = 'plazos_clave'").collect()}
    assert strict["2024-05-01"] == 0.7
    assert jobs.confidence_avg(categories).first().confidence_avg == 0.725
    shown = {r.item_no: (r.field_state, r.display_value) for r in jobs.display(df).collect()}
    assert shown[0] == ("found", "2024-05-01") and shown[3][1] == "5.0 %" and shown[5][1] == "x"


def test_labels(spark):
    docs = spark.createDataFrame([("a", "d", "p.pdf", True), ("a", "e", "q.pdf", False), ("b", "f", "r.pdf", False)], "analysis_id string, document_id string, filename string, is_primary boolean")
    labels = jobs.document_labels(docs)
    assert {r.document_id: r.one_primary for r in labels.collect()} == {"d": True, "e": True, "f": False}
    df = spark.createDataFrame([item(0, "x", "t"), item(1, "x", "t", refs=(("zz", 1, "una cita bastante larga"),))], schemas.ITEM)
    assert [r.source_references[0].filename for r in jobs.stamp_names(df, labels).orderBy("item_no").collect()] == ["p.pdf", None]
    view = spark.createDataFrame([("a", "analyzing", "extract", 40, None), ("b", "error", None, 95, None)], "analysis_id string, status string, current_stage string, progress int, timeout_at timestamp")
    assert [(r.label, r.ended) for r in jobs.status_view(view).orderBy("analysis_id").collect()] == [("extract 40 %", False), ("queued 95 %", True)]


def test_only_chunks_of_brief_citations_are_joined_for_their_words(spark, monkeypatch):
    ref = lambda c: [{"document_id": "d", "page_number": 1, "citation": c}]
    text = "La apertura de ofertas sera el lunes proximo en la sede central del organismo"
    rows = [("a", "identificacion", 1, "dato", "valor", 0.9, "success", ref("apertura de ofertas")), ("a", "identificacion", 2, "dato", "otro valor", 0.9, "success", ref(text[:60]))]
    items = spark.createDataFrame(rows, "analysis_id string, category string, item_no int, tipo string, valor string, confidence double, extraction_status string, source_references array<struct<document_id:string,page_number:int,citation:string>>")
    chunks = [("d", 1, 0, text, "c1"), ("d", 1, 1, "una linea que nadie cita en ninguna parte", "c2")]
    index = spark.createDataFrame(chunks, "document_id string, page_number int, chunk_index int, content string, id string").withColumn("table_ref", F.lit(None).cast("struct<table_id:string,row_index:int,headers:array<string>>"))
    plans, keep = {}, jobs.scratch.written
    monkeypatch.setattr(jobs.scratch, "written", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), keep(df, name))[1])
    out, refs = jobs.settle(items, index)
    assert {r.n_grounded for r in out.collect()} == {1}
    cited = {r.item_no: r.citation for r in refs.collect()}
    assert cited[1] == text[:36] and cited[2] == text[:60].strip()
    assert "LeftSemi" in plans["settle-references"]
