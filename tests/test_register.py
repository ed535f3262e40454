"""Validation, views, packaging, export, chunks, vectors and the catalogue."""

from __future__ import annotations

import importlib
import io
import json
import subprocess
import sys
import zipfile
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia import catalog, passages, registers, schemas, specs  # noqa: F401  the queries of all of them
from evidentia.operators import chunks, export, grounding, packaging, present, project, validate, vector
from evidentia.operators.sections import discover
from evidentia.plans.register import run_sections, section_evidence
from evidentia.sources import files, plugins, store
from evidentia.streaming import drafts as streams

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def extraction(spark):
    evidence = spark.createDataFrame(
        [("k", "e1", 0, "Furnish metal ductwork and duct sealant per Section 15992", ["1.04 SUBMITTALS"], "1.04.A"), ("k", "e2", 1, "Hangers and supports", [], "2.01"), ("k", "e3", 2, "unrelated words", [], None)],
        "project_section_key string, id string, pos int, raw_text string, heading_path array<string>, source_clause string",
    )
    row = lambda schema, **v: tuple({"project_section_key": "k", "review_status": "pending", "spec_section_id": "s"}.get(n) if n not in v else v[n] for n in schema.names)
    make = lambda schema, *rows: spark.createDataFrame([row(schema, ord=i, **r) for i, r in enumerate(rows)], schema)
    return validate.Extraction(
        make(
            schemas.REQUIREMENT,
            {"id": "r1", "evidence_ids": ["e1", "e1", "gone"], "cross_references": ["Section 15992", "Section 99999"], "condition": "only on mondays", "source_clause": "1.04", "submittal_type": "product_data", "title": "Data"},
            {"id": "r1", "evidence_ids": ["e1"], "cross_references": []},
            {"id": "r2", "evidence_ids": ["gone"], "cross_references": []},
        ),
        make(schemas.PRODUCT_GROUP, {"id": "g1", "name": "Duct Sealant", "evidence_ids": ["e1"]}, {"id": "g2", "name": "Chillers", "evidence_ids": ["e1"]}),
        make(
            schemas.PRODUCT,
            {"id": "p1", "name": "Metal Ductwork", "product_group_id": "g1", "evidence_ids": ["e1"]},
            {"id": "p2", "name": "Hangers (Indoor Finishes)", "product_group_id": "g2", "evidence_ids": ["e2"]},
            {"id": "p3", "name": "Boilers", "evidence_ids": ["e2"]},
        ),
        make(
            schemas.LINK,
            {"id": "l1", "requirement_id": "r1", "product_id": "p1", "mapping_method": "explicit", "evidence_ids": ["e1"], "source_phrase": "metal ductwork", "review_required": False},
            {"id": "l2", "requirement_id": "r1", "product_id": "p2", "mapping_method": "explicit", "evidence_ids": ["e2"], "source_phrase": "hangers", "review_required": False},
            {"id": "l3", "requirement_id": "r9", "product_id": "p9", "mapping_method": "inferred", "evidence_ids": ["e1"]},
            {"id": "l4", "requirement_id": "r1", "product_id": "p3", "mapping_method": "inferred", "evidence_ids": ["e1"]},
            {"id": "l5", "requirement_id": "r1", "product_id": "p1", "mapping_method": "inferred", "evidence_ids": ["e1"]},
            {"id": "l6", "requirement_id": "r1", "product_id": "p2", "mapping_method": "explicit", "evidence_ids": ["e3"], "source_phrase": "nowhere at all", "review_required": False},
            {"id": "l7", "requirement_id": "r1", "product_id": "p1", "mapping_method": "normalized", "evidence_ids": ["e1"], "confidence": 0.9},
        ),
    ), evidence


@pytest.fixture(scope="module")
def validated(extraction):
    return validate.validate(*extraction)


def test_validation_cascade(validated):
    issues = {(r["entity_id"], r["code"]) for r in validated.issues.collect()}
    assert issues == {
        ("r1", "duplicate_entity_id"), ("r1", "unknown_evidence_id"), ("r2", "unknown_evidence_id"), ("r2", "no_valid_evidence"), ("r1", "unsupported_condition"), ("r1", "unsupported_cross_reference"),
        ("g2", "unsupported_group_name"), ("p2", "product_name_qualifier_not_source_literal"), ("p2", "dangling_product_group_id"), ("p3", "unsupported_product_name"),
        ("l2", "mapping_downgraded"), ("l3", "dangling_requirement_id"), ("l4", "dangling_product_id"), ("l5", "inferred_missing_confidence"), ("l5", "inferred_missing_review_required"),
        ("l6", "unsupported_source_phrase"), ("l6", "unsupported_explicit_mapping"),
    }
    kept = validated.extraction
    r = kept.requirements.collect()
    assert [(x["id"], x["evidence_ids"], x["cross_references"], x["condition"]) for x in r] == [("r1", ["e1"], ["Section 15992"], None)]
    assert {x["id"]: x["product_group_id"] for x in kept.products.collect()} == {"p1": "g1", "p2": None}
    assert {(x["id"], x["mapping_method"], x["confidence"], x["review_required"]) for x in kept.links.collect()} == {("l1", "explicit", None, False), ("l2", "inferred", 0.5, True), ("l7", "normalized", 0.9, False)}


def test_rejected_links_tell_their_ends(validated):
    rows = {r["entity_id"]: (r["requirement_id"], r["product_id"]) for r in validated.rejected.collect() if r["entity_type"] == "link"}
    assert rows and all(None not in ends for ends in rows.values())


def test_report(validated, spark):
    report = validate.report(validated, spark.createDataFrame([("k",), ("empty",)], "project_section_key string")).collect()
    by = {r["project_section_key"]: r for r in report}
    assert by["empty"]["valid"] and not by["k"]["valid"]
    assert by["k"]["accepted_counts"] == {"requirements": 1, "product_groups": 1, "products": 2, "links": 3}
    assert by["k"]["rejected_counts"] == {"requirements": 2, "product_groups": 1, "products": 1, "links": 4}
    assert by["k"]["warning_counts"]["error:unknown_evidence_id"] == 2


def test_view_and_consistency(validated, extraction):
    kept = validated.extraction
    view = present.section_view(kept, extraction[1])
    row = view.first()
    assert [g["group_id"] for g in row["product_groups"]] == ["g1", present.UNGROUPED_ID]
    assert [(g["total_products"], g["suggested_products"]) for g in row["product_groups"]] == [(1, 1), (1, 1)]
    assert row["suggested_product_ids"] == ["p1", "p2"] and row["available_product_count"] == 2
    assert present.consistency(kept, view).collect() == []
    broken = view.withColumn("available_product_count", F.lit(7))
    assert {r["failure"] for r in present.consistency(kept, broken).collect()} == {"available_product_count mismatch"}


def test_searches_and_review(validated, extraction, spark):
    kept, evidence = validated.extraction, extraction[1]
    pairs = present.catalogue(kept, evidence)
    assert {r["product_id"] for r in present.search_products(pairs, " SEALANT ").collect()} == {"p1"}
    assert present.search_products(pairs, "").count() == 2
    assert present.search_requirements(kept.requirements, "product data").count() == 1
    assert [(r["clause"], r["n"]) for r in present.per_clause(kept.requirements).collect()] == [("1.04", 1)]
    targets = {r["entity_id"]: r["clauses"] for r in present.review_targets(kept, evidence).collect()}
    assert targets == {"r1": ["1.04.A"], "g1": ["1.04.A"], "p1": ["1.04.A"], "p2": ["2.01"]}
    chunk = spark.createDataFrame([("Body A", "raw", True), ("Body B", "Raw x", False)], "page_content string, raw_text string, was_enriched boolean")
    assert present.search_chunks(chunk, "RAW X").count() == 1 and present.search_chunks(chunk, enriched_only=True).count() == 1


def test_json_artifact(spark):
    docs = spark.createDataFrame([('a"b',), ("c",)], "document_id string")
    rows = spark.createDataFrame([('a"b', 1, "x"), ('a"b', 2, None)], "document_id string, n int, t string")
    out = {r["document_id"]: json.loads(r["json"]) for r in export.json_artifact(docs, regions=rows).collect()}
    assert out == {'a"b': {"document_id": 'a"b', "regions": [{"document_id": 'a"b', "n": 1, "t": "x"}, {"document_id": 'a"b', "n": 2}]}, "c": {"document_id": "c", "regions": []}}


def register(spark, order=None, uploaded=None):
    sections = spark.createDataFrame(
        [("d1::s", "d1", "a.pdf", "s", "15891", "DUCTS", 1, 3, 9, 0), ("d2::s", "d2", "b.pdf", "s", "23 31 13", None, 1, 2, 5, 1), ("d3::s", "d3", "c.pdf", "s", "00001", "X", 1, 1, 1, 2)],
        "key string, document_id string, filename string, section_id string, section_number string, section_title string, start_page int, end_page int, evidence_count long, ord int",
    )
    views = spark.createDataFrame([(k, "r1", "1.04", "product_data", f"Title|{k}", 0, "s", ["e"]) for k in ("d1::s", "d2::s", "d3::s")], "key string, requirement_id string, source_clause string, submittal_type string, title string, ord int, spec_section_id string, evidence_ids array<string>")
    products = spark.createDataFrame([("d1::s", "p1", "Fan"), ("d1::s", "p2", "Duct"), ("d2::s", "p1", "Other fan")], "key string, product_id string, name string")
    statuses = spark.createDataFrame([("d1::s", "completed"), ("d2::s", "completed"), ("d3::s", "failed")], "key string, status string")
    confirmed = spark.createDataFrame([("d1::s", "r1", ["p2", "p1", "nope"])], "key string, requirement_id string, product_ids array<string>")
    chosen = packaging.choose(views.where("key = 'd1::s'"), confirmed, products)
    made = packaging.drafts(chosen, "combined").unionByName(packaging.drafts(chosen, "one_per_product")).withColumn("ord", F.when(F.col("packaging_mode") == "combined", 0).otherwise(1))
    return export.build(sections, views, products, statuses, confirmed, made, order, uploaded), made


def test_export_rows(spark):
    bundle, made = register(spark)
    rows = bundle.rows.orderBy(*export.ORDER).collect()
    assert [(r["source_file"], r["row_kind"], r["products"], r["products_status"]) for r in rows] == [
        ("a.pdf", "Extracted Requirement", ["Duct", "Fan"], "Included"), ("a.pdf", "Created Submittal", ["Duct", "Fan"], "Included"), ("a.pdf", "Created Submittal", ["Duct"], "Included"),
        ("a.pdf", "Created Submittal", ["Fan"], "Included"), ("b.pdf", "Extracted Requirement", [], "Available / Not Reviewed"),
    ]
    s = bundle.summary.first()
    assert (s["uploaded_file_count"], s["processed_section_count"], s["completed_count"], s["failed_count"], s["exported_register_row_count"]) == (3, 3, 2, 1, 5)
    ids = {r["id"] for r in made.collect()}
    assert len(ids) == 3 and all(i.startswith("draft_") and len(i) == 18 for i in ids)
    merged, added = packaging.merge(made.limit(1), made)
    assert merged.count() == 3 and added.count() == 2


def test_document_order(spark):
    bundle, _ = register(spark, ["d2", "d1"], 9)
    assert [r["source_file"] for r in bundle.rows.orderBy(*export.ORDER).collect()][0] == "b.pdf"
    assert bundle.summary.first()["uploaded_file_count"] == 9


def test_workbook_and_markdown(spark):
    bundle, _ = register(spark)
    data = export.workbook(bundle)
    assert data == export.workbook(bundle)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert len([n for n in z.namelist() if "worksheets/" in n]) == 3
    assert sheet.count("<row ") == 6 and 'topLeftCell="A2"' in sheet and '<autoFilter ref="A1:J6"/>' in sheet
    text = export.markdown(bundle)
    assert "- Completed: **2**" in text and "## 15891 — DUCTS" in text and "Title\\|d1::s" in text and "## 23 31 13 — Untitled" in text
    empty = export.Bundle(bundle.rows.limit(0), bundle.summary, bundle.status_lines)
    assert "_No register rows to export from completed sections._" in export.markdown(empty)


def test_register_and_project(spark):
    sections = spark.createDataFrame([("d::s", "d", "a.pdf", "1", "T")], "key string, document_id string, filename string, section_number string, section_title string")
    views = spark.createDataFrame([("d::s", "r", "x", "t", "c", 3, 1)], "key string, requirement_id string, submittal_type string, title string, source_clause string, available_product_count int, suggested_product_count int")
    confirmed = spark.createDataFrame([("d::s", "r", ["a", "b"])], "key string, requirement_id string, product_ids array<string>")
    status = lambda s: spark.createDataFrame([("d::s", s)], "key string, status string")
    assert project.register(sections, views, status("completed"), confirmed).first()["confirmed_product_count"] == 2
    assert project.register(sections, views, status("failed"), confirmed).count() == 0
    assert project.can_export(status("no_submittals")) and not project.can_export(status("failed"))
    uploads = spark.createDataFrame([(0, "a.pdf", bytearray(b"x"), [1]), (1, "b.docx", None, [1]), (2, "c.pdf", None, [1]), (3, None, None, None)], "ord int, filename string, content binary, items array<int>")
    documents, warnings = project.split_uploads(uploads)
    assert {r["filename"] for r in documents.collect()} == {"a.pdf", "c.pdf"}
    assert {r["warning"] for r in warnings.collect()} == {"b.docx: skipped (not a PDF)", "c.pdf: missing pdf_bytes; skipped for Specs Review PDF", "document.pdf: missing DoclingDocument"}
    key = spark.createDataFrame([("d::s::t",)], "k string")
    assert tuple(key.select(project.parse_key(F.col("k")).alias("p")).first()["p"]) == ("d", "s::t")


def test_chunks(spark):
    rows = [
        ("d", 0, "2.05 FANS intro text that is rather long " + "x" * 80, ["2.05 FANS"], "2.05 FANS\n2.05 FANS intro"), ("d", 1, "short line", [], "short line"), ("d", 2, "H. Makers", ["H. Makers"], "H. Makers\nH. Makers"),
        ("d", 3, " ", [], ""), ("d", 4, "3.01 NEXT", ["3.01 NEXT"], "3.01 NEXT\n3.01 NEXT"),
    ]
    out = chunks.enrich(spark.createDataFrame(rows, "document_id string, pos int, raw_text string, headings array<string>, contextualized string")).orderBy("pos").collect()
    assert [r["effective"] for r in out] == [["2.05 FANS"], ["2.05 FANS"], ["2.05 FANS", "H. Makers"], ["3.01 NEXT"]]
    assert out[1]["page_content"] == "2.05 FANS\nshort line" and out[1]["was_enriched"]
    assert out[2]["supporting_context"] == "short line" and out[3]["preceding"] == []


def test_vectors(spark):
    base = spark.createDataFrame([(i, [float(i % 5), 1.0, 0.5 * i]) for i in range(30)] + [(99, None)], "id int, embedding array<float>")
    queries = base.where("id in (3, 7)").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    hits = vector.top_k(base, queries, 4).collect()
    assert len(hits) == 8 and {(r["query_id"], r["id"]) for r in hits if r["rank"] == 1} == {(3, 3), (7, 7)}
    one = vector.top_k(base, queries.where("query_id = 3"), 1)
    chunk = spark.createDataFrame([("body", "f.pdf", "f.pdf", "", 3, "raw", "ctx", "h", "", False, "", 4)], schemas.CHUNK)
    text = vector.format_results(one, chunk).first()["text"]
    assert text == "[Source 1: f.pdf; chunk 3; page 4; distance 0.0000]\nHeadings: h\nSupporting context:\nctx\n\nPassage:\nraw"
    none = vector.answers(queries, vector.format_results(one.limit(0), chunk))
    assert {r["text"] for r in none.collect()} == {vector.NO_RESULTS}


def test_grounding(spark):
    texts = [(0, "abc def ghi jkl mno pqr"), (1, "xabc def ghi jkl mnox"), (2, "short one"), (3, "def ghi jkl")]
    needles = [(0, "abc def ghi jkl mno"), (1, "short"), (2, "def ghi jkl"), (3, "")]
    out = grounding.contained(spark.createDataFrame(texts, "text_id int, hay string"), spark.createDataFrame(needles, "needle_id int, needle string")).collect()
    assert {tuple(r) for r in out} == {(i, j) for i, t in texts for j, n in needles if n and n in t}


def test_plugins(spark, tmp_path):
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429 too many requests")
        return "ok"

    waits = []
    assert plugins.with_retries(flaky, sleep=waits.append) == "ok" and waits == [1.5, 3.0]
    with pytest.raises(KeyError):
        plugins.with_retries(lambda: {}["x"])
    texts = spark.createDataFrame([(i, "x" * i) for i in range(5)], "chunk_id int, t string")
    vectors = plugins.embed(texts, lambda said: [[float(len(s)), 1.0] for s in said], "chunk_id", "t", batch=2)
    assert all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in vectors.collect())
    assert plugins.build_index(texts, vectors, str(tmp_path / "index")).count() == 5
    with pytest.raises(ValueError):
        plugins.build_index(texts.limit(0), vectors, str(tmp_path / "none"))
    found = plugins.extract(spark.createDataFrame([("k", "p")], "project_section_key string, prompt string"), lambda p: {"products": [{"id": "p1", "name": p}]})
    assert [r["name"] for r in found.products.collect()] == ["p"] and found.links.count() == 0


def test_one_call_for_each_prompt_and_file(spark, tmp_path):
    log = tmp_path / "log"

    def said(what):
        with log.open("a") as f:
            f.write(what + "\n")

    def extractor(prompt):
        said(prompt)
        n = log.read_text().split().count(prompt)
        return "no json" if prompt == "b" and n == 1 else json.dumps({"products": [{"id": prompt, "name": str(n)}], "links": [{"id": "l", "product_id": prompt}]})

    prompts = spark.createDataFrame([("k1", "a"), ("k2", "b")], "project_section_key string, prompt string")
    found = plugins.extract(prompts, extractor)
    for df in found:
        df.collect()
    assert {r["name"] for r in found.products.collect()} == {"1", "2"}
    assert sorted(log.read_text().split()) == ["a", "b", "b"]
    with pytest.raises(ValueError):
        plugins.answer(lambda: "[1]")
    log.unlink()
    uploads = spark.createDataFrame([("x.pdf", "pdf", b"1"), ("y.pdf", "pdf", b"")], "filename string, file_type string, content binary")
    good, bad = files.parse(uploads, lambda name, content, do_ocr: said(name) or [{"text": str(do_ocr), "page": content[0]}], {"do_ocr": True})
    assert (good.count(), bad.count(), good.first()["items"][0]["text"]) == (1, 1, "True")
    assert sorted(log.read_text().split()) == ["x.pdf", "y.pdf"]


def test_cached_documents_and_downloads(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"document_id": "d", "items": [{"text": "A title", "label": "title"}, {"text": "one", "label": "list_item"}, {"text": " "}, {"orig": "body"}]}, indent=1))
    schema = "document_id string, items array<struct<text:string,orig:string,label:string>>"
    from pyspark.sql import types as T

    docs = files.read_documents(spark, str(tmp_path), T.StructType.fromDDL(schema))
    assert docs.first()["filename"] == "d.json"
    row = files.downloads(docs).first()
    assert row["markdown"] == "# A title\n\n- one\n\nbody" and json.loads(row["json"])["items"][3]["orig"] == "body"


def test_public_names():
    import evidentia

    assert len(dir(evidentia)) == 71 and all(getattr(evidentia, n) is not None for n in dir(evidentia))
    assert evidentia.export_markdown_bytes is not evidentia.export_markdown
    with pytest.raises(AttributeError):
        evidentia.no_such_name  # noqa: B018


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    (tmp_path / "c.HTML").write_bytes(b"z")
    read = files.read_files(spark, str(tmp_path))
    assert {r["filename"] for r in read.collect()} == {"a.pdf", "c.HTML"}
    good, bad = files.parse(read, lambda name, content: [{"text": name}] if name == "a.pdf" else 1 / 0)
    assert good.first()["items"][0]["text"] == "a.pdf" and bad.first()["error"].startswith("c.HTML: ")


def test_a_whole_run(spark):
    rows = [
        ("SECTION 15891 - METAL DUCTS", "section_header"), ("PART 1 GENERAL", "section_header"), ("1.04 SUBMITTALS", "section_header"), ("A. Product data for metal ductwork", "list_item"), ("PART 2 PRODUCTS", "section_header"),
        ("2.01 METAL DUCTWORK", "section_header"), ("galvanized steel", "text"), ("PART 3 EXECUTION", "section_header"),
    ]
    items = [{"self_ref": f"#{i}", "label": label, "orig": None, "text": t, "marker": None, "prov": [{"page_no": 1, "bbox": None}]} for i, (t, label) in enumerate(rows)]
    item = "array<struct<self_ref:string,label:string,orig:string,text:string,marker:string,prov:array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double,coord_origin:string>>>>>"
    uploads = spark.createDataFrame([(0, "a.pdf", bytearray(b"x"), items), (1, "b.pdf", bytearray(b"y"), items[:2] + items[4:])], f"ord int, filename string, content binary, items {item}")
    documents, evidence, sections, warnings = project.build(uploads)
    assert sections.count() == 2 and warnings.count() == 0
    found = discover(evidence).withColumn("key", project.section_key(F.col("document_id"), F.col("id")))

    def extractor(prompt: str) -> dict:
        ids = {line.split(": ")[1][:-1]: prompt.split(line)[1][:200] for line in prompt.splitlines() if line.startswith("[EVIDENCE ID")}
        data, duct = (next(i for i, t in ids.items() if word in t) for word in ("Product data", "METAL DUCTWORK"))
        return {
            "requirements": [{"id": "r1", "submittal_type": "product_data", "title": "Data", "source_clause": "1.04", "cross_references": [], "evidence_ids": [data]}],
            "products": [{"id": "p1", "name": "Metal Ductwork", "evidence_ids": [duct]}],
            "links": [{"id": "l1", "requirement_id": "r1", "product_id": "p1", "mapping_method": "explicit", "source_phrase": "metal ductwork", "evidence_ids": [data], "review_required": False}],
        }

    run = run_sections(section_evidence(found, evidence), extractor)
    view = run.views.collect()
    assert len(view) == 1 and view[0]["suggested_product_ids"] == ["p1"]
    report = {r["project_section_key"]: r["accepted_counts"]["links"] for r in run.report.collect()}
    assert sorted(report.values()) == [0, 1]
    assert "no_submittal_regions_found" in {r["warning"] for r in run.warnings.collect()}


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (2, "c")], "doc_id int, text string").write.parquet(str(source))
    stream = spark.readStream.schema("doc_id int, text string").parquet(str(source)).withColumn("id", F.col("doc_id"))
    out = str(tmp_path / "out")
    store.create(spark, out, stream.schema, buckets=4)
    for state in ("state", "state", "other state"):  # once more, and from the start again
        streams.append_new(stream, out, str(tmp_path / state), "drafts").awaitTermination(60)
        assert sorted(r["doc_id"] for r in store.read(spark, out).collect()) == [1, 2] and store.current(spark, out).number == 1
    lines = streams.evidence_lines(stream).writeStream.format("memory").queryName("lines").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "l")).start()
    lines.awaitTermination(60)
    assert spark.table("lines").count() == 5


def _canonical(df: pd.DataFrame) -> list:
    shown = lambda v: "NULL" if v is None or v is pd.NaT or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    out = df[sorted(df.columns)].map(shown)
    return sorted(map(tuple, out.replace(r"\.000000$", "", regex=True).to_numpy().tolist()))


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_match_their_sql(spark, name):
    got = catalog.QUERIES[name](spark, str(DATA)).toPandas()
    if name not in catalog.ORACLES:
        assert len(got.columns) and got.columns.is_unique
        return
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _canonical(got) == _canonical(want)


def test_the_engine_does_without_llm():
    code = "import sys; sys.modules['evidentia.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'grounding_contains' in e.queries() and set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, check=False).returncode == 0
    for module in ("functions", "operators", "plans", "sources", "streaming"):
        importlib.import_module(f"evidentia.{module}")
        for p in (Path(__file__).parent.parent / "evidentia" / module).glob("*.py"):
            assert "evidentia.llm" not in p.read_text()


def test_views_do_not_make_the_issues(spark, tmp_path, monkeypatch):
    from evidentia import registers
    from evidentia.operators import validate

    rows = [(i, f"part {i}", "Brand#1", "TYPE", i % 50, 1.0) for i in range(80)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    made, cut = [], validate.cut
    monkeypatch.setattr(validate, "cut", lambda df: made.append(df.columns) or cut(df))
    assert registers.view_catalogue(spark, str(tmp_path)).count() > 0
    assert made and not any({"severity", "reason"} & set(columns) for columns in made)
