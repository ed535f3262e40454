"""Evidence, sections, regions and candidates on small documents."""

from __future__ import annotations

import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from evidentia import schemas
from evidentia.functions import predicates as P
from evidentia.functions import text as X
from evidentia.operators import candidates, evidence, regions, sections


def catalog(spark, docs: dict[str, list]):
    """docs: name to rows (text, heading?, page?, clause?)."""
    rows = []
    for name, items in docs.items():
        for pos, item in enumerate(items):
            text, heading, page, clause = (*((item,) if isinstance(item, str) else item), *(None,) * 4)[:4]
            rows.append((f"{name}-{pos}", name, page or 1, text, "heading" if heading else "other", clause, pos))
    return spark.createDataFrame(rows, "id string, document_id string, page_number int, raw_text string, evidence_kind string, source_clause string, pos int")


def found(spark, items: list, **more) -> list:
    docs = {"d": items} | more
    return sections.discover(catalog(spark, docs)).orderBy("document_id", "start_index").collect()


H = True
BODY = [("PART 1 GENERAL", H), ("1.01 SUMMARY", H), "text"]


def test_all_section_cases_at_once(spark):
    """One plan over many documents, each a case."""
    docs = {
        "a_multiline": [*BODY, ("SECTION 15891", H), ("METAL DUCTWORK", H), "body"],
        "b_modern": [("SECTION 23 31 13 - METAL DUCTS", H), *BODY],
        "c_bare": [("23 31 13 METAL DUCTS", H), *BODY],
        "d_article": [("1.04 SUBMITTALS", H), "SECTION 15891 in the text"],
        "e_reference": [("SECTION 15891 - DUCTS", H), *BODY, "Refer to Section 15502: HVAC."],
        "f_repeated": [("SECTION 15891 - DUCTS", H, 1), *BODY, ("SECTION 15891 - DUCTS", H, 2), ("tail", False, 2)],
        "g_two": [("SECTION 15891 - DUCTS", H), *BODY, ("SECTION 23 31 13 - METAL", H, 2), *BODY],
        "h_toc": [("15891 DUCTS", H), ("15892 PIPES", H), ("15893 FANS", H), *["filler"] * 30, ("15892 PIPES", H, 5), *[(t[0], t[1], 5) if isinstance(t, tuple) else (t, False, 5) for t in BODY]],
        "i_undashed": [("SECTION 15891 DUCTS", H), *BODY],
        "j_hyphens": [("23-31-13 METAL", H), *BODY],
        "k_unconfirmed": [("15891 DUCTS", H), "nothing", "else"],
        "l_weak": [("SECTION 15891 - DUCTS", H), "nothing"],
        "m_division": [("DIVISION 23 - HVAC", H), ("SECTION 23 31 13 - METAL", H), *BODY],
    }
    out = {}
    for r in sections.discover(catalog(spark, docs)).collect():
        out.setdefault(r["document_id"], []).append(r)
    first = {k: v[0] for k, v in out.items()}
    assert set(out) == set(docs) - {"d_article", "i_undashed", "j_hyphens", "k_unconfirmed"}
    a = first["a_multiline"]
    assert (a["section_number"], a["title"], a["start_index"], a["detection_method"]) == ("15891", "METAL DUCTWORK", 0, "heading_plus_title")
    assert "start_extended_before_heading" in a["warnings"] and a["heading_evidence_ids"] == ["a_multiline-3", "a_multiline-4"]
    assert (first["b_modern"]["section_number"], first["b_modern"]["title"]) == ("23 31 13", "METAL DUCTS")
    assert first["c_bare"]["detection_method"] == "numbered_heading"
    assert len(out["e_reference"]) == 1
    assert len(out["f_repeated"]) == 1 and (first["f_repeated"]["end_index"], first["f_repeated"]["end_page"]) == (5, 2)
    one, two = sorted(out["g_two"], key=lambda r: r["start_index"])
    assert (one["end_index"], two["start_index"], two["start_page"]) == (3, 4, 1) or (one["end_index"] + 1 == two["start_index"])
    assert not set(one["evidence_ids"]) & set(two["evidence_ids"])
    assert [(r["section_number"], r["start_page"]) for r in out["h_toc"]] == [("15892", 5)]
    assert sum("skipped_toc_like" in w for w in first["h_toc"]["warnings"]) == 3
    assert first["l_weak"]["warnings"] == ["weak_body_confirmation"]
    assert (first["m_division"]["division_number"], first["m_division"]["division_title"]) == ("23", "HVAC")
    assert a["id"] == "sec_" + hashlib.sha256("\0".join(["a_multiline", "15891", "a_multiline-3"]).encode()).hexdigest()[:16]
    again = sections.discover(catalog(spark, docs).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(str(r) for v in out.values() for r in v)


def test_coverage(spark):
    rows = catalog(spark, {"d": [("15891 DUCTS", H), ("15892 PIPES", H), ("15893 FANS", H), *["filler"] * 30, ("SECTION 15894 - LAST", H), *BODY]})
    spans = sections.discover(rows)
    report = sections.coverage(rows, spans).first()
    assert (report["total_evidence"], report["assigned_evidence"], report["evidence_before_first_section"], report["evidence_unassigned"]) == (37, 4, 33, 33)
    assert report["unassigned_evidence_ids"][0] == "d-0" and report["duplicate_assignment_ids"] == []


def test_section_numbers(spark):
    row = spark.createDataFrame([("23-31-13", " 15891 ")], "a string, b string").select(X.section_number("a"), X.section_number("b")).first()
    assert tuple(row) == ("23 31 13", "15891")


def test_regions(spark):
    rows = [
        ("1.03 QUALITY", H, 1, "1.03"), ("1.04 SUPPLEMENTAL SUBMITTALS", H, 1, "1.04"), ("A. Product data", False, 1, "1.04.A"), ("SECTION 15891", H, 1, "1.04.A"),
        ("C. Quality Control Submittals", H, 1, "1.04.C"), ("reports", False, 1, "1.04.C"), ("1.05 DELIVERY", H, 1, "1.05"), ("submittal log", H, 1, "1.05"), ("PART 2 PRODUCTS", H, 1, "1.05"),
    ]
    out = regions.locate(catalog(spark, {"d": rows, "e": [("1.02 SUBMITTALS", H, 1, "1.02"), "text"]})).orderBy("document_id").collect()
    assert [(r["document_id"], r["start_index"], r["end_index"], r["source_clause"], r["warnings"]) for r in out] == [("d", 1, 5, "1.04", []), ("e", 0, 1, "1.02", ["ended_at_catalog_eof"])]
    assert out[0]["evidence_ids"] == [f"d-{i}" for i in range(1, 6)]


def greedy(rows):
    """The choice as it is defined, one span after the other."""
    held = []
    for _, a, b in sorted(rows, key=lambda r: (-r[0], r[1], -r[2])):
        if not any(x <= a and y >= b for x, y in held):
            held = [(x, y) for x, y in held if not (a <= x and b >= y)] + [(a, b)]
    out = []
    for a, b in sorted(held):
        if all(b < x or a > y for x, y in out):
            out.append((a, b))
    return out


def test_greedy_choice(spark):
    r = random.Random(3)
    data = {k: [(r.randrange(4), a, a + r.randrange(12)) for a in (r.randrange(60) for _ in range(r.randrange(1, 25)))] for k in range(60)}
    df = spark.createDataFrame([(k, *x) for k, rows in data.items() for x in rows], "k int, priority int, start_index int, end_index int")
    found = {k: [] for k in data}
    for x in regions.greedy_spans(df, "k").collect():
        found[x["k"]].append((x["start_index"], x["end_index"]))
    assert {k: sorted(v) for k, v in found.items()} == {k: greedy(v) for k, v in data.items()}


def test_heading_paths_are_the_stack(spark):
    r = random.Random(4)
    data = {k: [(r.choice(evidence.RANKS), r.choice("abcd")) for _ in range(r.randrange(1, 40))] for k in range(80)}
    want = {}
    for k, rows in data.items():
        path = []
        for i, (rank, t) in enumerate(rows):
            if rank > 15 or not (any(x >= 30 for x, _ in path) or any(y == t for _, y in path)):
                path = [e for e in path if e[0] < rank] + [(rank, t)]
            want[k, i] = [t for _, t in path]
    heads = spark.createDataFrame([(k, i, *x) for k, rows in data.items() for i, x in enumerate(rows)], "k int, i int, rank int, t string")
    assert {(x["k"], x["i"]): x["path"] for x in evidence.heading_paths(heads, "k", "i").collect()} == want


def test_candidates(spark):
    part = [("PART 1 GENERAL", H), ("1.01 X", H, 1, "1.01"), ("PART 2 PRODUCTS", H), ("2.01 DUCTS", H, 1, "2.01"), ("a", False, 1, "2.01"), ("METAL DUCT WORK", H, 1, "2.01"), ("2.01 DUCTS", H, 1, "2.01"), ("b", False, 1, "2.01"), ("2.02 FANS", H, 1, "2.02"), ("c", False, 1, "2.02"), ("PART 3 EXECUTION", H), ("3.01 Z", H, 1, "3.01")]
    plain = [("1.01 GENERAL", H, 1, "1.01"), ("1.02 SEALANTS", H, 1, "1.02"), ("s", False, 1, "1.02"), ("1.03 OTHER", H, 1, "1.03"), ("o", False, 1, "1.03"), ("2.01 THINGS", H, 1, "2.01")]
    rows = catalog(spark, {"p": part, "q": plain})
    out = candidates.collect(rows, spark.createDataFrame([("p", "p-4")], "document_id string, id string"))
    got = {(r["document_id"], r["start_index"]): (r["end_index"], r["evidence_ids"], r["detection_method"]) for r in out.collect()}
    assert got == {
        ("p", 3): (7, ["p-3", "p-6", "p-7"], "part_products"), ("p", 8): (9, ["p-8", "p-9"], "part_products"),
        ("q", 1): (2, ["q-1", "q-2"], "heading_fallback"), ("q", 5): (5, ["q-5"], "heading_fallback"),
    }
    totals = {r["document_id"]: (r["total_regions"], r["total_evidence"]) for r in candidates.totals(out).collect()}
    assert totals == {"p": (2, 5), "q": (2, 3)}


# --- evidence
def items(spark, rows):
    made = [(d, pos, ref, label, None, text, marker, [{"page_no": page, "bbox": None}] if page is not None else None) for pos, (d, ref, label, text, marker, page) in enumerate(rows)]
    return spark.createDataFrame(made, schemas.ITEM)


def test_evidence_scan(spark):
    rows = [
        ("d", "r0", "title", "SECTION 15891", None, 1), ("d", "r1", "section_header", "PART 1 GENERAL", None, 1), ("d", "r2", "section_header", "1.04 SUBMITTALS", None, 1),
        ("d", "r3", "list_item", "product data", "A.", 1), ("d", "r4", "list_item", "detail", "1.", 1), ("d", "r4", "list_item", "again", None, 1), ("d", "r5", "text", "  ", None, 1),
        ("d", "r6", "text", "no page", None, None), ("d", "r6", "text", "ref is free still", None, 2), ("d", "r7", "page_header", "SECTION 15891", None, 2), ("d", None, "list_item", "a. sub", None, 2), ("d", "r8", "section_header", "B. MORE", None, 2),
    ]
    read = items(spark, rows)
    out = evidence.build_evidence(read, "s").orderBy("pos").collect()
    assert [(r["pos"], r["source_clause"], r["heading_path"]) for r in out] == [
        (0, None, ["SECTION 15891"]), (1, None, ["SECTION 15891", "PART 1 GENERAL"]), (2, "1.04", ["SECTION 15891", "PART 1 GENERAL", "1.04 SUBMITTALS"]),
        (3, "1.04.A", ["SECTION 15891", "PART 1 GENERAL", "1.04 SUBMITTALS"]), (4, "1.04.A.1", ["SECTION 15891", "PART 1 GENERAL", "1.04 SUBMITTALS"]),
        (8, "1.04.A.1", ["SECTION 15891", "PART 1 GENERAL", "1.04 SUBMITTALS"]), (9, "1.04.A.1", ["SECTION 15891", "PART 1 GENERAL", "1.04 SUBMITTALS"]),
        (10, "1.04.A.1.a", ["SECTION 15891", "PART 1 GENERAL", "1.04 SUBMITTALS"]), (11, "1.04.B", ["SECTION 15891", "PART 1 GENERAL", "1.04 SUBMITTALS", "B. MORE"]),
    ]
    digest = hashlib.sha256(b"product data").hexdigest()
    assert out[3]["id"] == "ev_" + hashlib.sha256(f"d\0r3\0{digest}".encode()).hexdigest()[:16]
    assert [f.name for f in evidence.build_evidence(read).schema] == schemas.EVIDENCE.names
    skipped = {r["pos"]: r["reason"] for r in evidence.skip_log(evidence.read_items(read)).collect()}
    assert skipped == {5: "duplicate_docling_ref", 6: "no_meaningful_text", 7: "no_page_provenance"}


def test_clause_cascade_is_the_fold(spark):
    r = random.Random(1)
    rows = [(d, i, r.choice("ALNSx")) for d in range(20) for i in range(40)]
    df = spark.createDataFrame(rows, "d int, i int, k string")
    of = lambda c: F.when(F.col("k") == c, F.col("i").cast("string"))
    got = {(x["d"], x["i"]): x["clause"] for x in evidence.clause_cascade(df, "d", "i", *map(of, "ALNS")).collect()}
    for d in range(20):
        state = [None] * 4
        for _, i, k in (x for x in rows if x[0] == d):
            level = "ALNS".find(k)
            if level >= 0 and all(state[:level]):
                state[level:] = [str(i)] + [None] * (3 - level)
            assert got[d, i] == (".".join(filter(None, state)) or None)


def test_text_functions(spark):
    texts = ["  “Fan–coil”  units  x ", "ﬁne ½\t—″", "", None, "a\x1fb", "ＡＢ", "don’t"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.normalize("t").alias("n"), X.match_key("t").alias("k")).collect()
    table = {ord(c): "-" for c in X.DASHES} | {ord(c): "'" for c in X.SINGLE_QUOTES} | {ord(c): '"' for c in X.DOUBLE_QUOTES}
    for r in rows:
        assert r["n"] == " ".join(unicodedata.normalize("NFKC", r["t"] or "").translate(table).split())
    assert rows[0]["k"] == "fan coil units x"
    assert X.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]
    assert P.is_rate_limit("HTTP 429") and not P.is_rate_limit("timeout")
    row = spark.range(1).select(
        X.trailing_parenthetical(F.lit("Hangers (Indoor Finishes)")).alias("p"), X.type_title(F.lit("product_data")).alias("t"), X.export_basename(F.lit(" A/B ")).alias("b"),
        X.context_lines(F.array(*map(F.lit, ["a", "a ", "b", "", "a"]))).alias("c"), X.term_present(F.lit("is 0.75 thick"), F.lit(".75")).alias("w"), X.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("v"), X.count_label(F.lit(1)).alias("n"),
    ).first()
    assert tuple(row["p"]) == ("Hangers", "Indoor Finishes") and row["t"] == "Product Data" and row["b"] == "A_B_submittal_register"
    assert row["c"] == "a\nb\na" and row["w"] and row["v"] == [0.6, 0.8] and row["n"] == "1 product"



def test_what_supports_a_name_is_made_once_and_by_all_cores(spark, tmp_path):
    from evidentia import catalog

    for unicode in (False, True):
        df = spark.createDataFrame([("Core (use)", "core", "core")], "a string, b string, k string").select(P.name_support("a", "b", F.col("k"), unicode).alias("s"))
        assert df.first()["s"]["mode"] == "normalized_name"
        assert df._jdf.queryExecution().optimizedPlan().expressions().mkString().count("regexp_replace(") < 100
    spark.createDataFrame([(i, f"part {i}", "Brand#1", "TYPE", i % 50, 1.0) for i in range(200)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    plan = catalog.name_support_modes(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize(("name", "blob", "mode"), [
    ("Hangers (Indoor Finishes)", "hangers and supports", "core_fallback"), ("Flexible Duct", "flexible air duct", "name"), ("Duct (Nuclear Grade)", "duct", "unsupported"),
    ("System (Indoor Finishes)", "system", "unsupported"), ("factory-fabricated fan", "factoryfabricatedfan", "name"), ("Duct (Type 316)", "duct type 316", "name"),
])
def test_name_support(spark, name, blob, mode):
    row = spark.createDataFrame([(name, blob)], "n string, b string").withColumn("k", X.match_key("b")).select(P.name_support("n", F.lit(None).cast("string"), F.col("k"))["mode"]).first()
    assert row[0] == mode
