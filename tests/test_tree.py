"""Reading order of cached documents against a recursive walk."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from evidentia.operators import evidence, tree
from evidentia.sources import files

KINDS = {"texts": "text", "groups": "group", "pictures": "picture", "tables": "table"}


def node(ref, children=(), parent=None, layer="body", **more):
    return {"self_ref": ref, "parent": {"$ref": parent}, "children": [{"$ref": c} for c in children], "content_layer": layer, "label": "text"} | more


def walk(doc):
    """The refs that a walk from the body meets, with their depth."""
    by = {n["self_ref"]: (kind, n) for kind in KINDS for n in reversed(doc.get(kind) or [])}
    out, seen = [], set()

    def down(n, kind, level):
        if kind == "pictures":
            return
        for c in n["children"]:
            ref = c["$ref"]
            if ref in by and ref not in seen and by[ref][1]["parent"]["$ref"] in (None, n["self_ref"]):
                seen.add(ref)
                kind_, own = by[ref]
                if kind_ != "groups" and own["content_layer"] == "body":
                    out.append((ref, level))
                down(own, kind_, level + 1)

    down(doc["body"], "body", 1)
    return out


def grown(seed, n):
    r = random.Random(seed)
    refs = [f"#/{r.choice(['texts', 'texts', 'texts', 'groups', 'groups', 'pictures', 'tables'])}/{i}" for i in range(n)]
    parts = {}
    for i, ref in enumerate(refs):
        up = refs[max(0, i - 1)] if i and r.random() < 0.4 else r.choice(refs[:i]) if i and r.random() < 0.8 else "#/body"
        parts[ref] = node(ref, parent=up, layer=r.choice(["body"] * 6 + ["furniture"]), text=f"t{i}", orig=f"o{i}", prov=[{"page_no": i % 5 + 1}])
    body = node("#/body")
    for ref in r.sample(refs, n):
        up = parts[ref]["parent"]["$ref"]
        (body if up == "#/body" else parts[up])["children"].append({"$ref": ref})
    return {"name": "x", "body": body, "furniture": node("#/furniture")} | {k: [p for ref, p in parts.items() if ref.startswith(f"#/{k}/")] for k in KINDS}


def read(spark, docs):
    rows = [(k, d if isinstance(d, str) else json.dumps(d)) for k, d in docs.items()]
    return files.parsed(spark.createDataFrame(rows, "document_id string, json string").repartition(3))


def order(items):
    out = {}
    for r in sorted(items.collect(), key=lambda r: (r["document_id"], r["pos"])):
        out.setdefault(r["document_id"], []).append((r["self_ref"], r["level"]))
        assert r["pos"] == len(out[r["document_id"]]) - 1
    return out


def test_walks(spark):
    docs = {f"d{s}": grown(s, n) for s, n in enumerate((1, 2, 5, 30, 200, 90))}
    chain = [f"#/texts/{i}" for i in range(100)]
    docs["chain"] = {"body": node("#/body", chain[:1]), "texts": [node(c, chain[i + 1 : i + 2], parent=(["#/body"] + chain)[i]) for i, c in enumerate(chain)]}
    docs["none"] = {"body": node("#/body"), "texts": None}
    items, rejects = tree.reading_order(read(spark, docs)[0])
    assert order(items) == {k: w for k, d in docs.items() if (w := walk(d))}
    assert rejects.collect() == []


def test_what_leads_nowhere(spark):
    text = lambda i, *children, parent=None: node(f"#/texts/{i}", [f"#/texts/{c}" for c in children], parent, text=f"t{i}")
    doc = {
        "body": node("#/body", ["#/texts/0", "#/texts/9", "#/groups/0", "#/texts/0", "#/texts/4"]),
        "groups": [node("#/groups/0", ["#/texts/1", "#/texts/4"])],
        "texts": [text(0), text(1, 2), text(2, parent="#/texts/1"), text(3), text(4, parent="#/groups/0"), text(5, 6), text(6, 5, 7), text(7), text(8, 8), text(1) | {"text": "again"}],
    }
    items, rejects = tree.reading_order(read(spark, {"d": doc})[0])
    assert order(items)["d"] == [("#/texts/0", 1), ("#/texts/1", 2), ("#/texts/2", 3), ("#/texts/4", 2)]
    assert {r["text"] for r in items.collect()} == {"t0", "t1", "t2", "t4"}
    assert sorted((r["ref"], r["reason"]) for r in rejects.collect()) == [
        ("#/texts/0", "second_reference"), ("#/texts/1", "repeated_ref"), ("#/texts/4", "second_reference"), ("#/texts/5", "cycle"), ("#/texts/6", "cycle"), ("#/texts/7", "cycle"), ("#/texts/8", "cycle"), ("#/texts/9", "dangling_reference"),
    ]


def test_cached_files_to_evidence(spark, tmp_path):
    doc = {
        "schema_name": "Parsed", "name": "x", "pages": {"1": {"size": {"width": 1.0}}},
        "body": node("#/body", ["#/groups/0", "#/pictures/0", "#/texts/0"]),
        "groups": [node("#/groups/0", ["#/texts/2", "#/texts/1"])],
        "pictures": [node("#/pictures/0", ["#/texts/3"])],
        "texts": [
            node("#/texts/0", text="last", orig="last", prov=[{"page_no": 2, "bbox": {"l": 1, "t": 2, "r": 3, "b": 4.5, "coord_origin": "TOPLEFT"}, "charspan": [0, 4]}]), node("#/texts/1", text="second", prov=[{"page_no": 1}]),
            node("#/texts/2", text="PART 1 GENERAL", prov=[{"page_no": 1}]) | {"label": "section_header", "level": 1}, node("#/texts/3", text="on a picture", prov=[{"page_no": 1}]),
        ],
    }
    (tmp_path / "a b.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "bad.json").write_text('{"body": ')
    (tmp_path / "list.json").write_text("[1, 2]")
    documents, rejects = files.read_parsed(spark, str(tmp_path))
    assert {r["document_id"] for r in rejects.collect()} == {"bad.json", "list.json"}
    rows = evidence.catalog(documents, unicode=False).orderBy("pos").collect()
    assert [(r["document_id"], r["docling_ref"], r["raw_text"], r["page_number"], r["heading_path"]) for r in rows] == [
        ("a b.json", "#/texts/2", "PART 1 GENERAL", 1, ["PART 1 GENERAL"]), ("a b.json", "#/texts/1", "second", 1, ["PART 1 GENERAL"]), ("a b.json", "#/texts/0", "last", 2, ["PART 1 GENERAL"]),
    ]
    assert rows[2]["bbox"]["b"] == 4.5
    assert tree.reading_order(documents.where(F.lit(False)))[0].collect() == []
