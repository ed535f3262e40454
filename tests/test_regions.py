"""Ends of regions and overlapping spans against loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evidentia.functions import predicates as P
from evidentia.functions import text as X
from evidentia.operators import regions


def evidence(spark, seed, documents, n):
    r = random.Random(seed)
    texts = ["1.01 SUBMITTALS", "1.02 ACTION SUBMITTALS", "2.05 FANS", "2.05 MORE FANS", "PART 2 PRODUCTS", "SECTION 15891 SUBMITTALS", "SECTION 15900", "ACTION SUBMITTALS", "Submit product data", "text", "3.01 SUPPLEMENTAL SUBMITTALS", "A. Submittals"]
    clauses = [None, None, "", "1.01", "1.02", "2.05.A", "9.9.B.1"]
    rows = [(f"d{d}", i * 3, f"d{d}e{i}", r.choice(texts), r.choice(["heading", "heading", "other"]), r.choice(clauses)) for d in range(documents) for i in range(n)]
    return spark.createDataFrame(rows, "document_id string, pos int, id string, raw_text string, evidence_kind string, source_clause string")


@pytest.mark.parametrize("seed", [1, 2])
def test_ends_and_warnings(spark, seed):
    rows = evidence(spark, seed, 5, 60)
    flags = regions._rows(rows, False).withColumns({
        "part": P.part_heading(F.col("heading"), F.col("t")), "boundary": P.section_boundary(F.col("heading"), F.col("t"), "clause"), "numbered": F.when(F.col("heading"), X.article_root("t")),
        "opens": P.submittal_text(F.col("folded"), F.col("t")) & (F.col("heading") | F.col("t").rlike(X.ARTICLE)), "priority": regions.priority(),
    }).collect()
    want = []
    for d in {r["document_id"] for r in flags}:
        own = sorted((r for r in flags if r["document_id"] == d), key=lambda r: r["idx"])
        for s in (r for r in own if r["opens"]):
            stop, told = None, []
            for r in own[s["idx"] + 1 :]:
                if not (r["article"] or r["part"] or r["boundary"]):
                    continue
                if r["part"] or (s["article"] and r["article"] and r["article"] != s["article"]) or (not s["article"] and r["numbered"]):
                    stop = r["idx"]
                    break
                told += [f"ambiguous_section_heading_at_index_{r['idx']}:{r['id']}"] * r["boundary"]
            told += ["ended_at_catalog_eof"] * (stop is None) + ["low_priority_candidate_start"] * (s["priority"] < 20)
            want.append((d, s["idx"], own[-1]["idx"] if stop is None else stop - 1, s["article"], s["priority"], tuple(told)))
    got = [(r["document_id"], r["start_index"], r["end_index"], r["source_clause"], r["priority"], tuple(r["warnings"])) for r in regions.candidates(rows, False).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any("ambiguous" in str(w) for w in want) and any(w[3] is None for w in want)


def overlapping(spans):
    return sorted((k, a, b, s <= s2 and e >= e2) for k, a, s, e in spans for k2, b, s2, e2 in spans if k == k2 and a != b and None not in (s, e, s2, e2) and s <= e and s2 <= e2 and s <= e2 and s2 <= e)


def test_overlaps(spark):
    r = random.Random(4)
    spans = [(f"k{r.randint(0, 2)}", i, s := r.randint(-50, 200), s + r.choice([0, 1, 2, 7, 8, 9, 40, 300])) for i in range(150)]
    spans += [("k0", 900, 5, 3), ("k0", 901, None, 3), ("k0", 902, 3, None), ("k0", 903, 0, 0), ("k0", 904, 0, 0), ("k1", 905, -(1 << 40), 1 << 40), ("k1", 906, -1, 0)]
    df = spark.createDataFrame(spans, "k string, name int, start_index long, end_index long").repartition(3)
    assert sorted(map(tuple, regions.overlaps(df, "k", "name").collect())) == overlapping(spans)
    assert regions.overlaps(df.limit(0), "k", "name").collect() == []


def test_a_very_long_span_among_short_ones(spark):
    spans = [("k", i, i * 100_000, i * 100_000 + 3) for i in range(51)] + [("k", 99, 0, 5_000_000)]
    df = spark.createDataFrame(spans, "k string, name int, start_index long, end_index long")
    assert sorted(map(tuple, regions.overlaps(df, "k", "name").collect())) == overlapping(spans)
