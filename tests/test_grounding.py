"""Containment through the indexes against comparing all with all."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.operators import grounding


def holds(h, n, tiers):
    if not h or not n:
        return False
    if n in h:
        return True
    if not tiers:
        return False
    glue = lambda x: re.sub(r"[^a-z0-9]", "", x)
    if glue(n) and glue(n) in glue(h):
        return True
    words = [w for w in n.split(" ") if len(w) > 2]
    return len(words) >= 2 and all(w in h for w in words)


def pool(seed):
    r = random.Random(seed)
    words = ["duct", "ductwork", "fan", "a", "of", "é", "ßß", "日本語", "b2", "sealant", "cement", "metal", "x", "insulated", "0", "réf"]
    said = lambda n: " ".join(r.choice(words) for _ in range(n))
    hays = [said(r.randint(0, 25)) for _ in range(60)] + ["metalductsealant", "", None, "a" * 3000, "é é é", "日本語"]
    needles = [said(r.randint(1, 8)) for _ in range(80)] + ["", None, "a", "é", "日本", "a" * 50, "duct cement sealant", "metal duct", "étal", "m", "work fan", "ductworkfan", "x 0"]
    return [(i, h) for i, h in enumerate(hays)], [(i, n) for i, n in enumerate(needles)] + [(0, needles[0])]


@pytest.mark.parametrize("tiers", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_all_against_all(spark, seed, tiers, monkeypatch):
    hays, needles = pool(seed)
    texts = spark.createDataFrame(hays, "text_id int, hay string").repartition(3)
    wanted = spark.createDataFrame(needles, "needle_id int, needle string").repartition(2)
    want = {(i, j) for i, h in hays for j, n in needles if holds(h, n, tiers)}
    find = grounding.contained_tiers if tiers else grounding.contained
    assert sorted(map(tuple, find(texts, wanted).collect())) == sorted(want)
    monkeypatch.setattr(grounding, "MOST_RUNS", 0)
    monkeypatch.setattr(grounding, "MOST_BYTES", 0)
    assert sorted(map(tuple, find(texts, wanted).collect())) == sorted(want)


def test_nothing_to_find(spark):
    texts = spark.createDataFrame([(1, "a b c")], "text_id int, hay string")
    none = spark.createDataFrame([(1, None), (2, "")], "needle_id int, needle string")
    for find in (grounding.contained, grounding.contained_tiers):
        assert find(texts, none).collect() == [] and find(texts.limit(0), none.withColumn("needle", F.lit("a"))).collect() == []


def test_many_short_needles_are_not_compared_with_all(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(7))
    needles = [(i, word()) for i in range(20_000)]
    hays = [(i, " ".join([word() for _ in range(20)] + [needles[i * 7][1]])) for i in range(500)]
    out = grounding.contained(spark.createDataFrame(hays, "text_id int, hay string"), spark.createDataFrame(needles, "needle_id int, needle string"))
    assert {(i, i * 7) for i in range(500)} <= set(map(tuple, out.collect()))
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
