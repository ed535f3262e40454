"""Every operator against brute force on a small table of hard cases."""

from __future__ import annotations

import hashlib
import re
import time
import tracemalloc
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import cache
from math import comb

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from evidentia.llm import components, copies, embed, licenses, packing, quality, secrets, simhash, spm, suffix, tokenbin, tokencount, tokens
from evidentia.llm.common import small_batches
from tests.llm.fixtures import crowded, documents, empty, prose, rows

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ROWS = rows()


def got(df) -> list:
    return [tuple(r) for r in df.collect()]


def closure(links: dict) -> dict:
    """Smallest reachable key."""
    label = {k: k for k in links}
    changed = True
    while changed:
        changed = False
        for k, others in links.items():
            for o in others:
                low = min(label[k], label[o])
                if label[k] != low or label[o] != low:
                    label[k] = label[o] = low
                    changed = True
    return label


def test_components(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (260, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(7, None), (None, 8)]
    links = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            links[a].add(b)
            links[b].add(a)
    found = dict(got(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert found == closure(links)
    assert got(components.components(spark.createDataFrame([], "a long, b long"))) == []


# --- 1
def vectors(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(40, 16))
    data = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    data += [(100 + i, (base[i] * 2).tolist(), i % 3) for i in range(6)] + [(200 + i, (base[i] + r.normal(size=16) * 0.15).tolist(), i % 3) for i in range(20)]
    data += [(300, base[0].tolist(), 1), (301, base[0].tolist(), 0), (302, base[0].tolist(), 0), (303, None, 0), (304, [], 0), (305, [0.0] * 16, 0), (306, [None] + [1.0] * 15, 0), (307, [float("nan")] + [1.0] * 15, 0), (308, base[0].tolist(), None), (309, base[0, :8].tolist(), 0), (310, (base[0] * 1e-30).tolist(), 0)]
    data += [(311, [float("inf")] * 16, 0)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)


@pytest.mark.parametrize("tile", [5, 2048])
def test_embeddings(spark, tile):
    data, df = vectors(spark)
    good = {}
    for i, v, label in data:
        x = np.array([np.nan if c is None else c for c in v or []], dtype=np.float32).astype(float)
        if label is not None and len(x) and np.isfinite(x).all() and x.any():
            good[i] = (label, x / np.linalg.norm(x))
    links = {i: set() for i, *_ in data}
    for i, (li, x) in good.items():
        links[i] = {j for j, (lj, y) in good.items() if i != j and li == lj and len(x) == len(y) and float(x @ y) >= 0.93}
    label = closure(links)
    want = {(i, len(links[i]), label[i], label[i] == i) for i in links}
    assert set(got(embed.near_duplicates(crowded(df.withColumnRenamed("label", "lab")).drop("label").withColumnRenamed("lab", "label"), tile=tile))) == want
    assert got(embed.near_duplicates(df.limit(0))) == []


def test_quantisation_bounds():
    r = np.random.default_rng(5)
    x = r.normal(size=(50, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (embed.upper_bounds(embed.quantise(x), embed.quantise(x)) >= x @ x.T).all()


# --- 2
def test_licences(spark):
    path = F.concat_ws("/", "source", "lang", F.when(F.col("doc_id") == 13, "LICENSE").otherwise(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("n")), F.lit(".txt"))))
    out = licenses.scan(crowded(documents(spark)), path=path).collect()
    assert len(out) == len(ROWS)
    by = {r["doc_id"]: r for r in out if r["doc_id"] is not None}
    assert by[13]["own_license"] == "MIT" and by[13]["start"] == 0
    folder = by[13]["path"].rsplit("/", 1)[0]
    for r in out:
        if r["doc_id"] != 13:
            assert r["own_license"] is None
            assert (r["license"] == "MIT") == (r["path"].rsplit("/", 1)[0] == folder)
    assert got(licenses.scan(empty(spark), path=F.lit("a/b"))) == []


@pytest.mark.parametrize(
    "want, text",
    [
        ("MIT", "Released under the MIT License. Copyright 2020 Jane Doe and the other authors."),
        ("Apache-2.0", "Some words come first, and then we say that it is licensed under the Apache License, Version 2.0."),
        ("BSD", "Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice."),
        ("LGPL-2.1", "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version."),
        ("GPL-2.0", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or"),
        ("GPL-3.0", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or"),
        ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General\nPublic License as published by the Free Software Foundation, either version 3 of the License, or"),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
        ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only"),
        ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0"),
        (None, "SPDX-License-Identifier: Some-Own-License-7"),
        (None, "a license to do as the public wants, under the terms of the authors, and the source of it all"),
    ],
)
def test_wrapped_and_embedded_notices(want, text):
    model = licenses.Model({w: 900 for w in ("the", "of", "and", "to")}, 1000)
    around = prose(51, 60) + "\n" + text + "\n" + prose(52, 60)
    for whole in (text, around):
        found = model.closest(whole)
        assert (model.templates[found[1]][0] if found else None) == want
    if want:
        assert model.closest(around)[0] >= brute_licence(around, model)[0] - 1e-9


@pytest.mark.parametrize(
    "want, text",
    [
        ("CC-BY-NC-SA-4.0", "This text is licensed under CC BY-NC-SA 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), (None, "Licensed under CC BY-NC 3.0."),
        (None, "This work is licensed under the GNU GPL, version 4."), (None, "This work is licensed under the GNU General Public License, version 4."), (None, "This work is licensed under the GNU General Public License."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
        ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"), ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"),
        ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"), ("BSD-2-Clause", "// SPDX-License-Identifier: BSD-2-Clause"), ("MIT OR Apache-2.0", "# SPDX-License-Identifier: MIT OR Apache-2.0"),
        ("GPL-2.0 AND BSD-3-Clause", "/* SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause) */"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"), (None, "SPDX-License-Identifier: GPL-4.0"), ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ],
)
def test_variants_and_versions_of_licences(want, text):
    model = licenses.Model({w: 900 for w in ("the", "of", "and", "to")}, 1000)
    for whole in (text, prose(53, 40) + "\n" + text + "\n" + prose(54, 40)):
        found = model.closest(whole)
        assert (model.name(found[1], whole, found[2]) if found else None) == want


def test_texts_of_nothing_but_template_words_take_no_longer():
    model = licenses.Model({w: 900 for w in ("the", "of", "and", "to")}, 1000)
    vocabulary, r = sorted(licenses.VOCABULARY), np.random.default_rng(1)
    for between in (" ", "\n"):
        text = between.join(vocabulary[i] for i in r.integers(0, len(vocabulary), 150_000))
        began = time.perf_counter()
        model.closest(text)
        assert time.perf_counter() - began < 2 * len(text) / 1e6 + 8  # with room for a busy machine


def test_made_up_path_knows_every_template(spark):
    data = [(i, "x\n" + t, "en", "s") for i, (_, t) in enumerate(licenses.TEMPLATES)] + [(-1, "no notice\nhere", "en", "s")]
    paths = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").select("doc_id", licenses.made_up_path().alias("p"))
    assert {i for i, p in got(paths) if "LICENSE." in p} == set(range(len(licenses.TEMPLATES)))


def brute_licence(text, model):
    """The best cosine over the whole text, its lines, and all runs of words that have the template's variant and version, and the licences that have it."""
    def cosine(words, template):
        counts = Counter(words)
        own = {w: n * model.weight.get(w, model.other) for w, n in counts.items()}
        parts = {w: n * model.weight[w] for w, n in Counter(template).items()}
        norm = (sum(x * x for x in own.values()) * sum(x * x for x in parts.values())) ** 0.5
        return sum(x * own.get(w, 0.0) for w, x in parts.items()) / norm if norm else 0.0

    lines = [licenses.words(line) for line in text.split("\n")]
    flat = [w for line in lines for w in line]
    said = {i: w.removesuffix(".0") for i, w in enumerate(flat) if i and flat[i - 1] in licenses.VERSION_OF and re.fullmatch(r"\d+(\.\d+)*", w)}
    ends = np.cumsum([len(x) for x in lines]).tolist()
    found = []
    for (name, t), size in zip(licenses.TEMPLATES, model.size, strict=True):
        t = licenses.words(t)
        named = {w.removesuffix(".0") for before, w in zip(t, t[1:], strict=False) if before in licenses.VERSION_OF and re.fullmatch(r"\d+(\.\d+)*", w)}
        family = set().union(*(f for w, f in licenses.FAMILIES.items() if w in t))
        runs = {(0, len(flat)), *zip([0, *ends], ends, strict=False), *((i, i + size) for i in range(len(flat) - size + 1))}
        for a, b in runs:
            if a < b and (c := cosine(flat[a:b], t)) >= model.least - 1e-9 and family & set(flat[a:b]) == family & set(t) and (not named or {v for i, v in said.items() if a <= i < b + licenses.AFTER} == named):
                found.append((round(c, 9), name))
    top = max((c for c, _ in found), default=None)
    return top, {n for c, n in found if c == top}


def test_licences_are_those_of_brute_force(spark):
    texts = [(i, t) for i, (_, t) in enumerate(licenses.TEMPLATES)]
    texts += [(100 + i, prose(60 + i, 20) + "\n" + "\n".join(t.split(" and ")) + " " + prose(80 + i, 15)) for i, (_, t) in enumerate(licenses.TEMPLATES) if i % 3 == 0 and len(t) < 300]
    texts += [(200, None), (201, ""), (202, "the software license of the authors " * 5), (203, prose(3, 300)), (None, texts[0][1]), (0, texts[1][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    model = licenses.fit(df)
    counts = Counter(w for _, t in texts for w in licenses.VOCABULARY.intersection(licenses.words(t or "")))
    assert model.weight == licenses.Model(counts, len(texts)).weight
    want = Counter()
    for i, t in texts:
        top, names = brute_licence(t or "", model)
        want[i, top] += 1
    out = licenses.scan(crowded(df), path=F.concat(F.lit("x/"), F.col("doc_id"))).collect()
    assert Counter((r["doc_id"], None if r["score"] is None else round(r["score"], 9)) for r in out) == want
    said = defaultdict(set)
    for i, t in texts:
        said[i] |= brute_licence(t or "", model)[1]
    assert all(r["own_license"] in said[r["doc_id"]] for r in out if r["own_license"])


def test_made_up_paths_have_folders_and_names(spark):
    data = [(None, "MIT License", None, None), (1, "x", None, "web"), (None, "y", "en", "web")] + [(i, "Released under the MIT License.", "en", "web") for i in range(40)]
    paths = [p for p, in got(spark.createDataFrame(data, "doc_id long, text string, lang string, source string").select(licenses.made_up_path().alias("p")))]
    assert all(p.split("/")[0] in ("none", "web") and p.rsplit("/", 1)[1] for p in paths) and paths[2].endswith("/none.txt")
    assert {p.count("/") for p in paths[3:]} == {2, 3, 4} and paths[1].count("/") == 4


def test_licence_inheritance_takes_the_nearest(spark):
    files = [(1, "a/LICENSE", "MIT"), (2, "a/b/LICENSE", "BSD"), (3, "a/b/c/x.txt", None), (4, "a/y.txt", None), (5, "z.txt", None), (6, "a/b/own.txt", "GPL-3.0"), (7, None, None)]
    df = spark.createDataFrame([(i, p, x, 1.0 if x else None, 0 if x else None, False) for i, p, x in files], "id long, path string, license string, score double, start long, whole boolean")
    assert {r["id"]: r["license"] for r in licenses.inherit(df).collect()} == {1: "MIT", 2: "BSD", 3: "BSD", 4: "MIT", 5: None, 6: "GPL-3.0", 7: None}


def test_licence_pruning_is_exact():
    model = licenses.Model({w: 900 for w in ("the", "of", "and", "to")}, 1000)
    for text in ("the of and to the of and", "Released under the MIT License", "the terms of the", ""):
        full = licenses.Model({w: 900 for w in ("the", "of", "and", "to")}, 1000)
        full.telling = licenses.VOCABULARY
        assert model.closest(text) == (full.closest(text) if licenses.words(text) else None)


# --- 3
def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    cover = set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(cover) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover), failed


def test_quality(spark):
    labels = spark.createDataFrame([(4, 1, 0), (7, 1, 0), (8, 1, 0), (9, 1, 0), (15, 0, 0), (10, 0, 0), (None, 1, 0), (11, 1, 0), (16, None, 0), (21, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality.quality(crowded(documents(spark)), labels).collect()
    want = Counter((i, *brute_quality(t)) for i, t, *_ in ROWS)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in out) == want
    assert all(not r["kept"] for r in out if r["base_failed"])
    assert {r["doc_id"] for r in out if r["kept"]} >= {4, 7, 8, 9, 11}
    kept = quality.keep(documents(spark), labels)
    assert kept.columns == documents(spark).columns and kept.count() == sum(r["kept"] for r in out)
    none = quality.quality(documents(spark), labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in none)
    assert got(quality.quality(empty(spark), labels)) == []


def test_repeated_words_with_many_distinct():
    ids = np.array([0, 1, 2, 9, 0, 1, 2, 5])
    assert quality.repeated_words(ids, 10) == quality.repeated_words(ids, 1 << 21) == 6


def test_scores_follow_the_target(spark):
    good, bad = ["alpha beta gamma delta " * 20] * 6, ["lorem ipsum dolor sit " * 20] * 6
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(12)], "doc_id long, quality int")
    scores = {r["doc_id"]: r["llr"] for r in quality.quality(docs, labels).collect()}
    assert min(scores[i] for i in range(6)) > 0 > max(scores[i] for i in range(6, 12))


# --- 4
def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    out = simhash.near_duplicates(crowded(documents(spark))).collect()
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in ROWS]
    links = {k: {j for j, (_, g) in enumerate(prints) if j != k and (f ^ g).bit_count() <= 4} for k, (_, f) in enumerate(prints)}
    label, least = closure(links), {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    want = Counter((i, f"{f:016x}", least.get(label[k]), i == least.get(label[k])) for k, (i, f) in enumerate(prints))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"], r["kept"]) for r in out) == want
    assert got(simhash.near_duplicates(empty(spark))) == []


@pytest.mark.parametrize("tile", [(2, 1 << 18), copies.TILE])
def test_near_copies(spark, monkeypatch, tile):
    monkeypatch.setattr(copies, "TILE", tile)
    data = [(r[0], r[1]) for r in ROWS]
    base = prose(30, 150).split()
    edited = lambda r, n: " ".join("edit" if k in set(r.choice(len(base), n, replace=False)) else w for k, w in enumerate(base))
    r = np.random.default_rng(9)
    data += [(100 + i, edited(r, n)) for i, n in enumerate([0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 8, 12])]
    data += [(200 + i, prose(31 + i, 90) + " " + prose(30, 40)) for i in range(6)]
    sets = [frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in (simhash.words_of(t) for _, t in data)]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    label = closure({i: {j for j in range(len(data)) if alike(sets[i], sets[j])} for i in range(len(data))})
    near = [(i, j) for i in range(len(data)) for j in range(i) if sets[i] != sets[j] and alike(sets[i], sets[j])]
    prints = [simhash.fingerprint(t) for _, t in data]
    assert any((prints[i] ^ prints[j]).bit_count() > 4 for i, j in near)
    least = defaultdict(list)
    for k, (i, _) in enumerate(data):
        least[label[k]].append(i)
    want = [(i, min((x for x in least[label[k]] if x is not None), default=None)) for k, (i, _) in enumerate(data)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    found = [(r["doc_id"], r["component_id"], r["kept"]) for r in copies.near_copies(crowded(df)).collect()]
    assert sorted(map(str, found)) == sorted(str((i, c, i == c)) for i, c in want)
    assert sorted(map(str, (r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, df, "").collect()))) == sorted(str(i) for i, c in want if i == c)  # of rows without an id, only those of groups without ids
    assert got(copies.near_copies(empty(spark))) == []


def test_simhash_makes_the_candidates_of_near_copies():
    r = np.random.default_rng(12)
    tables = copies.tables(50_000)
    assert all(len(set(t)) == len(t) == 12 for t in tables.tolist()) and len(copies.tables(10**7)[0]) > 12
    bits = lambda s: np.unpackbits(np.frombuffer(copies.fingerprint(s), dtype=np.uint8), bitorder="little")
    small = r.integers(0, 1 << 64, 700, dtype=np.uint64)
    h = [[int(x) for x in copies.mix(small ^ s)] for s in copies._SEEDS]
    assert bits(small).tolist() == [int(2 * sum(x >> b & 1 for x in word) > 700) for word in h for b in range(64)]
    met = 0
    for size in (9, 45, 450):
        for _ in range(40):
            common, extra = r.integers(0, 1 << 64, size * 8 // 9, dtype=np.uint64), r.integers(0, 1 << 64, (2, size // 9), dtype=np.uint64)
            a, b = (np.unique(np.r_[common, e]) for e in extra)  # at 0.8
            x, y = bits(a), bits(b)
            met += copies.similar(a, b) and bool((x[tables] == y[tables]).all(axis=1).any()) and int((x != y)[: 64 * copies.JUDGED].sum()) <= copies.RADIUS
    assert met == 120
    # buckets 1 and 2: rows with one near row after another, and some that lie apart
    prints = r.integers(0, 1 << 64, (60, copies.JUDGED), dtype=np.uint64)
    for k in range(1, 25):
        prints[k] = prints[k - 1] ^ (np.uint64((1 << 15) - 1) << np.uint64(k))
    bucket, node, n = np.repeat([1, 2], 60), np.tile(r.permutation(60), 2), np.full(120, 100)
    n[60:] = np.where(node[60:] % 2, 100, 10)
    made = copies._candidates(bucket, node, n, [np.tile(p, 2) for p in prints.T], 0.8).to_pylist()
    far = lambda i, j: min(n[i], n[j]) < 0.8 * max(n[i], n[j]) or sum(int(prints[i % 60][w] ^ prints[j % 60][w]).bit_count() for w in range(copies.JUDGED)) > copies.RADIUS
    label = closure({i: {j for j in range(120) if bucket[i] == bucket[j] and not far(i, j)} for i in range(120)})
    groups = defaultdict(set)
    for i, g in label.items():
        groups[g].add(int(node[i]))
    found = defaultdict(set)
    for row in made:
        found[row["bucket"]].add(row["node"])
        assert row["first"] in found[row["bucket"]]
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
    at = lambda row, x: next(i for i in range(120) if node[i] == row[x] and n[i] == row["n"])
    assert all(row["near"] == (not far(at(row, "node"), at(row, "first"))) for row in made if n[at(row, "node")] == 10)


def test_bit_sliced_links_find_all_and_only():
    r = np.random.default_rng(2)
    fps = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    for i in range(0, 300, 3):
        fps[i + 1] = fps[i] ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 7), replace=False)))
    lo, hi = np.arange(300) + 1, np.full(300, 300)
    for radius in (0, 1, 3, 4, 6):
        found = {(int(a), int(b)) for x, y in simhash.sliced_links(fps, lo, hi, radius, words=64) for a, b in zip(x, y, strict=True)}
        assert found == {(i, j) for i in range(300) for j in range(i + 1, 300) if int(fps[i] ^ fps[j]).bit_count() <= radius}


@pytest.mark.parametrize("tile", [4, 1024])
def test_fingerprint_links_connect(spark, tile):
    r = np.random.default_rng(4)
    center = int(r.integers(0, 1 << 62))
    fps = {center} | {center ^ sum(1 << int(b) for b in r.choice(10, r.integers(1, 5), replace=False)) for _ in range(60)} | {int(x) for x in r.integers(0, 1 << 62, 60)}
    edges = got(simhash.fingerprint_links(spark.createDataFrame([(x,) for x in fps], "fp long"), tile=tile))
    made = {x: set() for x in fps}
    for a, b in edges:
        made[a].add(b)
        made[b].add(a)
    assert closure(made) == closure({x: {y for y in fps if x != y and (x ^ y).bit_count() <= 4} for x in fps})


def test_buckets_share_more_bits_in_larger_tables():
    assert [simhash.bits_for(n) for n in (0, 10**6, 2**28, 10**10)] == [20, 20, 21, 26]
    r = np.random.default_rng(7)
    for bits in (20, 27, 33):
        masks = simhash.bucket_masks(4, bits)
        assert all(m.bit_count() >= bits for m in masks) and len(masks) == comb(*simhash.blocks_for(4, bits))
        for _ in range(200):
            differ = sum(1 << int(b) for b in r.choice(64, 4, replace=False))
            assert any(not m & differ for m in masks)


# --- 5
def brute_spans(text):
    text = text or ""
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in a.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    return sorted(found + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24])


def test_secrets(spark):
    out = secrets.digest(secrets.scan_documents(crowded(documents(spark)))).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        spans = brute_spans(t)
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        want[(i, *(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(line.encode()).hexdigest(), line)] += 1
    assert Counter(tuple(r) for r in out) == want
    assert got(secrets.scan_documents(empty(spark))) == []


def test_secret_ledger_scans_only_what_is_new(spark):
    docs = documents(spark)
    _, first = secrets.update(docs)
    _, again = secrets.update(docs, first)
    assert again.scanned.count() == first.scanned.count() == docs.select(secrets.blob_of("text")).distinct().count() * len(secrets.RULES)
    newer = (secrets.RULES[0]._replace(version=2), *secrets.RULES[1:])
    more = spark.createDataFrame([(99, "secret = abcdefghi")], "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    _, after = secrets.update(more, again, rules=newer)
    assert after.scanned.count() - again.scanned.count() == again.scanned.select("blob").distinct().count() + len(newer)
    assert after.findings.where("rule = 'assign:2'").count() == first.findings.where("rule = 'assign:1'").count() + 1


def test_stored_ledger_scans_nothing_twice(spark, tmp_path):
    docs = documents(spark)
    _, first = secrets.update(docs)
    secrets.save(first, str(tmp_path / "ledger"))
    read = secrets.load(spark, str(tmp_path / "ledger"))
    rows, again = secrets.update(docs, read)
    assert again.scanned.count() == first.scanned.count() and again.findings.count() == first.findings.count()
    found = secrets.digest(secrets.scan_documents(docs, read))
    assert Counter(got(found)) == Counter(got(secrets.digest(secrets.scan_documents(docs))))


def test_private_keys_go_to_their_end(spark):
    body = "\n".join("QUJDRA+/" * 8 for _ in range(20))
    texts = [f"a -----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{body}\n-----END RSA PRIVATE KEY----- b", f"a -----BEGIN PRIVATE KEY-----\n{body}\nand words follow", "eyJ" * 400_000 + " x"]
    out = secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules=secrets.MORE).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {0: "a [SECRET] b", 1: "a [SECRET]\nand words follow", 2: texts[2]}


def test_long_keys_and_tokens_have_no_bound(spark):
    line, key = "QUJDRA+/" * 8, "-----BEGIN EC PRIVATE KEY-----"
    long = "\n".join([line] * 5000)
    jwt = f"eyJ{'a' * 10_000}.{'b' * 5000}.{'c' * 3000}"
    texts = [
        f"a {key}\n{long}\n-----END EC PRIVATE KEY----- b", f"a {key}\n{long}\nMII=\nand words", f"x {jwt} y", f"{key}\n" * 100_000, "eyJabcdefgh." + "eyJ" * 200_000, "eyJabcdefgh.short.x eyJabcdefgh",
        f"{key}\r\nProc-Type: 4,ENCRYPTED\r\nDEK-Info: DES-EDE3-CBC,12\r\n\r\n{line}\r\n-----END EC PRIVATE KEY-----.", f'{{"k": "{key}\\n{line}\\n-----END EC PRIVATE KEY-----\\n"}}', f"{key}\nVersion: 1 of it\n\n{line}\nwords", f"{key} is a header; {key}\nshort\n",
        "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x 1.2 (y)\n\n" + line + "\n=abcd\n-----END PGP PRIVATE KEY BLOCK-----", ("Ab:" + key + "\n") * 20_000, (key + "\n" + "A" * 15 + "\n") * 3 + "\n" * 200_000,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs, rules=secrets.MORE).collect()}
    assert time.perf_counter() - began < 60
    private = re.compile(secrets.MORE[3].pattern)
    want = {i: private.sub("[SECRET]", t) for i, t in enumerate(texts) if i not in (2, 4, 5, 11)}
    want = {i: re.sub(r"(\[SECRET\])+", "[SECRET]", t) for i, t in want.items()}  # those that touch are one
    want |= {2: "x [SECRET] y", 4: texts[4], 5: texts[5]}
    assert {i: t for i, t in out.items() if i != 11} == want and "PRIVATE KEY" not in out[11]
    assert want[0] == "a [SECRET] b" and want[1] == "a [SECRET]\nMII=\nand words" and want[6] == "[SECRET]." and want[7] == '{"k": "[SECRET]\\n"}' and want[8] == "[SECRET]\nwords" and want[10] == "[SECRET]"


def test_redaction_keeps_what_it_is_given(spark):
    names = ("row", "own", "blob", "spans", "__k", "__b", "start")
    df = crowded(documents(spark)).drop("start", "blob").select("*", *(F.lit(n).alias(n) for n in names))
    out = secrets.redact(df)
    assert out.columns == df.columns
    mask = lambda t: None if t is None else mask_spans(t, brute_spans(t))
    want = Counter((i, mask(t), *names) for i, t, *_ in ROWS)
    assert Counter(got(out.select("doc_id", "text", *(f"`{n}`" for n in names)))) == want
    assert got(secrets.redact(empty(spark))) == []


def mask_spans(text, spans):
    out, at = "", 0
    for a, _, _, b in spans:
        if b <= at:
            continue
        out += text[at:a] + "[SECRET]" if not (a <= at and at) else ""
        at = b
    return out + text[at:]


def test_further_secrets_and_redaction(spark):
    text = f"x ghp_{'A' * 36} y\n-----BEGIN RSA PRIVATE KEY----- é xoxb-1234567890-abc"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "clean"), (4, "secret=abcdefgh0123456789abcdef0123456789")], "doc_id long, text string")
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan_documents(docs).collect()}
    assert kinds == {1: ["github", "private_key", "slack"], 2: [], 3: [], 4: ["assign", "hex"]}
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert masked == {1: "x [SECRET] y\n[SECRET] é [SECRET]", 2: None, 3: "clean", 4: "[SECRET]"}


# --- 6, 9
@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_library(monkeypatch):
    texts = [t or "" for _, t, *_ in ROWS] + ["A  B\tC\r\nd", "Ünder † sign †x", "don't DON'T we'll", "x<|startoftext|>y <|ENDOFTEXT|>", "İstanbul ǅ ß"]
    for most in (3, 100_000):
        own = tokens.Encoder(WORDS, most)
        assert own.by_word
        for part in (texts, texts[::-1]):
            assert [x.tolist() for x in own.encode(part)] == [ids_of(t) for t in part]


def test_packing(spark):
    out = packing.pack(crowded(documents(spark)), WORDS, capacity=256, most=2).collect()
    want = Counter()
    for i, t, *_ in ROWS:
        ids = np.array([*ids_of(t), 1], dtype="<u4")
        for p, a in enumerate(range(0, len(ids), 256)):
            want[(i, p, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    # no pieces could be packed in fewer sequences than their tokens need; best fit comes near
    assert len(by) <= 1.2 * sum(n for held in by.values() for _, n in held) / 256 + 2
    assert got(packing.pack(empty(spark), WORDS)) == []


def test_packing_rounds_leave_few_sequences_open(spark):
    rows_ = [(i % 40, i, 30 + (i * 37) % 60) for i in range(800)]
    df = spark.createDataFrame(rows_, "part int, k long, length long").repartition(40, "part")
    out = packing.pack_pieces(df, 100, most=4, fan_in=4).collect()
    assert len(out) == 800 and len({r["k"] for r in out}) == 800
    used = Counter()
    for r in out:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 100 and len(used) <= 1.35 * sum(r[2] for r in rows_) / 100


def test_best_fit_is_tight_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [*fit.add("a", 7)] == [] and [*fit.add("b", 5)] == []
    assert [*fit.add("c", 3)] == [["a", "c"]]  # the tightest that takes it, filled up
    assert [*fit.add("d", 6)] == [] and [*fit.add("e", 8)] == [["e"]]
    assert fit.rest() == [["d"], ["b"]]


@pytest.mark.parametrize("image_ids", [1, 50, 1 << 17])
def test_token_images(spark, image_ids):
    docs = crowded(documents(spark))
    out = tokenbin.read_ids(tokenbin.write_ids(docs, WORDS, 2, image_ids=image_ids)).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = Counter(), 0
    for i, t, *_ in order:
        ids = np.array([*ids_of(t), 2], dtype="<u4")
        want[(i, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in out) == want
    assert got(tokenbin.token_table(empty(spark), WORDS)) == []


def test_elias_fano():
    r = np.random.default_rng(6)
    for values in ([], [0], [5], [1 << 40], np.sort(r.integers(0, 10**6, 3000)), np.cumsum(r.integers(0, 3, 2000)), np.zeros(700, dtype=int)):
        code = tokenbin.EliasFano.of(np.array(values, dtype=np.uint64))
        back, size = tokenbin.EliasFano.from_bytes(memoryview(code.to_bytes()))
        assert size == len(code.to_bytes()) and back.values().tolist() == [int(v) for v in values]
        assert all(back.select(i) == int(v) for i, v in enumerate(values))
    assert len(tokenbin.EliasFano.of(np.arange(10000) * 1000).to_bytes()) < 10000 * 2
    with pytest.raises(ValueError):
        tokenbin.Image(tokenbin.image_of([np.array([1, 2], dtype="<u2")])[:-1])


# --- 7
def brute_removed(data: list[tuple], least: int = 50) -> list[bytearray]:
    first, out = {}, [bytearray(len((t or "").encode())) for _, t, *_ in data]
    key = lambda i: (i is None, i or 0)
    for i, t, *_ in data:
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            first[w] = min(first.get(w, key(i)), key(i))
    for (i, t, *_), mask in zip(data, out, strict=True):
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            if first[b[p : p + least]] < key(i):
                mask[p : p + least] = b"\1" * least
    return out


def want_removed(data):
    want = Counter()
    for (i, t, *_), mask in zip(data, brute_removed(data), strict=True):
        b = (t or "").encode()
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        want[(i, len(b), sum(mask), len([x for x in bytes(mask).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())] += 1
    return want


@pytest.mark.parametrize("unit", [1, 3000, 2 << 20])
def test_suffix(spark, monkeypatch, unit):
    monkeypatch.setattr(suffix.units_of, "__defaults__", (unit, False))
    assert Counter(got(suffix.dedup(crowded(documents(spark))))) == want_removed(ROWS)
    assert got(suffix.dedup(empty(spark))) == []


@pytest.mark.parametrize("many", [0, 2, 64, suffix.MANY])
def test_suffix_on_shared_pieces(spark, many):
    r = np.random.default_rng(8)
    stock = ["".join(r.choice(list("abcd "), r.integers(20, 120))) for _ in range(30)]
    data = [(int(i), "".join(stock[k] for k in r.integers(0, 30, 6))) for i in r.permutation(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    assert Counter(got(suffix.dedup(df, most=many))) == want_removed(data)


def test_suffix_index_of_three_batches_is_that_of_one(spark):
    r = np.random.default_rng(12)
    stock = ["".join(r.choice(list("abcd "), r.integers(20, 120))) for _ in range(30)]
    data = [(i, "".join(stock[k] for k in r.integers(0, 30, 6))) for i in range(70)]
    index, found = suffix.Index(3), Counter()
    for lo, hi in ((0, 40), (40, 45), (45, 70)):
        df = spark.createDataFrame(data[lo:hi], "doc_id long, text string").repartition(3)
        found += Counter(got(index.add(df)))
    assert found == want_removed(data)
    sizes = [n for n, _ in index.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:], strict=False))
    more = spark.createDataFrame([(-5, data[0][1]), (None, None)], "doc_id long, text string")  # earlier batches come first
    again = {r["doc_id"]: r for r in index.add(more).collect()}
    assert again[-5]["n_removed"] == again[-5]["n_bytes"] and again[None]["n_bytes"] == 0


def test_suffix_arrays_are_in_suffix_order():
    r = np.random.default_rng(5)
    text = bytes(r.choice(list(b"ab\x00c"), 3000).tolist())
    unit = suffix.Unit(np.frombuffer(text, dtype=np.uint8), np.array([3000]), np.array([1]))
    a = suffix.anchors(unit, 50)
    key = suffix.records(unit.buf, a.at, a.hi + 50 - a.at, a.at - a.lo, 50)
    own = [(text[p : h + 50], text[lo:p][::-1]) for p, lo, h in zip(a.at, a.lo, a.hi, strict=True)]
    assert [own[i] for i in np.argsort(key, kind="stable")] == sorted(own)
    one, two = (np.sort(key[i::2]) for i in (0, 1))
    runs = [suffix.Run(k, np.arange(len(k)), np.zeros(len(k), dtype=int), np.arange(len(k))) for k in (one, two)]
    both = suffix.merged(*runs)
    assert (both.key == np.sort(key)).all()
    rows = suffix.as_bytes(both.key)[:, :50]
    want = [0] + [next((i for i in range(50) if x[i] != y[i]), 50) for x, y in zip(rows[:-1], rows[1:], strict=True)]
    assert suffix.common(rows).tolist() == want


def test_packing_with_a_small_cache_is_the_same(spark):
    docs = documents(spark).coalesce(1)
    few = Counter(got(packing.pack(docs, WORDS, words=3).drop("sequence_id")))
    assert few == Counter(got(packing.pack(docs, WORDS).drop("sequence_id")))


def test_suffix_anchors_are_made_in_slices(monkeypatch):
    r = np.random.default_rng(6)
    n = 1 << 19
    unit = suffix.Unit(r.integers(97, 101, n, dtype=np.uint8), np.array([100, 130, n // 2, n]), np.array([4, 1, 3, 2]))
    tracemalloc.start()
    whole = suffix.anchors(unit, 50)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 32 * n
    for size in (100, 4096):
        part = suffix.Unit(unit.buf[:20000], np.array([100, 130, 9000, 20000]), unit.docs)
        monkeypatch.setattr(suffix, "SLICE", 1 << 30)
        one = suffix.anchors(part, 50)
        monkeypatch.setattr(suffix, "SLICE", size)
        assert all((x == y).all() and x.dtype == y.dtype for x, y in zip(one, suffix.anchors(part, 50), strict=True))
    assert len(whole.at)


def test_batches_of_large_rows_are_small(spark):
    small_batches(spark)
    rows = spark.range(0, 12, 1, 1).selectExpr("id", "repeat('x', 1 << 20) as t")
    sizes = [r["n"] for r in rows.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs), "n long").collect()]
    assert sum(sizes) == 12
    assert max(sizes) <= 5


def test_suffix_trim(spark):
    out = suffix.trim(documents(spark))
    assert out.columns == documents(spark).columns
    want = Counter()
    for (i, t, lang, source, n), mask in zip(ROWS, brute_removed(ROWS), strict=True):
        chars, at = [], 0
        for c in t or "":
            size = len(c.encode())
            if not all(mask[at : at + size]):
                chars.append(c)
            at += size
        want[(i, None if t is None else "".join(chars), lang, source, n)] += 1
    assert Counter(got(out)) == want
    assert got(suffix.trim(empty(spark))) == []


# --- 8
def test_sentencepiece(spark):
    own = spm.model(PIECES).library
    full = spm.round_trip(crowded(documents(spark)), PIECES).collect()
    out = Counter(tuple(r)[:4] for r in full)
    ends = lambda t: spm.model(PIECES).ends(t or "", [*own.encode(t or ""), 2])
    assert Counter((r["doc_id"], r["spans_crc32"]) for r in full) == Counter((i, zlib.crc32(ends(t).astype("<u4").tobytes())) for i, t, *_ in ROWS)
    want = Counter()
    for i, t, *_ in ROWS:
        ids = [*own.encode(t or ""), 2]
        want[(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest())] += 1
    assert out == want
    assert got(spm.round_trip(empty(spark), PIECES)) == []
    encoded = spm.encode(documents(spark), PIECES)
    back = Counter(got(spm.decode(encoded, PIECES)))
    assert back == Counter((i, own.decode([*own.encode(t or ""), 2])) for i, t, *_ in ROWS)


def test_sentencepiece_spans_are_the_librarys():
    own = spm.Pieces(PIECES, most=50)
    for t in ["", " ", "a  b", " x", "日本 語", "▁x a▁b", "a\nb\x00", *[t or "" for _, t, *_ in ROWS if len(t or "") < 3000]]:
        ids = own.encode([t])[0]
        ends = own.ends(t, ids)
        assert ids[:-1] == own.library.encode(t) and ends[-1] == len(t.encode())
        for p, a, b in zip(own.library.encode(t, return_type="proto").pieces, [0, *ends[:-1]], ends, strict=False):
            if not p.piece.startswith("<0x"):
                assert (p.begin, p.end) == (a, b)


def test_sentencepiece_cache_is_bounded_and_turns_over():
    own = spm.Pieces(PIECES, most=40)
    texts = [prose(s, 60) for s in range(8)] + ["字" * 5000, "a" * 300 + " b " + "日本語" * 90, "a  b ", " ", ""]
    for part in (texts, texts[::-1], texts[3:] + texts[:3]):
        for at in range(0, len(part), 3):
            assert own.encode(part[at : at + 3]) == [[*own.library.encode(t), own.end] for t in part[at : at + 3]]
            assert len(own.cache) <= 40 and len(own.older) <= 40 and max(map(len, [*own.cache, *own.older])) < spm.LONG_WORD
    assert own.older  # it has turned over
    kept = next(iter(own.older))
    own.encode([kept])
    assert kept in own.cache  # what is asked for again stays


def test_character_map_is_the_librarys():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = spm.Normaliser(proto.normalizer_spec)
    for t in ["", " ", "  a  b ", "ﬁ ½ ＡＢ", "ｶﾞ　x", "①② z", "é é", "日本\t語\n"]:
        normal, source = own(t.encode())
        assert normal.decode() == library.normalize(t) and len(source) == len(normal) + 1 and (np.diff(source) >= 0).all()


# --- 10
@pytest.mark.parametrize("rule", tokencount.RULES)
def test_token_counts(spark, rule):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = tokencount.count_tokens(crowded(documents(spark)), path, public_tokenizers.PATTERN, rule=rule).collect()
    own, want = tokencount.counter(path, public_tokenizers.PATTERN), Counter()
    for i, t, *_ in ROWS:
        data = (t or "").encode()
        lead = re.search(rb"[.!?]\s+", data)
        starts = sorted({0, *(m.end() for m in re.finditer(rb"\n+", data) if m.end() < len(data)), *([lead.end()] if lead and lead.end() < len(data) else [])})
        stops = [*starts[1:], len(data)]
        n, across, at = [0] * len(starts), [0] * len(starts), 0
        for token in own.library.encode_ordinary(t or ""):
            end = at + len(own.library.decode_single_token_bytes(token))
            inside = range(bisect_right(starts, at) - 1, bisect_right(starts, end - 1))
            to = {"start": inside[0], "end": inside[-1], "largest": max(inside, key=lambda k: min(stops[k], end) - max(starts[k], at))}[rule]
            n[to] += 1
            across[to] += len(inside) > 1
            at = end
        for k, (a, b) in enumerate(zip(starts, stops, strict=True)):
            want[(i, k, len(data[:a].decode()), len(data[:b].decode()), n[k], across[k], sum(n))] += 1
    assert Counter((r["doc_id"], r["section"], r["start"], r["end"], r["n_tokens"], r["n_crossing"], r["doc_tokens"]) for r in out) == want
    assert got(tokencount.count_tokens(empty(spark), path, public_tokenizers.PATTERN)) == []


@pytest.mark.parametrize("run", [3, 50])
def test_runs_of_white_space_are_one_piece(monkeypatch, run):
    monkeypatch.setattr(tokencount, "LONG_RUN", run)
    own = tokencount.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for space in (" ", "\n", "\t", "\u3000", " \n", "\r\n \t"):
        for n in (1, 2, 3, 4, 49, 50, 51, 120):
            for text in (f"a{space * n}b", f"{space * n}b.", f"a{space * n}", space * n, f"a{space * n}'s{space * n}9{space * n}!"):
                assert own.ids(text).tolist() == own.library.encode_ordinary(text)


def test_very_long_runs():
    """Five million characters of one kind."""
    n = 5_000_000
    own = tokencount.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    pieces, words = spm.model(PIECES), tokens.encoder(WORDS)
    for c in ("a", " ", "\n", "\t"):
        text = f"x {c * n} y"
        assert own.ends(text)[-1] == len(text)
        ids = pieces.encode([text])[0]
        assert pieces.ends(text, ids)[-1] == len(text)
        if c != "a":
            assert words.encode([text])[0].tolist() == ids_of("x y")
    assert len(words.encode(["a" * n])[0]) > n / 100


# --- the pipeline
def brute_pipeline(data, labels_kept):
    """The stages on (doc_id, text) rows, by definition; labels_kept tells which rows the quality rules keep."""
    rows = [(i, t) for k, (i, t) in enumerate(data) if labels_kept[k]]
    shingles = lambda t: (lambda w: frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else []))(simhash.words_of(t))
    sets = [shingles(t) for _, t in rows]
    alike = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    group = closure({k: {j for j in range(len(rows)) if alike(sets[k], sets[j])} for k in range(len(rows))})
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    rows = [(i, t) for k, (i, t) in enumerate(rows) if i == least.get(group[k])]
    trimmed = []
    for (i, t), mask in zip(rows, brute_removed([(i, t) for i, t in rows]), strict=True):
        chars, at = [], 0
        for c in t:
            size = len(c.encode())
            chars += [c] if not all(mask[at : at + size]) else []
            at += size
        trimmed.append((i, "".join(chars)))
    return rows, trimmed, [(i, mask_spans(t, brute_spans(t))) for i, t in trimmed]


def test_pipeline_is_its_stages_by_brute_force(spark, tmp_path):
    docs = crowded(documents(spark))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(4, 1, 0), (7, 1, 0), (8, 1, 0), (9, 1, 0), (15, 0, 0), (10, 0, 0), (None, 1, 0), (11, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    at = spark.read.parquet(f"{sf}/documents.parquet")
    verdict = {(r["doc_id"], r["n_words"], r["word_chars"]): r["kept"] for r in quality.quality(at, labels).collect()}
    data = [(i, t) for i, t, *_ in ROWS]
    kept = [verdict[(i, *brute_quality(t)[:2])] for i, t in data]
    near, trimmed, masked = brute_pipeline(data, kept)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "secret_scans", "best_fit_packing"]
    pairs = lambda df: Counter(map(str, got(df.select("doc_id", "text"))))
    told = lambda rows: Counter(str((i, t)) for i, t in rows)
    for name, want in (("quality_rules", [x for x, k in zip(data, kept, strict=True) if k]), ("simhash_near_dedup", near), ("suffix_array_dedup", trimmed), ("secret_scans", masked)):
        at = stages[name](spark, at, sf)
        assert at.columns == docs.columns and pairs(at) == told(want), name
        at = spark.createDataFrame(at.collect(), at.schema)
    assert all(r["n_chars"] == len(r["text"]) for r in at.collect())
    out = corpus_pipeline.run(spark, sf).collect()
    pieces = Counter()
    for i, t in masked:
        ids = np.array([*ids_of(t), 1], dtype="<u4")
        pieces.update((i, p, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for p, a in enumerate(range(0, len(ids), 4096)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == pieces


def test_pipeline_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty(spark), str(tmp_path))
        assert out.collect() == [], name
        assert name == "best_fit_packing" or out.columns == empty(spark).columns
