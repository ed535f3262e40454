"""Whitening, decontamination and divergence against brute force; the SQL twins of all operators that have one."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.llm import common, decontaminate, divergence, oracle, queries, whiten
from tests.llm.fixtures import crowded, documents, empty, prose, rows

ROWS = rows()
LOWER = {c: c + 32 for c in range(65, 91)}


def test_lower_case_of_a_to_z_alone(spark):
    texts = ["".join(chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x2FA00, 256)] + [None, "", "ABC", "É Z", "İI", "ΑΣ"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", common.lower_a_to_z("t")).collect()
    assert {r[0]: r[1] for r in got} == {i: t if t is None else t.translate(LOWER) for i, t in enumerate(texts)}


# --- 11
def whitened(data, components=8):
    """By length: (ids, deviation, whitened values, shares) of the usable rows."""
    out = {}
    by = defaultdict(list)
    for i, v in data:
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            by[len(v)].append((i, v))
    for size, own in by.items():
        if not size:
            continue
        x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in v] for _, v in own]
        n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
        dev = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
        y = np.array([[c - s / n for c, s in zip(v, sums, strict=True)] for v in x])
        e, u = np.linalg.eigh(y.T @ y / n)
        e, u = e[::-1], u[:, ::-1]
        k = min(components, size)
        shares = [e[i] / e.sum() if e.sum() > 0 else None for i in range(k)]
        values = np.stack([y @ u[:, i] / np.sqrt(e[i]) if e[i] > e.sum() * size * 2.0**-52 else np.full(n, np.nan) for i in range(k)], axis=1)
        out[size] = ([i for i, _ in own], n, dev, values, shares)
    return out


@pytest.mark.parametrize("size", [3, 12, 70])
def test_whitening(spark, size):
    r = np.random.default_rng(size)
    scale = np.linspace(0.3, 2, size)
    data = [(i, (r.normal(size=size) * scale).tolist()) for i in range(150)]
    data += [(1, data[1][1]), (None, data[2][1]), (None, None), (900, None), (901, []), (902, [float("nan")] * size), (903, [None] + [0.5] * (size - 1)), (904, [float("-inf")] + [0.5] * (size - 1))]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    got = whiten.whiten(crowded(df)).collect()
    ((ids, n, dev, values, shares),) = whitened(data).values()
    k = min(8, size)
    assert len(got) == len(ids) * k and {x["n"] for x in got} == {n}
    key = lambda i: (i is None, i or 0)
    assert sorted((key(x["vec_id"]), x["deviation"]) for x in got if x["component"] == 1) == sorted((key(i), d) for i, d in zip(ids, dev, strict=True))
    assert all(int(x["exact_deviation"]) == x["deviation"] for x in got)
    errors = {x["identity_error"] for x in got}
    assert len(errors) == 1 and errors.pop() < 1e-9
    for c in range(k):
        own = sorted((key(x["vec_id"]), x["deviation"], x["whitened"]) for x in got if x["component"] == c + 1)
        want = sorted((key(i), d, v) for i, d, v in zip(ids, dev, values[:, c], strict=True))
        a, b = np.array([x[2] for x in own]), np.array([x[2] for x in want])
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-8
        assert all(abs(x["explained"] - shares[c]) < 1e-12 for x in got if x["component"] == c + 1)


def test_whitening_of_little(spark):
    schema = "vec_id string, embedding array<double>"
    assert whiten.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten.whiten(spark.createDataFrame([("a", None), ("b", [])], schema)).columns[0] == "vec_id"
    one = whiten.whiten(spark.createDataFrame([("a", [1.0, 2.0])], schema)).collect()
    assert [(x["component"], x["n"], x["deviation"], x["whitened"], x["explained"], x["identity_error"]) for x in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    # two lengths are two lists; in the second the values vary in one direction only
    mixed = whiten.whiten(spark.createDataFrame([("a", [0.5]), ("b", [0.25]), ("c", [1.0, 1.0]), ("d", [2.0, 2.0]), ("e", [3.0, 3.0])], schema)).collect()
    by = {(x["vec_id"], x["component"]): x for x in mixed}
    assert len(mixed) == 8 and by["a", 1]["n"] == 2 and by["c", 1]["n"] == 3
    assert abs(by["a", 1]["whitened"]) == pytest.approx(1) and by["d", 1]["whitened"] == pytest.approx(0, abs=1e-9)
    assert by["c", 2]["whitened"] is None and by["c", 1]["explained"] == pytest.approx(1) and by["c", 1]["identity_error"] < 1e-9
    # beyond a long: the exact deviation, or null beyond 38 digits
    huge = whiten.whiten(spark.createDataFrame([("a", [1e11, 0.0]), ("b", [-1e11, 1.0]), ("c", [1e300, 0.5])], schema)).collect()
    x = [[int(1024 * 1e11) + 100000, 100000], [int(-1024 * 1e11) + 100000, 101024], [whiten.MOST + 100000, 100512]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = {i: sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in zip("abc", x, strict=True)}
    assert {r["vec_id"]: int(r["exact_deviation"]) for r in huge} == want and all(r["deviation"] is None for r in huge)


# --- 12
def leaks(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        size = min(len(w), window)
        for at in range(len(w) - size + 1) if size else ():
            grams[tuple(w[at : at + size])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for size in {len(g) for g in grams}:
            for at in range(len(w) - size + 1):
                if found := grams.get(tuple(w[at : at + size])):
                    hit |= {*range(at, at + size)}
                    own |= found
        out.append((i, len(w), len(hit), len(own), sorted(own), bool(hit)))
    return sorted(out, key=str)


def benchmark_of(texts):
    cut = lambda k, a, b: " ".join(ROWS[k][1].split()[a:b])
    return [
        (1, cut(4, 10, 40)), (2, cut(4, 30, 45).upper()), (10, cut(4, 30, 45)), (3, "one two"), (4, "one"), (5, None), (6, "!? -"), (7, "same same same"), (8, "same " * 30), (9, "日本語 текст mixed space"),
        (None, cut(9, 100, 125)), (11, "never to be found anywhere at all in any of these texts"), (11, "one two"), (12, cut(7, 0, 9)), (13, cut(11, 19980, 20000)), (14, cut(4, 0, 3) + " " + cut(4, 50, 58)), (15, "x" * 5000),
    ]


@pytest.mark.parametrize("window, shingle", [(10, 5), (10, 3), (4, 4), (13, 5), (1, 1)])
def test_decontamination(spark, window, shingle):
    items = benchmark_of(ROWS)
    docs = [(r[0], r[1]) for r in ROWS] + [(50, "x" * 5000 + " one, TWO; three")]
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    got = decontaminate.decontaminate(crowded(made.withColumn("lang", F.lit("x"))), crowded(bench), window=window, shingle=shingle)
    assert sorted((tuple(r) for r in got.collect()), key=str) == leaks(docs, items, window)


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert decontaminate.decontaminate(docs.limit(0), bench).collect() == []
    for none in (bench.limit(0), bench.withColumn("text", F.lit(None).cast("string")), bench.withColumn("text", F.lit(" . "))):
        assert sorted(tuple(r) for r in decontaminate.decontaminate(docs, none).collect()) == [(1, 3, 0, 0, [], False), (2, 0, 0, 0, [], False)]


def test_shingles_beyond_the_broadcast_bound_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    items, docs = benchmark_of(ROWS), [(r[0], r[1]) for r in ROWS]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert sorted((tuple(r) for r in got.collect()), key=str) == leaks(docs, items)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- 13
def apart(docs, least=30, ranks=50):
    by, df, groups = Counter(), Counter(), set()
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        by.update((lang, source, t) for t in terms)
        df.update((lang, t) for t in set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for (g, t), n in df.items() if g == lang and n >= least]
        sources = [s for g, s in groups if g == lang]

        def shares(count, kept=kept):
            total = sum(count(t) for t in kept)
            return {t: 1 + 10**9 * (count(t) + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(lambda t, s=s: by[lang, s, t]) for s in sources}
        q = shares(lambda t: sum(by[lang, s, t] for s in sources))
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)]
            above = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if by[lang, s, t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(above[:ranks])]
    return sorted(out)


def sourced():
    docs = [(prose(i % 37, 40), ["en", "de", None, ""][i % 4], ["a", "b", "ß", None, "c d", "Z"][i % 6]) for i in range(90)]
    docs += [("Ärger ÄRGER The the THE tHe", "en", "a"), (None, "en", "only null"), ("", "xx", "one"), (None, "xx", "two"), ("alone", "yy", "one"), ("\x01the the", "en", "b"), (prose(3, 3000), "de", "a")]
    return docs


@pytest.mark.parametrize("least, ranks", [(1, 50), (8, 3), (1000, 5)])
def test_divergence(spark, least, ranks):
    docs = sourced()
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(4).select("*", *(F.lit("x").alias(c) for c in ("n", "term", "total", "a", "value", "doc_id")))
    got = divergence.audit(df, least_docs=least, ranks=ranks)
    assert sorted(tuple(r) for r in got.collect()) == apart(docs, least, ranks)


def test_divergence_of_nothing_and_of_the_fixtures(spark):
    assert divergence.audit(empty(spark)).collect() == []
    assert sorted(tuple(r) for r in divergence.audit(crowded(documents(spark)), least_docs=2).collect()) == apart([(r[1], r[2], r[3]) for r in ROWS], 2)


def test_shares_beyond_a_long(spark):
    cases = [(0, 0, 1), (1, 2, 3), (10**12, 10**15, 10**6), (9 * 10**17, 9 * 10**17, 10**7), (2, 3, 0), (9223372031, 9223372036, 1)]
    got = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i long, c long, t long, k long").where("t + 5 * k > 0").select("i", divergence.share(F.col("c"), F.col("t"), F.col("k"))).collect()
    assert dict((r[0], r[1]) for r in got) == {i: 1 + 10**9 * (c + 5) // (t + 5 * k) for i, (c, t, k) in enumerate(cases) if t + 5 * k > 0}


# --- twins
DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_operators_match_their_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(oracle.ORACLES[name]).df()
    got = queries.QUERIES[name](spark, str(DATA)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    told = lambda df: sorted(map(str, df[columns].astype(object).itertuples(index=False, name=None)))
    assert told(got) == told(want)
