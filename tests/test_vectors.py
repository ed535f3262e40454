"""Nearest vectors and the vector index against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from evidentia import schemas
from evidentia.functions import search
from evidentia.operators import index, vector

NAN, INF = float("nan"), float("inf")


def nearest(base, queries, k, unit=True):
    def whole(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v)

    def scaled(v):
        v = np.array(v, dtype=np.longdouble)
        norm = np.sqrt((v * v).sum())
        return v / norm if unit and norm else v

    out = []
    for q, w in queries:
        if whole(w):
            near = sorted((float(np.square(scaled(v) - scaled(w)).sum()), i) for i, v in base if whole(v) and len(v) == len(w))
            out += [(q, i, n + 1, d) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


def same(got, want):
    got = sorted((r["query_id"], r["id"], r["rank"], r["distance"]) for r in got)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(a[3] == pytest.approx(b[3], rel=1e-9, abs=1e-12) for a, b in zip(got, want, strict=True))


def table():
    r = np.random.default_rng(7)
    base = [(i, r.normal(size=6).tolist()) for i in range(60)]
    base += [(100 + i, r.normal(size=9).tolist()) for i in range(150)]  # most have another length
    base += [(300, None), (301, []), (302, [NAN] * 6), (303, [INF] + [1.0] * 5), (304, [None] + [1.0] * 5), (305, [0.0] * 6), (306, base[3][1]), (307, [x * 7 for x in base[3][1]]), (308, [NAN] * 9), (309, [1e200] * 6), (310, [1e-200, 0.0, 0.0, 0.0, 0.0, 0.0]), (311, [4.0])]
    asked = [(0, base[3][1]), (1, base[70][1]), (2, None), (3, [NAN] * 6), (4, [1.0]), (5, [1.0, 2.0]), (6, [0.0] * 6), (7, base[5][1]), (8, [None] * 9), (9, base[100][1]), (10, []), (11, [-INF] * 6), (12, [2e200] * 6)]
    return base, asked


@pytest.mark.parametrize("batch", [1, 7, 10_000])
@pytest.mark.parametrize("unit", [True, False])
def test_any_vectors_in_any_batches(spark, batch, unit):
    base, asked = table()
    if unit:  # all unit vectors are equally far from zero, but for rounding
        asked = [x for x in asked if x[0] != 6]
    else:  # squares of the largest are beyond a double
        base, asked = [x for x in base if x[0] not in (309,)], [x for x in asked if x[0] not in (12,)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        b, q = spark.createDataFrame(base, "id long, embedding array<double>").coalesce(2), spark.createDataFrame(asked, "query_id int, query array<double>")
        same(vector.top_k(b, q, 5, unit=unit).collect(), nearest(base, asked, 5, unit))
    finally:
        spark.conf.set(key, before)


def test_distances_beyond_a_double_are_still_ranked(spark):
    base = spark.createDataFrame([(i, [x, 0.0]) for i, x in enumerate((1e300, 1.0, -1e300, 2.0))], "id int, embedding array<double>")
    got = vector.top_k(base, spark.createDataFrame([(0, [1.5, 0.0])], "query_id int, query array<double>"), 3, unit=False).collect()
    assert [(r["id"], r["distance"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0.25), (3, 0.25), (0, INF)]


def test_queries_in_blocks(spark, monkeypatch):
    base, asked = table()
    b, q = spark.createDataFrame(base, "id long, embedding array<double>"), spark.createDataFrame(asked, "query_id int, query array<double>")
    monkeypatch.setattr(vector, "MOST_NUMBERS", 20)
    monkeypatch.setattr(vector, "QUERY_ROWS", 1)
    assert len(vector.blocks(q, "query_id", vector.MOST_QUERIES, vector.F.size("query"), vector.MOST_NUMBERS)) > 1
    asked = [x for x in asked if x[0] != 6]
    same(vector.top_k(b, q.where("query_id <> 6"), 5).collect(), nearest(base, asked, 5))
    assert vector.top_k(b.limit(0), q, 5).collect() == [] and vector.top_k(b, q.limit(0), 5).collect() == []


def clustered(n=600, size=8, seed=3):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(12, size)) * 4
    return [(i, (middles[i % 12] + r.normal(size=size) * 0.2).tolist()) for i in range(n)]


@pytest.mark.parametrize("unit", [True, False])
def test_index_is_exact_and_grows(spark, tmp_path, unit):
    base, path = clustered(), f"{tmp_path}/index"
    odd = [(1000, None), (1001, [1.0]), (1002, [NAN] * 8), (1003, [0.0] * 8), (1004, base[0][1]), (1005, base[0][1])]
    frame = lambda rows: spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = [(i, base[i][1]) for i in range(0, 600, 25)] + [(-1, None), (-2, [1.0, 2.0]), (-3, [-INF] + [0.0] * 7), (-4, [NAN] * 8), (-5, [9.0] * 8)]
    queries = spark.createDataFrame(asked, "query_id long, query array<double>")
    made = index.create(frame(base), path, unit=unit, lists=24)
    assert index.search(made, queries)[0].collect() == []
    index.add(made, frame(base[:200]), "first")
    same(index.search(made, queries, 5)[0].collect(), nearest(base[:200], asked, 5, unit))
    index.add(made, frame(base[200:] + odd), "second")
    index.add(made, frame(base[200:] + odd), "second")  # again: nothing changes
    again = index.open_index(spark, path)
    hits, report = index.search(again, queries, 5)
    same(hits.collect(), nearest(base + odd, asked, 5, unit))
    told = {r["query_id"]: r for r in report.collect()}
    assert len(told) == len(asked) and told[-1]["lists_read"] == 0 and told[0]["vectors"] == 603
    assert all(told[i]["vectors_read"] < 603 / 3 for i in range(0, 600, 25))


def test_index_ignores_a_batch_that_was_not_finished(spark, tmp_path):
    base = clustered(100)
    frame = lambda rows: spark.createDataFrame(rows, "id long, embedding array<double>")
    made = index.create(frame(base), f"{tmp_path}/i")
    index.add(made, frame(base[:50]), "a")
    index.add(made, frame(base[50:]), "b")
    import shutil

    shutil.rmtree(f"{tmp_path}/i/lists/batch=b")  # as if the writer had died
    queries = spark.createDataFrame([(0, base[60][1])], "query_id int, query array<double>")
    same(index.search(made, queries, 3)[0].collect(), nearest(base[:50], [(0, base[60][1])], 3))
    with pytest.raises(ValueError, match="batch name"):
        index.add(made, frame(base), "a/b")
    with pytest.raises(ValueError, match="no vectors"):
        index.create(frame([(1, None)]), f"{tmp_path}/j")


def test_search_is_a_table_function(spark):
    base = [(i, [float(i % 5), 1.0, 0.5 * i]) for i in range(20)]
    shown = [(f"body {i}", None if i % 3 == 0 else f"f{i}.pdf", f"s{i}", "", i, f" raw {i} " if i % 4 else " ", "near" if i % 2 else None, "H" if i % 5 else "", "", False, "", i if i % 7 else None) for i in range(20)]
    chunk = spark.createDataFrame(shown, schemas.CHUNK)
    b = spark.createDataFrame(base, "id int, embedding array<double>")
    queries = spark.createDataFrame([(q, base[q][1]) for q in (3, 7, 11)] + [(99, [1.0])], "query_id int, query array<double>")
    hits = vector.top_k(b, queries, 6)
    search.register(spark)
    joined = hits.drop("rank").join(chunk, hits["id"] == chunk["chunk_id"])
    got = spark.sql("SELECT * FROM search_results(TABLE({hits}), 4)", hits=joined).collect()
    want = vector.format_results(hits.where("rank <= 4"), chunk).collect()
    assert {(r["query_id"], r["n_results"], r["text"]) for r in got} == {(r["query_id"], 4, r["text"]) for r in want} and len(got) == 3
    assert {r["n_results"] for r in spark.sql("SELECT * FROM search_results(TABLE({hits}))", hits=joined).collect()} == {6}
    lateral = spark.sql("SELECT q.query_id, r.n_results FROM {q} q, LATERAL (SELECT n_results FROM search_results(TABLE({hits}), 2) s WHERE s.query_id = q.query_id) r", q=queries, hits=joined)
    assert sorted(map(tuple, lateral.collect())) == [(3, 2), (7, 2), (11, 2)]
    for call, why in (("TABLE({hits}), 0", "constant of 1"), ("TABLE(SELECT 1 AS query_id)", "lacks columns"), ("5", "takes a table")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM search_results({call})", **({"hits": joined} if "hits" in call else {})).collect()
