"""Ordered operators on streams against the batch ones."""

from __future__ import annotations

import os
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidentia.operators import chunks, evidence
from evidentia.streaming import ordered

SCHEMA = "document_id string, pos int, raw_text string, article string, letter string, number string, subletter string"


def rows(seed):
    r = random.Random(seed)
    some = lambda p, *of: r.choice(of) if r.random() < p else None
    return [(f"d{d}", i, some(0.9, f"line {i}", "x" * 120, f"more {i}"), some(0.15, "1.01", "2.05"), some(0.2, "A", "B"), some(0.3, "1", "2"), some(0.3, "a", "b")) for d in range(4) for i in range(30)]


@pytest.mark.parametrize("cuts", [1, 4])
def test_any_cut_into_batches_gives_what_the_batch_operators_give(spark, tmp_path, cuts):
    data, r = rows(cuts), random.Random(9)
    where = {d: sorted(r.sample(range(1, 30), cuts - 1)) for d in {x[0] for x in data}}
    source = tmp_path / "in"
    for k in range(cuts):
        part = [x for x in data if sum(c <= x[1] for c in where[x[0]]) == k]
        r.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        new = max(source.glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(new, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = str(tmp_path / "out")
    query = ordered.carry(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    df = spark.createDataFrame(data, SCHEMA)
    batch = chunks.recent_short(evidence.clause_cascade(df, "document_id", "pos", *(F.col(c) for c in ordered.LEVELS)), ["document_id"], "pos", "raw_text")
    want = sorted((x["document_id"], x["pos"], x["clause"], tuple(x["preceding"])) for x in batch.collect())
    got = sorted((x["document_id"], x["pos"], x["clause"], tuple(x["preceding"])) for x in spark.read.parquet(out).collect())
    assert got == want and len(got) == 120


class State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_a_timer_lets_an_idle_document_go():
    timers, made = [], []
    handle = SimpleNamespace(getValueState=lambda *_: made.append(State()) or made[-1], listTimers=lambda: iter(timers), deleteTimer=timers.remove, registerTimer=timers.append)
    own = ordered.Carry(1000)
    own.init(handle)
    batch = pd.DataFrame([("d", 0, "short", "1.01", None, None, None)], columns=["document_id", "pos", "raw_text", *ordered.LEVELS])
    for now in (5, 50):
        out = list(own.handleInputRows(("d",), iter([batch]), SimpleNamespace(getCurrentProcessingTimeInMs=lambda now=now: now)))
    assert out[0]["preceding"].tolist() == [["short"]] and timers == [1050]
    assert list(own.handleExpiredTimer(("d",), None, None)) == [] and not any(s.exists() for s in made)
