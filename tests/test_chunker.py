"""The structural chunker against a loop over pieces."""

from __future__ import annotations

import random

import pytest
import regex
from pyspark.sql import functions as F

from evidentia.operators import chunker

TOKEN = regex.compile(chunker.TOKEN)
SPACED = regex.compile(f"(?:{chunker.TOKEN})[{chunker.WHITE}]*")


def packed(items, budget):
    """(document, pos, text, headings, labels, pages, tokens) by going from piece to piece."""
    out, last = [], None
    for d, _, text, headings, labels, page in sorted(items, key=lambda x: (x[0], x[1])):
        headings, labels = headings or [], labels or []
        taken = len(TOKEN.findall("\n".join(headings)))
        room = max(budget - taken, 1)
        n = len(TOKEN.findall(text or ""))
        spaced = SPACED.findall(text or "")
        parts = [(text, n)] if n <= room else [("".join(spaced[i : i + room]).rstrip(chunker.WHITE), len(spaced[i : i + room])) for i in range(0, n, room)]
        for part, m in parts if n else ():
            if last and last["d"] == d and last["h"] == headings and last["n"] + m <= room:
                last["n"] += m
                last["t"].append(part)
            else:
                last = {"d": d, "h": headings, "n": m, "t": [part], "l": [], "p": [], "taken": taken}
                out.append(last)
            last["l"] += labels
            last["p"] += [page]
    pos: dict = {}
    return sorted((c["d"], pos.setdefault(c["d"], []).append(0) or len(pos[c["d"]]) - 1, "\n".join(c["t"]), c["h"], [*dict.fromkeys(x for x in c["l"] if x)], [*dict.fromkeys(x for x in c["p"] if x is not None)], c["n"] + c["taken"]) for c in out)


def made(seed, documents, most):
    r = random.Random(seed)
    words = ["duct", "fan,", "ß-ring", "2.05", "Müller", "日本語", "a", "x_y", "—", "(note)"]
    items = []
    for d in range(documents):
        heads = []
        for pos in range(r.randint(0, most)):
            if r.random() < 0.1:
                heads = r.sample(["PART 1", "2.01 FANS", "A. Makers", ""], r.randint(0, 3))
            text = r.choice([" ", "\n", "\t "]).join(r.choice(words) for _ in range(r.choice([0, 1, 2, 5, 5, 9, 40]))) + r.choice(["", " ", "\n"])
            items.append((f"d{d}", pos * 2, r.choice([text, text, text, None, " "]), r.choice([heads, heads, heads, None]) if heads else None, r.choice([["text"], ["list", None], None, []]), r.choice([1, 2, None])))
    return items


SCHEMA = "document_id string, pos int, text string, headings array<string>, labels array<string>, page int"


def got(df):
    return sorted((r["document_id"], r["pos"], r["raw_text"], r["headings"], r["labels"], r["pages"], r["n_tokens"]) for r in df.collect())


@pytest.mark.parametrize("budget, documents, most", [(12, 8, 60), (1, 3, 8), (700, 3, 300)])
def test_chunks_are_those_of_a_loop(spark, budget, documents, most):
    items = made(budget, documents, most)
    df = spark.createDataFrame(items, SCHEMA).repartition(3).withColumn("segment", F.lit("x")).withColumn("n", F.lit(0))
    out = got(chunker.chunk(df, budget))
    assert out == packed(items, budget)
    room = {tuple(h): max(budget - len(TOKEN.findall("\n".join(h))), 1) for _, _, _, h, *_ in out}
    assert all(n - len(TOKEN.findall("\n".join(h))) <= room[tuple(h)] for _, _, _, h, _, _, n in out)


def test_one_long_run_and_nothing(spark):
    items = [("d", i, "one two three", None, None, None) for i in range(2000)] + [("e", 0, "w " * 5000, ["H"], ["text"], 1)]
    df = spark.createDataFrame(items, SCHEMA)
    assert got(chunker.chunk(df, 7)) == packed(items, 7)
    assert chunker.chunk(df.limit(0)).collect() == []
    assert chunker.chunk(df.withColumn("text", F.lit(" \n"))).collect() == []
