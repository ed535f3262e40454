"""The keyed store, the content-addressed answers of an extractor, and the source of uploads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from evidentia.sources import plugins, store, uploads

SCHEMA = "id string, n int, t string"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def held(spark, path):
    return sorted(map(tuple, store.read(spark, path).collect()))


def made(spark, tmp_path):
    path = str(tmp_path / "store")
    store.create(spark, path, rows(spark).schema, buckets=4)
    return path


def test_upserts(spark, tmp_path):
    path = made(spark, tmp_path)
    assert held(spark, path) == [] and store.upsert(rows(spark), path) == 0
    assert store.upsert(rows(spark, ("a", 2, "x"), ("a", 1, "y"), ("b", None, None), ("c", 3, "z")).withColumn("more", F.lit(1)), path, ["n"], writer="w", batch=0) == 3
    first = [("a", 1, "y"), ("b", None, None), ("c", 3, "z")]
    assert held(spark, path) == first
    assert store.upsert(rows(spark, ("z", 9, "again")), path, writer="w", batch=0) == 0 and held(spark, path) == first  # a batch that is run again
    assert store.upsert(rows(spark, ("a", 7, "new"), ("d", 4, "d")), path, writer="w", batch=1) == 1 and held(spark, path) == [*first, ("d", 4, "d")]
    before = store.current(spark, path)
    assert store.upsert(rows(spark, ("a", 7, "new"), ("b", None, None)), path, replace=True) == 1
    after = store.current(spark, path)
    assert held(spark, path) == [("a", 7, "new"), *first[1:], ("d", 4, "d")] and after.applied == {"w": 1}
    assert sum(before.files[b] != after.files[b] for b in after.files) == 1  # the bucket of the changed row alone is written
    with pytest.raises(ValueError, match="without a id"):
        store.upsert(rows(spark, (None, 1, "x")), path)
    assert store.vacuum(spark, path) >= 1 and len(held(spark, path)) == 4


def test_a_stopped_commit_is_not_seen_and_two_writers_conflict(spark, tmp_path, monkeypatch):
    path = made(spark, tmp_path)
    store.upsert(rows(spark, ("a", 1, "x")), path)
    publish = store._publish

    def stopped(*args):
        raise OSError("the writer has died")

    monkeypatch.setattr(store, "_publish", stopped)
    with pytest.raises(OSError, match="died"):
        store.upsert(rows(spark, ("b", 2, "y")), path)
    assert held(spark, path) == [("a", 1, "x")]

    def overtaken(spark_, path_, manifest):
        publish(spark_, path_, manifest)
        publish(spark_, path_, manifest)

    monkeypatch.setattr(store, "_publish", overtaken)
    with pytest.raises(store.ConflictError):
        store.upsert(rows(spark, ("c", 3, "z")), path)
    monkeypatch.setattr(store, "_publish", publish)
    assert held(spark, path) == [("a", 1, "x"), ("c", 3, "z")]
    assert store.upsert(rows(spark, ("b", 2, "y")), path) == 1 and len(held(spark, path)) == 3


def test_answers_are_asked_for_once(spark, tmp_path):
    calls, path = tmp_path / "calls", str(tmp_path / "answers")
    calls.mkdir()

    def extractor(prompt):
        import uuid

        (calls / f"{uuid.uuid4().hex}").write_text(prompt)
        if prompt == "broken" and not (calls.parent / "mended").exists():
            raise ValueError("no answer")
        return {"requirements": [{"id": f"r-{prompt}", "title": "T", "evidence_ids": ["e1"]}], "links": [{"id": "l", "confidence": 0.5, "review_required": True}]}

    def count():
        n = len(list(calls.iterdir()))
        for f in calls.iterdir():
            f.unlink()
        return n

    prompts = lambda *texts: spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "project_section_key string, prompt string")
    found = plugins.extract(prompts("a", "b", "a", None), extractor, path, "m:1")
    assert {(r["project_section_key"], r["id"], r["ord"]) for r in found.requirements.collect()} == {("k0", "r-a", 0), ("k1", "r-b", 0), ("k2", "r-a", 0)}
    assert found.links.first()["confidence"] == 0.5 and found.products.count() == 0
    assert count() == 2
    assert plugins.ask(prompts("b", "a"), extractor, path, "m:1") == 0 and count() == 0
    assert plugins.ask(prompts("b", "a!"), extractor, path, "m:1") == 1 and count() == 1  # a changed prompt
    assert plugins.ask(prompts("b"), extractor, path, "m:2") == 1 and count() == 1  # another version of the model
    many = prompts(*(f"p{i}" for i in range(12)), "broken")
    with pytest.raises(Exception, match="no answer"):
        plugins.ask(many, extractor, path, "m:1", together=1)
    done = spark.read.parquet(path).where("model = 'm:1'").count()
    assert done >= 3
    count()
    (tmp_path / "mended").write_text("")
    assert plugins.ask(many, extractor, path, "m:1", together=1) == 13 - (done - 3) == count()


def test_uploads_are_read_in_groups_by_size(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    sizes = {"a.pdf": 10, "b.PDF": 200, "deep/c.docx": 30, "d.txt": 5, "e.html": 0, "f.pdf": 90}
    for name, n in sizes.items():
        (folder / name).write_bytes(b"x" * n)
    uploads.register(spark)
    df = spark.read.format("uploads").option("path", str(folder)).option("groupBytes", 100).load()
    got = {r["filename"]: (r["file_type"], r["size"], bytes(r["content"]) if r["content"] is not None else None, r["error"] is None) for r in df.collect()}
    assert got == {k.split("/")[-1]: (k.split(".")[-1].lower(), n, b"x" * n, True) for k, n in sizes.items() if k != "d.txt"}
    assert df.rdd.getNumPartitions() == 3  # 200; 90 and 10; 30 and 0
    parsed = spark.read.format("uploads").option("path", str(folder)).option("parser", "tests.test_store:parser").option("scale", "2").load()
    by = {r["filename"]: r for r in parsed.collect()}
    assert [x["text"] for x in by["a.pdf"]["items"]] == ["a.pdf 10 2"] and by["a.pdf"]["content"] is None
    assert by["b.PDF"]["items"] is None and "too large" in by["b.PDF"]["error"]
    with pytest.raises(Exception, match="path"):
        spark.read.format("uploads").load().collect()
    reader = uploads.Reader(df.schema, {"path": str(folder)})
    (group,) = reader.partitions()
    (folder / "f.pdf").unlink()  # gone since
    rows = [x for b in reader.read(group) for x in b.to_pylist()]
    assert {x["filename"] for x in rows if x["error"]} == {"f.pdf"} and len(rows) == 5


def parser(filename, content, **options):
    if len(content) > 100:
        raise ValueError("too large")
    return [{"self_ref": "#/texts/0", "label": "text", "text": f"{filename} {len(content)} {options['scale']}"}]
