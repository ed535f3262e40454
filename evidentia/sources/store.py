"""A keyed table on Parquet files with upserts: buckets of keys, copied on write, under a manifest.

    data/<commit>/bucket=<b>/...   what a commit wrote: whole buckets
    manifests/<number>.json        which commit each bucket is read from, and what was applied

A commit writes the buckets that it changes beside the old ones, and then its
manifest, which must not be there yet: readers see all of it or nothing, and of two
writers at the same number one fails.  A stopped commit leaves files that no
manifest names.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.plans.lineage import cut


class ConflictError(RuntimeError):
    """Another writer has made the next manifest meanwhile."""


class Manifest(NamedTuple):
    number: int
    schema: T.StructType
    key: str
    buckets: int
    #: By bucket, the commit whose files hold it.
    files: dict[str, str]
    #: By writer, the last batch that is in.
    applied: dict[str, int]

    def text(self) -> str:
        return json.dumps({"schema": self.schema.jsonValue(), "key": self.key, "buckets": self.buckets, "files": self.files, "applied": self.applied})


def _fs(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _publish(spark: SparkSession, path: str, manifest: Manifest) -> None:
    """Write the manifest beside its place and move it there, unless there is one."""
    fs, target = _fs(spark, f"{path}/manifests/{manifest.number:012d}.json")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(manifest.text().encode()))
    out.close()
    try:
        moved = not fs.exists(target) and fs.rename(draft, target)
    except Py4JJavaError:
        moved = False
    if not moved:
        fs.delete(draft, False)
        raise ConflictError(f"manifest {manifest.number} is there already")


def current(spark: SparkSession, path: str) -> Manifest:
    """The newest manifest."""
    fs, folder = _fs(spark, f"{path}/manifests")
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    name = max(n for n in names if n.endswith(".json") and not n.startswith("."))
    read = json.loads(spark.read.text(f"{path}/manifests/{name}", wholetext=True).first()[0])
    return Manifest(int(name[:-5]), T.StructType.fromJson(read["schema"]), read["key"], read["buckets"], read["files"], read["applied"])


def create(spark: SparkSession, path: str, schema: T.StructType, key: str = "id", buckets: int = 64) -> None:
    """An empty store at path for rows of `schema`, one for each value of `key`."""
    assert key in schema.names and "bucket" not in schema.names and buckets > 0
    _publish(spark, path, Manifest(0, schema, key, buckets, {}, {}))


def _read(spark: SparkSession, path: str, manifest: Manifest, buckets: list[str]) -> DataFrame:
    there = [f"{path}/data/{manifest.files[b]}/bucket={b}" for b in buckets if b in manifest.files]
    return spark.read.schema(manifest.schema).parquet(*there) if there else spark.createDataFrame([], manifest.schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the newest commit."""
    manifest = current(spark, path)
    return _read(spark, path, manifest, sorted(manifest.files))


def upsert(rows: DataFrame, path: str, order: list[str] | None = None, replace: bool = False, writer: str | None = None, batch: int | None = None) -> int:
    """Put rows into the store at path; gives how many are new or changed.

    Of rows with the same key the first by `order` counts (all columns, if it is
    not given).  A key that is there already keeps its row, or gets the new one if
    `replace`.  Rows without a key are an error.  A batch number of a writer that
    is not above its last one is in already: nothing happens, so foreachBatch may
    run it again.  Only buckets with new keys are read and written.
    """
    spark = rows.sparkSession
    before = current(spark, path)
    if writer is not None and batch is not None and batch <= before.applied.get(writer, -1):
        return 0
    key, names = before.key, before.schema.names
    first = F.row_number().over(Window.partitionBy(key).orderBy(*(order or [c for c in names])))
    given = rows.withColumn("_rank", first).where("_rank = 1").select(*(F.col(f.name).cast(f.dataType) for f in before.schema.fields))
    given = cut(given.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(before.buckets)).cast("int")))
    told = given.groupBy("bucket").agg(F.count_if(F.col(key).isNull()).alias("bad")).collect()  # a row per bucket
    if any(r["bad"] for r in told):
        raise ValueError(f"rows without a {key}")
    touched = sorted(str(r["bucket"]) for r in told)
    there = _read(spark, path, before, touched)
    own = there.select(F.struct(*names).alias("old"), F.col(key).alias("_key"))
    met = given.join(own, F.col(key) == F.col("_key"), "left")
    changed = F.col("_key").isNull() | ((F.struct(*names) != F.col("old")) if replace else F.lit(False))
    taken = cut(met.where(F.coalesce(changed, F.lit(True))).select(*names, "bucket"))
    count = taken.count()
    files = dict(before.files)
    if count:
        commit = uuid.uuid4().hex
        hit = sorted(str(r["bucket"]) for r in taken.select("bucket").distinct().collect())
        kept = [_read(spark, path, before, [b]).withColumn("bucket", F.lit(int(b))) for b in hit if b in before.files]
        kept = reduce(DataFrame.unionByName, kept).join(taken.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti") if kept else taken.limit(0)
        kept.unionByName(taken).repartition(min(len(hit), before.buckets), "bucket").write.partitionBy("bucket").parquet(f"{path}/data/{commit}")
        files |= dict.fromkeys(hit, commit)
    applied = before.applied | ({writer: batch} if writer is not None and batch is not None else {})
    if count or applied != before.applied:
        _publish(spark, path, before._replace(number=before.number + 1, files=files, applied=applied))
    return count


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the buckets that the newest manifest does not read; gives their number. No other writer may be at work."""
    fs, folder = _fs(spark, f"{path}/data")
    if not fs.exists(folder):
        return 0
    named = {f"{commit}/bucket={b}" for b, commit in current(spark, path).files.items()}
    each = [(c.getPath().getName(), b.getPath()) for c in fs.listStatus(folder) for b in fs.listStatus(c.getPath()) if b.isDirectory()]
    gone = [b for c, b in each if f"{c}/{b.getName()}" not in named]
    for b in gone:
        fs.delete(b, True)
    return len(gone)
