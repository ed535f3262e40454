"""Lineage cuts, Arrow batch sizes and small helpers the operators share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that carries whole texts to Python.
TEXT_ROWS = 512
#: Bytes from which on such a batch gets no more rows.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary folder; any other
    master has no folder that all executors see, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="evidentia-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder: later stages outlive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder as Parquet and read again; the copy goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Drop the shuffle files of DataFrames that are out of use.

    Spark drops them when the driver's collector meets their handles, which may be
    long after; so it is asked to run once what they led to is stored, and the
    caller has let go of them.
    """
    gc.collect()
    spark._jvm.System.gc()


#: Rows of a few longs that are broadcast at most (about 30 MB as a hash table).
FEW = 500_000


def broadcast_few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, to be broadcast if a count says that it has `most` rows at most; more are left to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lower the session's Arrow batch size to `rows`, and to BATCH_BYTES unless bytes are set already, so that a batch of texts stays small.

    Rows may be units of megabytes, so their number alone bounds nothing.  Spark
    reads the settings when a job runs, so they cannot be put back here: they stay
    for the session's later queries.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


#: What this worker process keeps from one task to the next: by operator, how to let go of it.
KEPT: dict[str, Callable[[], None]] = {}
_serving = [""]


def serve(operator: str) -> None:
    """Tell a worker process which operator's task begins: what others keep goes, and freed memory returns to the system.

    Workers outlive the jobs of an application, so the caches of one operator would
    otherwise stay beside the arrays of the next.
    """
    if _serving[0] != operator:
        for other, forget in KEPT.items():
            if other != operator:
                forget()
        _serving[0] = operator
        gc.collect()
        give_back()


def give_back() -> None:
    """Return freed memory to the system; without it a worker that waits keeps what its largest task took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc only
        ctypes.CDLL(None).malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def by_size(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts in `column` have about `limit` bytes; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        at, total = 0, 0
        for i, n in enumerate(size.tolist()):
            if total and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index of the connected component of each of n nodes under edges a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


#: Characters beyond ASCII that lower() leaves as they are: Latin-1 signs and small letters, punctuation, CJK.
_CASELESS = "\\x{80}-\\x{BF}\\x{DF}-\\x{FF}\\x{2010}-\\x{206F}\\x{3000}-\\x{9FFF}"


def lower_a_to_z(text: str) -> Column:
    """The text column with A to Z in lower case and all else as it is.

    translate() looks up each character, so it is left to texts in which lower()
    could change others.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.col(text).rlike(f"[^\\x00-\\x7F{_CASELESS}]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def words(text: str, pattern: str) -> Column:
    """All matches of the pattern in the lower-cased text; none in a null text."""
    return F.coalesce(F.regexp_extract_all(lower_a_to_z(text), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))
