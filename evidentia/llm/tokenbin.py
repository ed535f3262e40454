"""Token ids in binary images: one id array, document ends in Elias-Fano code.

An image is a header, the Elias-Fano code of the running ends of its documents,
and the concatenated ids.  Images are rows of a Parquet table that Spark writes
and commits, so a lost task leaves nothing behind; (part, shard) orders them by
document id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from pyspark import TaskContext

from evidentia.llm.common import by_size, partitions, small_batches, stored, texts_of
from evidentia.llm.tokens import encoder

MAGIC = b"EVTOK1\0\0"
_HEAD = struct.Struct("<8sQQBB6x")
#: An image is closed when it has this many ids.
IMAGE_IDS = 1 << 17
#: One select pointer for so many documents.
EVERY = 256


class EliasFano:
    """A sorted sequence of unsigned integers with select.

    The low bits of every value lie packed; the high bits are a bit vector with a
    one at high + index.  A pointer to every EVERY-th one starts a select.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, pointers: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.pointers = n, low_bits, low, high, pointers

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        flags = np.zeros((int(ones[-1]) + 8) // 8 * 8 if n else 0, dtype=np.uint8)
        flags[ones] = 1
        return cls(n, width, np.packbits(bits.astype(np.uint8), bitorder="little"), np.packbits(flags, bitorder="little"), ones[::EVERY].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBxxxIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.pointers)) + self.low.tobytes() + self.high.tobytes() + self.pointers.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The code at the start of data, and its length in bytes."""
        n, width, low, high, pointers = struct.unpack_from("<QBxxxIII", data)
        at = struct.calcsize("<QBxxxIII")
        parts = []
        for size, kind in ((low, np.uint8), (high, np.uint8), (pointers, np.dtype("<u4"))):
            parts.append(np.frombuffer(data, dtype=kind, count=size, offset=at))
            at += parts[-1].nbytes
        return cls(n, width, *parts), at

    def _low(self, i: int, j: int) -> np.ndarray:
        first = i * self.low_bits
        part = self.low[first // 8 : (j * self.low_bits + 7) // 8]
        bits = np.unpackbits(part, bitorder="little")[first % 8 : first % 8 + (j - i) * self.low_bits].reshape(j - i, self.low_bits)
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The value at index i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.pointers[i // EVERY]), i % EVERY
        byte, seen = at // 8, -int(np.unpackbits(self.high[at // 8 : at // 8 + 1], bitorder="little")[: at % 8].sum())
        while True:
            part = np.flatnonzero(np.unpackbits(self.high[byte : byte + 64], bitorder="little"))
            if seen + len(part) > left:
                one = byte * 8 + int(part[left - seen])
                return (one - i << self.low_bits) | int(self._low(i, i + 1)[0])
            seen, byte = seen + len(part), byte + 64

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits) | self._low(0, self.n)


def image_of(ids: list[np.ndarray]) -> bytes:
    """The image of the documents' id arrays, all of one unsigned little-endian type."""
    kind = ids[0].dtype if ids else np.dtype("<u2")
    ends = np.cumsum([len(x) for x in ids], dtype=np.uint64)
    head = _HEAD.pack(MAGIC, len(ids), int(ends[-1]) if ids else 0, kind.itemsize, 0)
    return head + EliasFano.of(ends).to_bytes() + b"".join(x.tobytes() for x in ids)


class Image:
    """Reads an image: document i has the ids from ends(i - 1) up to ends(i)."""

    def __init__(self, data: bytes) -> None:
        magic, self.n, self.total, size, _ = _HEAD.unpack_from(data)
        if magic != MAGIC or size not in (2, 4):
            raise ValueError("not a token image")
        view = memoryview(data)
        self.ends, used = EliasFano.from_bytes(view[_HEAD.size :])
        self.ids = np.frombuffer(data, dtype=f"<u{size}", offset=_HEAD.size + used)
        if len(self.ids) != self.total or self.ends.n != self.n:
            raise ValueError("a token image is cut short")

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", image_ids: int = IMAGE_IDS) -> DataFrame:
    """The images of docs in ascending order of (id, text), nulls first: (part, shard, doc_ids, n_tokens, image)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # the texts are dealt out, not the ids: sampling for the ranges must not encode everything once more;
    # the start of the text splits an id that very many rows have
    rows = rows.repartitionByRange(partitions(spark), "id", F.substring("t", 1, 32)).sortWithinPartitions("id", "t")
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
        names, ids, size = [], [], 0

        def flush() -> pa.RecordBatch:
            row = [pa.array([part], pa.int32()), pa.array([shard], pa.int64()), pa.array([names], pa.list_(names_type)), pa.array([size], pa.int64()), pa.array([image_of(ids)], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "shard", "doc_ids", "n_tokens", "image"])

        for batch in by_size(batches, "t", 4 << 20):
            names_type = batch.schema.field(0).type
            end = np.array([end_id], dtype=encode.dtype)
            for name, found in zip(batch.column(0).to_pylist(), encode.encode(texts_of(batch.column(1))), strict=True):
                names.append(name)
                ids.append(np.concatenate([found, end]))
                size += len(found) + 1
                if size >= image_ids:
                    yield flush()
                    names, ids, size, shard = [], [], 0, shard + 1
        if names:
            yield flush()

    fields = [("part", T.IntegerType()), ("shard", T.LongType()), ("doc_ids", T.ArrayType(kind)), ("n_tokens", T.LongType()), ("image", T.BinaryType())]
    return stored(rows.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields])), "token-images")


def read_ids(images: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the images of write_ids."""
    spark = images.sparkSession
    small_batches(spark)
    sizes = {r["part"]: r["n"] for r in images.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each range partition
    bases, total = [], 0
    for part in sorted(sizes):
        bases.append((part, total))
        total += sizes[part]
    base = F.broadcast(spark.createDataFrame(bases, "p int, base long"))
    before = images.select("part", "shard", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = before.join(base, F.col("part") == F.col("p")).select(F.col("part").alias("p"), F.col("shard").alias("s"), (F.col("base") + F.col("before")).alias("start"))
    rows = images.join(before, (F.col("part") == F.col("p")) & (F.col("shard") == F.col("s"))).select("doc_ids", "start", "image")
    kind = images.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                image = Image(batch.column(2)[k].as_py())
                ends = np.array([image.ends.select(i) for i in range(image.n)], dtype=np.int64)
                starts = np.r_[0, ends[:-1]]
                data = memoryview(image.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, pa.array(starts + batch.column(1)[k].as_py()), pa.array(ends - starts), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of docs and read them back: (doc_id, start, n_tokens, ids_crc32) per row.

    A null or empty text has the end id alone.  Rows with equal ids follow each
    other by text, null ids come first.  Other columns are ignored.
    """
    return read_ids(write_ids(docs, tokenizer, end_id, id_col, text_col), id_col)
