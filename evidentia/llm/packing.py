"""Packing of token sequences by bounded-space online best fit.

Every task keeps a fixed number of open sequences.  A bitset over free space
finds the tightest one that takes a piece; where none does, a new one opens and,
beyond the bound, the fullest closes.  What is still open at a task's end goes to
the next round, where several tasks' remains meet, until one round is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import by_size, cut, small_batches, stored, texts_of
from evidentia.llm.tokens import MAX_WORDS, encoder

#: Open sequences of a task.
OPEN = 64
#: Tasks whose remains meet in one task of the next round.
FAN_IN = 16


class BestFit:
    """Open bins of one capacity by free space; items are any objects with a length."""

    def __init__(self, capacity: int, most: int = OPEN) -> None:
        self.capacity, self.most = capacity, most
        self.bins: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.bits, self.open = 0, 0

    def _take(self, free: int) -> list:
        found = self.bins[free].pop()
        if not self.bins[free]:
            self.bits ^= 1 << free
        self.open -= 1
        return found

    def add(self, item: object, length: int) -> Iterator[list]:
        """Place an item; yields the bins that close."""
        fits = self.bits >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            chosen = self._take(free)
        else:
            free, chosen = self.capacity, []
        chosen.append(item)
        free -= length
        if not free:
            yield chosen
            return
        if not self.bins[free]:
            self.bits |= 1 << free
        self.bins[free].append(chosen)
        self.open += 1
        if self.open > self.most:
            yield self._take((self.bits & -self.bits).bit_length() - 1)

    def rest(self) -> list[list]:
        """The bins that are open still, fullest first."""
        return [b for found in self.bins for b in found]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str, words: int = MAX_WORDS) -> DataFrame:
    """(part, id, piece, start, length, crc): the pieces of every row of docs, part by part of the scan."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, words), TaskContext.get().partitionId()
        end = np.array([end_id], dtype=np.dtype("<u4"))
        for batch in by_size(batches, "t", 4 << 20):
            rows: list[list] = [[] for _ in range(5)]
            for k, found in enumerate(encode.encode(texts_of(batch.column(1)))):
                data = memoryview(np.concatenate([found.astype("<u4"), end]).tobytes())
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at : at + 4 * capacity]
                    for column, x in zip(rows, (k, piece, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows[0]), pa.int32()), batch.column(0).take(pa.array(rows[0])), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], ["part", "id", "piece", "start", "length", "crc"])

    fields = [("part", T.IntegerType()), ("id", kind), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("crc", T.LongType())]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def _round(rows: DataFrame, number: int, capacity: int, most: int, last: bool) -> DataFrame:
    """Pack the rows of each partition: rows and (seq, offset); a null seq is left over for the next round."""
    schema = T.StructType([*rows.schema.fields, T.StructField("seq", T.LongType()), T.StructField("offset", T.LongType())])

    size = rows.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, made = BestFit(capacity, most), 0
        base = (number << 58) | (TaskContext.get().partitionId() << 34)

        def rows_of(bins: list[list], kinds: list[pa.DataType], closed: bool) -> pa.RecordBatch:
            nonlocal made
            out = []
            for b in bins:
                at = 0
                for row in b:
                    out.append((*row, base + made if closed else None, at))
                    at += row[size]
                made += closed
            columns = zip(*out, strict=True) if out else [[]] * (len(kinds) + 2)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.int64(), pa.int64()], strict=True)], [f.name for f in schema])

        kinds: list[pa.DataType] = []
        for batch in batches:
            closed, kinds = [], batch.schema.types
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                closed += fit.add(row, row[size])
            yield rows_of(closed, kinds, True)
        if kinds:
            yield rows_of(fit.rest(), kinds, last)

    return rows.mapInArrow(run, schema)


def pack_pieces(rows: DataFrame, capacity: int, most: int = OPEN, fan_in: int = FAN_IN) -> DataFrame:
    """rows (part, ..., length) with sequence_id and offset; a sequence's offsets are gapless from 0.

    Each part is packed on its own, then what it left open with that of fan_in - 1
    other parts, and so on; a round sees fan_in times `most` sequences at most.
    """
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    packed, number, done = rows, 0, []
    while True:
        last = parts <= 1
        packed = cut(_round(packed if number == 0 else packed.repartition(parts, "part"), number, capacity, most, last))
        done.append(packed.where("seq is not null"))
        if last:
            break
        parts, number = -(-parts // fan_in), number + 1
        packed = packed.where("seq is null").drop("seq", "offset").withColumn("part", F.floor(F.col("part") / fan_in).cast("int"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("seq", "sequence_id")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", most: int = OPEN, words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece.

    A document is its ids and the end id; only one longer than `capacity` is cut.
    A null or empty text is the end id alone.  Rows with equal or null ids are
    separate documents.  Other columns are ignored.  A worker's cache keeps up to
    twice `words` words, which is a matter of memory and time only.
    """
    made = stored(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, words), "pieces")
    out = pack_pieces(made, capacity, most)
    return out.select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
