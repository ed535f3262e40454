"""Removal of passages that an earlier document holds, by a logarithmic family of sparse suffix arrays.

A suffix is sampled if its head, HEAD bytes long, has the smallest hash among the
heads of some window of `least` bytes (an anchor).  Equal windows choose equal
anchors, so every repeat of `least` bytes or more runs through a sampled suffix.
An entry of the index is such a suffix, up to the end of the anchor's last window,
and the bytes before it, backwards, to the start of the first one.

1. Units of about two megabytes of text are the batches.  Every unit says which
   heads it has; heads that only one document has can start no match, and their
   suffixes are not indexed.
2. A unit's remaining entries are sorted: its suffix array, one run per bucket of
   heads.  In its bucket a run enters a logarithmic family of levels: it is
   merge-scanned with the levels that are not larger, neighbours in suffix order
   that are equal throughout are decided for the smallest document, and the merged
   run is the new level.
3. In the last array of a bucket, the longest common prefixes of neighbours say
   which suffixes agree on how many bytes, and those of the entries in order of
   what stands before them on how many bytes before; together they give, for each
   window of an entry, the entries that hold it too.
4. Units cut out what was found.

A head with very many entries (the border of a passage that a large part of all
documents has) would fill one bucket: each of its windows is an entry of its own
then, dealt by its own hash; the result is the same.  Hashes only deal and sample:
what counts as equal was compared byte by byte.  Nothing leaves a task that is
larger than the entries of its texts.

Index keeps the levels as tables, so that later batches meet earlier ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import by_size, give_back, mix, partitions, serve, small_batches, stored, sweep

HEAD = 16
UNIT_BYTES = 2 << 20
#: Windows of a unit of which the heads are hashed at a time.
SLICE = 1 << 17
#: Entries of a head from which on its windows are dealt by their own hash.
MANY = 4096
#: Order of a null id: after every other; and of what an earlier batch holds: before every other.
LAST, EARLIER = np.iinfo(np.int64).max, np.iinfo(np.int64).min
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: What an answer to a unit says: entries gone, parts of entries gone, windows gone, heads that others share.
GONE, PART, WINDOW, SHARED = 1, 2, 3, 4


class Unit(NamedTuple):
    """Texts end to end: document k is buf[ends[k - 1]:ends[k]]."""

    buf: np.ndarray
    ends: np.ndarray
    docs: np.ndarray


class Anchors(NamedTuple):
    at: np.ndarray
    lo: np.ndarray  # first window
    hi: np.ndarray  # last window
    doc: np.ndarray  # the document's id
    head: np.ndarray
    cover: np.ndarray  # hash of all that the windows cover
    first: np.ndarray  # the anchor with the same cover in the smallest document of the unit, the first of those


def words8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the end.  It is a view, one byte apart, so it takes no more room than buf."""
    return np.ndarray(len(buf), "<u8", np.r_[buf, np.zeros(8, dtype=np.uint8)], 0, (1,))


def head_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A light hash of the 16 bytes of two words8."""
    h = second * _M2
    h ^= h >> np.uint64(29)
    h += first
    h *= _M1
    h ^= h >> np.uint64(32)
    h *= _M2
    return h


def range_hash(w: np.ndarray, start: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """Hashes of buf[start:end], 8 to `most` bytes long, from words8."""
    h = mix((end - start).astype(np.uint64) * _M1)
    for k in range(0, most, 8):
        h = mix(h ^ w[np.minimum(start + k, end - 8)]) + _M2
    return h


def firsts(buf: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, doc: np.ndarray, most: int) -> np.ndarray:
    """For each range of buf the row with the same bytes in the smallest document, the first of those.

    key is a hash of the range; rows that it brings together are compared byte by
    byte, and one that differs from its group's first stands for itself.
    """
    order = np.lexsort((doc, key))
    if not len(order):
        return order
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    rows = np.flatnonzero(out != np.arange(len(out)))
    view = np.lib.stride_tricks.sliding_window_view(np.r_[buf, np.zeros(most, dtype=np.uint8)], most)
    for at in range(0, len(rows), 1 << 15):
        part = rows[at : at + (1 << 15)]
        other = out[part]
        same = (size[part] == size[other]) & ((view[start[part]] == view[start[other]]) | (np.arange(most) >= size[part][:, None])).all(axis=1)
        out[part[~same]] = part[~same]
    return out


def _chosen(w: np.ndarray, count: int, span: int) -> np.ndarray:
    """For each of `count` windows the position of its head with the smallest hash; w is words8 of the text."""
    out = np.empty(count, dtype=np.int32)
    for start in range(0, count, SLICE):
        many = min(SLICE, count - start) + span - 1
        best = head_hash(w[start : start + many], w[start + 8 : start + 8 + many])
        best &= np.uint64(0xFFFFFFFF00000000)
        best |= np.arange(many, dtype=np.uint64)
        wide = 1
        while wide * 2 <= span:
            best = np.minimum(best[:-wide], best[wide:])
            wide *= 2
        if wide < span:
            best = np.minimum(best[: len(best) - (span - wide)], best[span - wide :])
        out[start : start + len(best)] = (best & np.uint64(0xFFFFFFFF)).astype(np.int32) + start
    return out


def anchors(unit: Unit, least: int) -> Anchors:
    """All anchors of a unit's documents, in order of position."""
    span = least - HEAD + 1
    n = len(unit.buf)
    count = n - 8 - span + 1
    starts = np.r_[0, unit.ends[:-1]] if len(unit.ends) else np.zeros(0, dtype=np.int64)
    if count <= 0:
        none = np.zeros(0, dtype=np.int64)
        return Anchors(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    w = words8(unit.buf)
    at = _chosen(w, count, span)
    ok = np.zeros(n + 1, dtype=np.int8)  # windows inside one document
    long = unit.ends - starts >= least
    ok[starts[long]] += 1
    ok[unit.ends[long] - least + 1] -= 1
    ok = np.cumsum(ok[: len(at)], dtype=np.int8).astype(bool)
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (at[1:] != at[:-1])
    first[starts[long & (starts < len(ok))]] = True
    last = ok.copy()
    last[:-1] &= ~ok[1:] | first[1:]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    at = at[lo].astype(np.int64)
    end = hi + least
    cover = range_hash(w, lo, end, 2 * least) ^ mix((at - lo).astype(np.uint64))
    doc = unit.docs[np.searchsorted(unit.ends, lo, "right")]
    same = firsts(unit.buf, lo, end - lo, cover, doc, 2 * least)
    same = np.where(at - lo == (at - lo)[same], same, np.arange(len(at)))
    return Anchors(at, lo, hi, doc, head_hash(w[at], w[at + 8]), cover, same)


def own_windows(unit: Unit, a: Anchors, index: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """(position, document, hash, first) of every window of some anchors; first is the row that stands for equal ones."""
    many = a.hi[index] - a.lo[index] + 1
    at = np.repeat(a.lo[index] - np.cumsum(many) + many, many) + np.arange(many.sum())
    doc = np.repeat(a.doc[index], many)
    key = range_hash(words8(unit.buf), at, at + least, least) if len(at) else np.zeros(0, dtype=np.uint64)
    return at, doc, key, firsts(unit.buf, at, np.full(len(at), least), key, doc, least)


# --- suffix arrays


def records(buf: np.ndarray, at: np.ndarray, forward: np.ndarray, backward: np.ndarray, least: int) -> np.ndarray:
    """Entries as byte strings that sort in suffix order: `forward` bytes from `at` on, then `backward` bytes before it, the last first.

    Bytes are one higher than in the text, as zero is what follows an end.
    """
    width, back = least, least - HEAD
    padded = np.r_[np.zeros(back, dtype=np.uint8), buf, np.zeros(width, dtype=np.uint8)]
    out = np.empty((len(at), width + back), dtype=np.uint8)
    ahead = np.lib.stride_tricks.sliding_window_view(padded[back:], width)
    before = np.lib.stride_tricks.sliding_window_view(padded, back)
    for k in range(0, len(at), 1 << 16):
        s = slice(k, k + (1 << 16))
        out[s, :width] = (ahead[at[s]] + 1) * (np.arange(width) < forward[s][:, None])
        out[s, width:] = (before[at[s]][:, ::-1] + 1) * (np.arange(back) < backward[s][:, None])
    return out.view(f"S{width + back}").reshape(-1)


class Run(NamedTuple):
    """A suffix array: entries in suffix order."""

    key: np.ndarray
    doc: np.ndarray
    unit: np.ndarray
    index: np.ndarray

    def take(self, i: np.ndarray) -> Run:
        return Run(*(x[i] for x in self))


def as_bytes(key: np.ndarray) -> np.ndarray:
    return key.view(np.uint8).reshape(len(key), key.dtype.itemsize)


def common(rows: np.ndarray) -> np.ndarray:
    """The longest common prefix of each row of bytes with the one before it; of the first, zero."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64)
    differ = rows[1:] != rows[:-1]
    return np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])]


def merged(a: Run, b: Run) -> Run:
    """Two suffix arrays as one; of equal entries those of `a` come first."""
    to_b = np.searchsorted(a.key, b.key, "right") + np.arange(len(b.key))
    of_a = np.ones(len(a.key) + len(b.key), dtype=bool)
    of_a[to_b] = False
    out = []
    for x, y in zip(a, b, strict=True):
        both = np.empty(len(of_a), dtype=x.dtype)
        both[of_a], both[to_b] = x, y
        out.append(both)
    return Run(*out)


class Family:
    """Levels of suffix arrays; each level is more than twice as long as the one after it."""

    def __init__(self) -> None:
        self.levels: list[Run] = []
        self.decided: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, run: Run) -> None:
        while self.levels and len(self.levels[-1].key) <= 2 * len(run.key):
            run = self._scanned(merged(self.levels.pop(), run))
        self.levels.append(run)

    def _scanned(self, run: Run) -> Run:
        """Neighbours that are equal throughout: where a smaller document holds the entry, the others are decided and leave."""
        if len(run.key) < 2:
            return run
        new = np.r_[True, run.key[1:] != run.key[:-1]]
        start = np.flatnonzero(new)
        least = np.minimum.reduceat(run.doc, start)[np.cumsum(new) - 1]
        owner = run.doc == least
        if owner.all():
            return run
        self.decided.append((run.unit[~owner], run.index[~owner]))
        return run.take(owner)

    def finish(self) -> Run:
        """One array of all levels."""
        while len(self.levels) > 1:
            self.levels.append(self._scanned(merged(self.levels.pop(), self.levels.pop())))
        return self.levels[0]


def partly(run: Run, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, first, last): the windows, by how many bytes before the suffix they start, of entries that a smaller document holds."""
    rows = as_bytes(run.key)
    ahead, before = rows[:, :least], rows[:, least:]
    forward, backward = (ahead > 0).sum(axis=1), (before > 0).sum(axis=1)
    agree = common(ahead)
    order = np.argsort(np.ascontiguousarray(before).view(f"S{before.shape[1]}").reshape(-1), kind="stable")
    agree_before = common(before[order])
    gone = np.zeros((len(rows), before.shape[1] + 2), dtype=np.int8)
    place = np.empty(len(rows), dtype=np.int64)
    for k in range(before.shape[1] + 1):
        has = np.flatnonzero((forward >= least - k) & (backward >= k))
        if len(has) < 2:
            continue
        place[order] = np.cumsum(agree_before < k)
        both = np.cumsum(agree < least - k)[has] * (len(rows) + 1) + place[has]
        by = np.argsort(both, kind="stable")
        new = np.r_[True, np.diff(both[by]) != 0]
        doc = run.doc[has][by]
        smallest = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
        gone[has[by[doc > smallest]], k + 1] = 1
    turn = np.diff(gone, axis=1, append=0)
    row, first = np.nonzero(turn == 1)
    last = np.nonzero(turn == -1)[1]
    return row, first, last - 1


# --- what travels


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte planes apart, compressed."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out


def _pack_run(key: np.ndarray, doc: np.ndarray, index: np.ndarray) -> bytes:
    text = zstandard.ZstdCompressor(level=3).compress(key.tobytes())
    return len(text).to_bytes(4, "little") + text + _pack(doc, index.astype("<i4"))


def _unpack_run(data: bytes, unit: int, least: int) -> Run:
    size = int.from_bytes(data[:4], "little")
    key = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 : 4 + size]), dtype=f"S{2 * least - HEAD}")
    doc, index = _unpack(data[4 + size :], "<i8", "<i4")
    return Run(key, doc, np.full(len(key), unit), index.astype(np.int64))


def units_of(docs: DataFrame, id_col: str, text_col: str, unit_bytes: int = UNIT_BYTES, carry: bool = False) -> DataFrame:
    """(unit, rows, data, rest): documents packed into units.

    rows holds ids, lengths and which ids are null; rest all columns of the rows as
    an Arrow stream if `carry` is set.
    """
    small_batches(docs.sparkSession)
    more = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col] + [F.col(text_col).isNull().alias("null")] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("suffix")
        part, made, texts, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        others: list[pa.RecordBatch] = []
        squeeze = zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            nulls = [i is None for i in ids]
            head = np.array([[LAST if i is None else i for i in ids], list(map(len, texts)), nulls], dtype="<i8")
            rest = _stream(others) if carry else None
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made]), pa.array([head.tobytes()]), pa.array([squeeze.compress(b"".join(texts))]), pa.array([rest], pa.binary())], ["unit", "rows", "data", "rest"])

        for batch in by_size(batches, "t", unit_bytes):
            if carry:
                others.append(pa.RecordBatch.from_arrays(batch.columns[2:], batch.schema.names[2:]))
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1])
            if size >= unit_bytes:
                yield flush()
                texts, ids, others, size, made = [], [], [], 0, made + 1
        if ids:
            yield flush()
            texts, ids, others = [], [], []
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"), *more)
    return stored(rows.mapInArrow(run, "unit long, rows binary, data binary, rest binary"), "suffix-units")


def _stream(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _unit(rows: bytes, data: bytes, rest: bytes | None) -> tuple[Unit, np.ndarray, bytes | None]:
    head = np.frombuffer(rows, dtype="<i8").reshape(3, -1)
    buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    return Unit(buf, np.cumsum(head[1]), head[0]), head[2].astype(bool), rest


def _each_unit(units: DataFrame, results: DataFrame | None, work: Callable, schema: T.StructType | str, carry: bool = False) -> DataFrame:
    """work(unit id, unit, null ids, other columns, results) for every unit; results (unit, kind, payload) are brought to it."""
    texts = units.select("unit", F.lit(0).alias("kind"), "rows", "data", F.col("rest") if carry else F.lit(None).cast("binary").alias("rest"))
    if results is None:
        met = texts
    else:
        more = results.select("unit", "kind", F.lit(None).cast("binary").alias("rows"), F.col("payload").alias("data"), F.lit(None).cast("binary").alias("rest"))
        met = texts.unionByName(more).repartition(partitions(units.sparkSession), "unit").sortWithinPartitions("unit", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("suffix")
        now, found = None, []
        for batch in batches:
            for unit, kind, rows, data, rest in zip(*batch.columns, strict=True):
                if kind.as_py() == 0:
                    if now is not None:
                        yield from work(now[0], *_unit(*now[1:]), found)
                    now, found = (unit.as_py(), rows.as_py(), data.as_py(), rest.as_py()), []
                else:
                    found.append((kind.as_py(), data.as_py()))
        if now is not None:
            yield from work(now[0], *_unit(*now[1:]), found)
        now, found = None, []
        give_back()

    return met.mapInArrow(run, schema)


_TO_BUCKETS, _TO_UNITS = "unit long, bucket long, payload binary", "unit long, kind int, payload binary"


def _per_bucket(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """work(bucket, list of (unit, payload)) for every bucket; buckets are spread over all partitions."""
    dealt = rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("suffix")
        now, held = None, []
        for batch in batches:
            for unit, bucket, payload in zip(batch.column("unit").to_pylist(), batch.column("bucket").to_pylist(), batch.column("payload"), strict=True):
                if bucket != now and held:
                    yield from work(now, held)
                    held = []
                now = bucket
                held.append((unit, payload.as_py()))
        if held:
            yield from work(now, held)
            held = []
        give_back()

    return dealt.mapInArrow(run, schema)


def _dealt(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) by the low bits: anchors are chosen for small heads, so the top bits of those are mostly zero."""
    if not len(hashes):
        return
    bucket = (hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0])
    for x, y in zip(cuts, np.r_[cuts[1:], len(order)], strict=True):
        yield int(bucket[order[x]]), order[x:y]


def _rows(name: int, buckets: list[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name] * len(buckets), pa.int64()), pa.array(buckets, pa.int64()), pa.array(payload, pa.binary())], ["unit", "bucket", "payload"])


def _answers(parts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    units, kinds, payloads = zip(*parts, strict=True) if parts else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(kinds, pa.int32()), pa.array(payloads, pa.binary())], ["unit", "kind", "payload"])


def _by_unit(unit: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(unit, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(unit[order]) != 0]) if len(order) else []
    for a, b in zip(start, np.r_[start[1:], len(order)], strict=True) if len(order) else ():
        yield int(unit[order[a]]), [c[order[a:b]] for c in columns]


# --- heads


def _heads_of(a: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(heads in order, how many entries each has, whether of several documents, place of each entry's head) of a unit's entries."""
    own = np.flatnonzero(a.first == np.arange(len(a.at)))
    order = own[np.argsort(a.head[own], kind="stable")]
    if not len(order):
        return a.head[:0], own, own.astype(bool), own
    new = np.r_[True, np.diff(a.head[order]) != 0]
    start = np.flatnonzero(new)
    several = np.minimum.reduceat(a.doc[order], start) != np.maximum.reduceat(a.doc[order], start)
    place = np.full(len(a.at), -1, dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    # anchors that another one stands for have its head
    return a.head[order][start], np.diff(np.r_[start, len(order)]), several, place[a.first]


def _heads(units: DataFrame, least: int, bits: int) -> DataFrame:
    """(unit, bucket, payload): the heads of each unit."""

    def work(name: int, unit: Unit, nulls: np.ndarray, rest: bytes | None, found: list) -> Iterator[pa.RecordBatch]:
        heads, times, several, _ = _heads_of(anchors(unit, least))
        buckets, payload = [], []
        for b, i in _dealt(heads, bits):
            buckets.append(b)
            payload.append(_pack(np.diff(heads[i] >> np.uint64(16), prepend=np.uint64(0)), np.minimum(times[i], 0xFFFF).astype("<u2"), several[i].astype("u1")))
        yield _rows(name, buckets, payload)

    return _each_unit(units, None, work, _TO_BUCKETS)


def _shared(bucket: int, held: list[tuple[int, bytes]], most: int) -> Iterator[pa.RecordBatch]:
    """To each unit, which of its heads are of several documents, and which of those have very many entries."""
    parts = [_unpack(p, "<u8", "<u2", "u1") for _, p in held]
    head = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    times, several = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (1, 2))
    order = np.argsort(head, kind="stable")
    new = np.r_[True, np.diff(head[order]) != 0]
    start, group = np.flatnonzero(new), np.cumsum(new) - 1
    many = np.diff(np.r_[start, len(order)])
    shared = (many > 1) | (np.add.reduceat(several[order], start) > 0)
    hot = shared & (np.add.reduceat(times[order], start) > most)
    flag = np.empty(len(order), dtype=np.uint8)
    flag[order] = (shared + hot)[group]
    cuts = np.cumsum([len(p[0]) for p in parts])
    yield _answers([(unit, SHARED, bucket.to_bytes(8, "little") + _pack(f)) for (unit, _), f in zip(held, np.split(flag, cuts[:-1]), strict=True)])


def _flags(a: Anchors, found: list[tuple[int, bytes]], bits: int) -> np.ndarray:
    """Per anchor: 0 if its head is of one document, else 1, or 2 if it has very many entries."""
    heads, _, _, place = _heads_of(a)
    told = {int.from_bytes(p[:8], "little"): _unpack(p[8:], "u1")[0] for kind, p in found if kind == SHARED}
    flag = np.zeros(len(heads), dtype=np.uint8)
    for b, i in _dealt(heads, bits):
        flag[i] = told[b]
    return flag[place] if len(heads) else np.zeros(len(a.at), dtype=np.uint8)


# --- entries


def _entries(units: DataFrame, shared: DataFrame | None, least: int, bits: int) -> DataFrame:
    """(unit, bucket, payload): the suffix array of each unit, by buckets of heads; all of its suffixes if `shared` is not given."""
    every = shared is None

    def work(name: int, unit: Unit, nulls: np.ndarray, rest: bytes | None, found: list) -> Iterator[pa.RecordBatch]:
        a = anchors(unit, least)
        flag = np.ones(len(a.at), dtype=np.uint8) if every else _flags(a, found, bits)
        own = np.flatnonzero((a.first == np.arange(len(a.at))) & (flag == 1))
        buckets, payload = [], []

        def deal(key: np.ndarray, doc: np.ndarray, index: np.ndarray, hashes: np.ndarray, base: int) -> None:
            order = np.argsort(key, kind="stable")
            for b, i in _dealt(hashes[order], bits):
                i = order[i]
                buckets.append(base + b)
                payload.append(_pack_run(key[i], doc[i], index[i]))

        deal(records(unit.buf, a.at[own], a.hi[own] + least - a.at[own], a.at[own] - a.lo[own], least), a.doc[own], own, a.head[own], 0)
        at, doc, key, first = own_windows(unit, a, np.flatnonzero((flag == 2) & (a.doc == a.doc[a.first])), least)
        one = np.flatnonzero(first == np.arange(len(at)))
        deal(records(unit.buf, at[one], np.full(len(one), least), np.zeros(len(one), dtype=np.int64), least), doc[one], one, key[one], 1 << bits)
        yield _rows(name, buckets, payload)

    return _each_unit(units, shared, work, _TO_BUCKETS)


def _family(held: list[tuple[int, bytes]], least: int) -> tuple[Family, Run]:
    family = Family()
    for unit, payload in held:
        run = _unpack_run(payload, unit, least)
        family.add(run._replace(doc=np.full(len(run.doc), EARLIER)) if unit < 0 else run)
    return family, family.finish()


def _resolve(bucket: int, held: list[tuple[int, bytes]], least: int, bits: int) -> Iterator[pa.RecordBatch]:
    """To each unit, what smaller documents hold of its entries."""
    family, run = _family(held, least)
    window = bucket >= 1 << bits
    parts = []
    if family.decided:
        unit, index = (np.concatenate(x) for x in zip(*family.decided, strict=True))
        parts += [(u, WINDOW if window else GONE, _pack(np.sort(i).astype("<i4"))) for u, (i,) in _by_unit(unit, index)]
    if not window:
        row, first, last = partly(run, least)
        parts += [(u, PART, _pack(i.astype("<i4"), x.astype("u1"), y.astype("u1"))) for u, (i, x, y) in _by_unit(run.unit[row], run.index[row], first, last)]
    yield _answers(parts)


def _told(found: list[tuple[int, bytes]], kind: int, *kinds: str) -> list[np.ndarray]:
    parts = [_unpack(data, *kinds) for k, data in found if k == kind]
    return [np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, dtype=np.int64) for i in range(len(kinds))]


def removed(unit: Unit, least: int, bits: int, found: list[tuple[int, bytes]], all_heads: bool = False) -> np.ndarray:
    """A flag for every byte of the unit."""
    a = anchors(unit, least)
    gone = np.zeros(len(a.at), dtype=bool)
    gone[_told(found, GONE, "<i4")[0]] = True
    gone = gone[a.first] | (a.doc > a.doc[a.first])
    starts, ends = [a.lo[gone]], [a.hi[gone] + least]
    # parts: of the entry, and of the anchors of the same document for which it stands
    index, first, last = _told(found, PART, "<i4", "u1", "u1")
    order = np.argsort(a.first, kind="stable")
    x, y = (np.searchsorted(a.first[order], index, side) for side in ("left", "right"))
    many = y - x
    of = np.repeat(np.arange(len(index)), many)
    member = order[np.repeat(x - np.cumsum(many) + many, many) + np.arange(many.sum())]
    starts.append(a.at[member] - last[of])
    ends.append(a.at[member] - first[of] + least)
    if not all_heads:
        flag = _flags(a, found, bits)
        at, doc, _, one = own_windows(unit, a, np.flatnonzero((flag == 2) & (a.doc == a.doc[a.first])), least)
        out = np.zeros(len(at), dtype=bool)
        out[_told(found, WINDOW, "<i4")[0]] = True
        repeated = at[out[one] | (doc > doc[one])]
        starts.append(repeated)
        ends.append(repeated + least)
    edge = np.zeros(len(unit.buf) + 1, dtype=np.int32)
    for step, places in ((1, starts), (-1, ends)):
        for x in places:
            np.add.at(edge, x, np.int32(step))
    return np.cumsum(edge[:-1], dtype=np.int32, out=edge[:-1]) > 0


def _bits(units: DataFrame) -> int:
    """Bits of buckets: enough that each has the entries of a few units only, and all partitions work."""
    return max(1, (max(3 * partitions(units.sparkSession), units.count() // 2) - 1).bit_length())


def find_repeats(docs: DataFrame, id_col: str, text_col: str, least: int, carry: bool = False, most: int = MANY) -> tuple[DataFrame, DataFrame, int]:
    """(units, results, bits): results (unit, kind, payload) say what to remove."""
    assert least >= HEAD + 8
    units = units_of(docs, id_col, text_col, carry=carry)
    bits = _bits(units)
    shared = stored(_per_bucket(_heads(units, least, bits), partial(_shared, most=most), _TO_UNITS), "suffix-heads")
    sweep(docs.sparkSession)
    found = stored(_per_bucket(_entries(units, shared, least, bits), partial(_resolve, least=least, bits=bits), _TO_UNITS), "suffix-matches")
    sweep(docs.sparkSession)
    return units, shared.unionByName(found), bits


def _digests(units: DataFrame, results: DataFrame, least: int, bits: int, id_col: str, all_heads: bool = False) -> DataFrame:
    def work(name: int, unit: Unit, nulls: np.ndarray, rest: bytes | None, found: list) -> Iterator[pa.RecordBatch]:
        gone = removed(unit, least, bits, found, all_heads)
        rows, start = [], 0
        for doc, end, null in zip(unit.docs.tolist(), unit.ends.tolist(), nulls.tolist(), strict=True):
            flags = gone[start:end]
            spans = int(flags[:1].sum()) + int((flags[1:] & ~flags[:-1]).sum())
            rows.append((None if null else doc, end - start, int(flags.sum()), spans, hashlib.sha256(unit.buf[start:end][~flags].tobytes()).hexdigest()))
            start = end
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [*[pa.int64()] * 4, pa.string()], strict=True)], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _each_unit(units, results, work, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50, most: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of docs.

    A byte is removed if it lies in a string of `least` bytes that also starts in a
    document with a smaller id; all is judged on the input.  Ids are integers; null
    ids are larger than all others and equal to each other, as are repeated ids,
    so rows with the same id keep what only they share.  Texts are UTF-8; null and
    empty ones have no bytes.  Other columns are ignored.
    """
    units, results, bits = find_repeats(docs, id_col, text_col, least, most=most)
    return _digests(units, results, least, bits, id_col)


def trim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 50) -> DataFrame:
    """docs with the characters removed from text_col whose bytes dedup() removes, all of them.

    Characters that are removed in part stay whole.  A null text stays null; rows,
    other columns and their order stay as they are.
    """
    units, results, bits = find_repeats(docs, id_col, text_col, least, carry=True)
    place, columns = docs.columns.index(text_col), docs.columns
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)]

    def work(name: int, unit: Unit, nulls: np.ndarray, rest: bytes | None, found: list) -> Iterator[pa.RecordBatch]:
        gone, texts, start = removed(unit, least, bits, found), [], 0
        for end in unit.ends.tolist():
            own, flags = unit.buf[start:end], gone[start:end]
            heads = np.flatnonzero((own & 0xC0) != 0x80)
            if len(heads):
                flags = np.repeat(np.logical_and.reduceat(flags, heads), np.diff(np.r_[heads, len(own)]))
            texts.append(own[~flags].tobytes().decode())
            start = end
        others = pa.ipc.open_stream(rest).read_all().combine_chunks()
        by_name = {n: others.column(n).combine_chunks() for n in others.schema.names}
        is_null = by_name.pop("null")
        text = pa.array([None if z else t for t, z in zip(texts, is_null.to_pylist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([text if i == place else by_name[f.name] for i, f in enumerate(fields)], [f.name for f in fields])

    out = _each_unit(units, results, work, T.StructType(fields), carry=True)
    return out.toDF(*columns)


class Index:
    """Suffix arrays of the batches so far, in levels that are tables (bucket, payload) of the shared folder.

    A batch is judged against itself and all earlier batches, whose documents come
    before its own whatever their ids.  Its suffix arrays are merge-scanned against
    the levels; then they become a level, and while the level above is not more
    than twice as long, the two are merged.  As a later batch may repeat anything,
    all sampled suffixes stay: about 3.7 bytes for each byte of text, compressed.
    """

    def __init__(self, bits: int, least: int = 50) -> None:
        self.bits, self.least = bits, least
        self.levels: list[tuple[int, DataFrame]] = []

    def _merged(self, runs: DataFrame) -> tuple[int, DataFrame]:
        """One run per bucket of (unit, bucket, payload), and how many entries there are; of equal entries one stays."""
        least = self.least

        def work(bucket: int, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            family = Family()
            for _, payload in held:
                family.add(_unpack_run(payload, 0, least))
            key = np.unique(family.finish().key)
            none = np.zeros(len(key), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([len(key)]), pa.array([_pack_run(key, none, none)], pa.binary())], ["bucket", "n", "payload"])

        made = stored(_per_bucket(runs, work, "bucket long, n long, payload binary"), "suffix-level")
        return made.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], made

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """What dedup() gives for the rows of a batch, and the batch joins the index."""
        least, bits = self.least, self.bits
        units = units_of(docs, id_col, text_col)
        runs = stored(_entries(units, None, least, bits), "suffix-runs")
        met = runs
        for i, (_, level) in enumerate(self.levels):
            met = met.unionByName(level.select(F.lit(-1 - i).cast("long").alias("unit"), "bucket", "payload"))
        found = stored(_per_bucket(met, partial(_resolve, least=least, bits=bits), _TO_UNITS), "suffix-matches").where("unit >= 0")
        n, made = self._merged(runs)
        while self.levels and self.levels[-1][0] <= 2 * n:
            both = [level.select(F.lit(i).cast("long").alias("unit"), "bucket", "payload") for i, level in enumerate((self.levels.pop()[1], made))]
            n, made = self._merged(both[0].unionByName(both[1]))
        self.levels.append((n, made))
        return _digests(units, found, least, bits, id_col, all_heads=True)
