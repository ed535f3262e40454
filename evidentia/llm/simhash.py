"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

Fingerprints: 64-bit sums over XXH64 hashes of word shingles.  Grouping: every
two different fingerprints within the radius meet in at least one bucket of equal
bit blocks; buckets are compared in tiles, bit plane by bit plane, with carry-save
counters over 64 lanes at a time, and words of lanes that have all left the
radius are abandoned.  Only a spanning forest of each comparison leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import by_size, cut, partitions, roots, small_batches, stored, texts_of
from evidentia.llm.components import components

WORD = r"[^\x20\x09-\x0D]+"
_SPACES = {c: " " for c in range(9, 14)}
_LOWER = {c: chr(c + 32) for c in range(65, 91)}
BITS = 64
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str | None) -> list[str]:
    """The words of a text, A-Z lowered."""
    return [w for w in (text or "").translate(_SPACES | _LOWER).split(" ") if w]


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of one text; null, empty and blank texts have 0."""
    words = words_of(text)
    if not words:
        return 0
    spans = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(" ".join(s), 42) for s in spans], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per row of docs; fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "t", 4 << 20):
            made = np.array([fingerprint(x, shingle) for x in texts_of(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind.simpleString()}, fp long")


#: Equal bits of a bucket at least, and fingerprints in one that chance may bring together.
LEAST_BITS, CHANCE = 20, 256


def bits_for(n: int) -> int:
    """Equal bits with which n fingerprints, were they random, come CHANCE to a bucket at most."""
    return max(LEAST_BITS, (n // CHANCE).bit_length())


def blocks_for(radius: int, bits: int = LEAST_BITS) -> tuple[int, int]:
    """(blocks, equal): the fewest blocks of which `equal` agree within the radius, with at least `bits` equal bits."""
    for n in range(radius + 1, BITS + 1):
        if (n - radius) * (BITS // n) >= bits:
            return n, n - radius
    return BITS, BITS - radius


def bucket_masks(radius: int, bits: int = LEAST_BITS) -> list[int]:
    """The bits that a bucket has in common, one mask for each choice of blocks."""
    n, equal = blocks_for(radius, bits)
    edges = [BITS * i // n for i in range(n + 1)]
    one = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(one, equal)]


def sliced_links(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, radius: int, words: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), lo[i] <= j < hi[i], whose fingerprints differ in `radius` bits at most.

    A unit of work is a query i and a word of 64 lanes j.  Bit planes of the lanes
    are xor-ed with the query's bit; a carry-save counter with one saturating
    overflow plane adds them up.
    """
    n = len(fps)
    if not n:
        return
    padded = np.zeros(-(-n // 64) * 64, dtype=np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)
    depth = (radius + 1).bit_length()  # planes of the counter; beyond them `over` is set
    first, last = lo // 64, (hi + 63) // 64
    many = np.where(hi > lo, last - first, 0)
    ends = np.cumsum(many)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + words, "right")))
        take = many[start:stop]
        q = np.repeat(np.arange(start, stop), take)
        w = np.arange(len(q)) - np.repeat(np.cumsum(take) - take, take) + first[q]
        start = stop
        if not len(q):
            continue
        low, high = np.clip(lo[q] - w * 64, 0, 64).astype(np.uint64), np.clip(hi[q] - w * 64, 0, 64).astype(np.uint64)
        below = lambda k: np.where(k >= 64, _ONES, (np.uint64(1) << (k & np.uint64(63))) - np.uint64(1))
        live = below(high) & ~below(low)
        count = [np.zeros(len(q), dtype=np.uint64) for _ in range(depth)]
        over = np.zeros(len(q), dtype=np.uint64)
        for p in range(BITS):
            carry = planes[p][w] ^ (np.uint64(0) - ((fps[q] >> np.uint64(p)) & np.uint64(1)))
            for k in range(depth):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if p % 8 == 7:
                out = over | _exceeds(count, radius)
                keep = np.flatnonzero(live & ~out)
                if len(keep) < 0.7 * len(q) or p == BITS - 1:
                    q, w, live, over, count = q[keep], w[keep], live[keep], over[keep], [c[keep] for c in count]
                    if not len(q):
                        break
        if len(q):
            hit = live & ~(over | _exceeds(count, radius))
            at, lane = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[at], w[at] * 64 + lane


def _exceeds(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above the radius."""
    more, same = np.zeros(len(count[0]), dtype=np.uint64), np.full(len(count[0]), _ONES)
    for k in reversed(range(len(count))):
        if radius >> k & 1:
            same = same & count[k]
        else:
            more, same = more | same & count[k], same & ~count[k]
    return more


def _compare(fps: np.ndarray, side: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside groups; rows come sorted by group and side, side 2 is a tile against itself."""
    n = len(fps)
    idx = np.arange(n)
    change = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    end = np.r_[change[1:], n][np.searchsorted(change, idx, "right") - 1]
    turn = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])])
    side_end = np.r_[turn[1:], n][np.searchsorted(turn, idx, "right") - 1]
    lo = np.where(side == 2, idx + 1, side_end)
    hi = np.where(side == 1, lo, end)
    root = idx
    for a, b in sliced_links(fps, lo, hi, radius):
        root = roots(np.r_[np.flatnonzero(root != idx), a], np.r_[root[root != idx], b], n)
    moved = np.flatnonzero(root != idx)
    return fps[moved], fps[root[moved]]


def fingerprint_links(fps: DataFrame, radius: int = 4, tile: int = 1024) -> DataFrame:
    """(a, b): edges between different fingerprints of column fp that connect whatever lies within the radius.

    Every link within the radius has a path of returned edges, and each returned
    edge joins fingerprints connected by such links.  Buckets share more bits the
    more fingerprints there are, so that chance does not fill them.
    """
    spark = fps.sparkSession
    parts = partitions(spark)
    masks = bucket_masks(radius, bits_for(fps.count()))
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(x - (1 << 64) if x >> 63 else x)).alias("k")) for i, x in enumerate(masks)])
    dealt = fps.select("fp", F.inline(keys))
    shared = dealt.groupBy("m", "k").agg(F.count("*").alias("n")).where("n > 1").select(F.col("m").alias("m_"), F.col("k").alias("k_"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    met = dealt.join(cut(shared), (F.col("m") == F.col("m_")) & (F.col("k") == F.col("k_")))
    mine = F.pmod(F.xxhash64("fp", "k"), F.col("tiles")).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda j: F.struct(F.least(F.col("t"), j).alias("x"), F.greatest(F.col("t"), j).alias("y"), F.when(F.col("t") == j, 2).when(F.col("t") < j, 0).otherwise(1).cast("tinyint").alias("side")),
    )
    rows = met.withColumn("t", mine).select("fp", "m", "k", F.inline(tiles)).select("fp", F.xxhash64("m", "k", "x", "y").alias("g"), "side")
    rows = rows.repartition(parts, "g").sortWithinPartitions("g", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def work(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _compare(cols[0].view(np.uint64), cols[2], cols[1], radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def columns() -> list[np.ndarray]:
            return [np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in range(3)]

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 17:
                cols = columns()
                whole = int(np.searchsorted(cols[1], cols[1][-1]))  # the last group may go on
                if whole:
                    yield work([c[:whole] for c in cols])
                    held, size = [pa.RecordBatch.from_arrays([pa.array(c[whole:]) for c in cols], ["fp", "g", "side"])], len(cols[0]) - whole
        if size:
            yield work(columns())

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for every row of docs.

    Texts are compared with A-Z lowered; null, empty and blank texts have
    fingerprint zero and group with each other.  component_id is the smallest
    non-null id of the group (null if it has none); rows with the same id are
    separate rows of the result.  kept holds for the group's smallest id, or for
    every row of a group without ids.  Other columns of docs are ignored.
    """
    assert 0 <= radius < BITS and comb(*blocks_for(radius)) < 5000
    hashed = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = cut(hashed.groupBy("fp").agg(F.min("id").alias("least")))
    groups = components(fingerprint_links(classes.select("fp"), radius))
    joined = classes.join(groups, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(joined)
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    labelled = cut(rooted.select("fp", "root").join(least, "root").select(F.col("fp").alias("fp_"), "component_id"))
    out = hashed.join(labelled, F.col("fp") == F.col("fp_"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
