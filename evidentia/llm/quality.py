"""Quality rules: surface counts, then a hashed n-gram likelihood ratio.

Every document gets the mean, over its word unigrams and bigrams, of
log p_target - log p_raw.  Both are multinomials over hash buckets: p_raw counts
every document and adds one, p_target counts the documents of a bounded labelled
sample that are labelled good, with p_raw as its prior.  One threshold, set from the
scores of all other labelled documents, decides every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import broadcast_few, by_size, mix, serve, small_batches, stored

#: log2 of the number of hash buckets; the model on the driver has that many rows.
BUCKET_BITS = 14
#: Good labelled documents that the model is fitted on at most; the threshold is set from all that it is not fitted on.
MAX_LABELLED = 20_000
#: Step of the scores of which the threshold's quantiles are told.
STEP = 0.001
#: Share of the good documents that the threshold may reject before the margin is taken off.
LOWEST = 0.001
#: Part of the distance between the good and bad medians that is left as a margin.
MARGIN = 0.1
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


class Rules(NamedTuple):
    min_words: int = 50
    max_repeat_percent: int = 50


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur at least twice; ids number the distinct words from 0."""
    n = len(ids) - 2
    if n < 2:
        return 0
    pair = ids[:-1] * distinct + ids[1:]
    if distinct > 1 << 20:  # three ids would not fit in 63 bits
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    window = pair[:-1] * distinct + ids[2:]
    order = np.argsort(window, kind="stable")
    ordered = window[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, dtype=bool)
    for k in range(3):
        covered[k : n + k] |= twice
    return int(covered.sum())


class Words(NamedTuple):
    """A text's words as numbers: ids by first occurrence, and the distinct words."""

    ids: np.ndarray
    distinct: list[bytes]


def words_of(data: bytes) -> Words:
    seen: dict[bytes, int] = {}
    return Words(np.array([seen.setdefault(w, len(seen)) for w in data.split()], dtype=np.int64), list(seen))


def base_counts(data: bytes, words: Words) -> tuple[int, int, int, int, int]:
    """The columns of BASE for one text in UTF-8."""
    spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [x for x in data.split(b"\n") if x.strip()] if b"\n" in data else []
    chars = len(data.decode()) - spaces
    symbols = sum(map(data.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    return len(words.ids), chars, symbols, len(lines) - len(set(lines)), repeated_words(words.ids, len(words.distinct))


def grams(words: Words, bits: int = BUCKET_BITS) -> np.ndarray:
    """Bucket of every word and every pair of neighbouring words, A-Z lowered."""
    h = np.array([xxhash.xxh64_intdigest(w.lower()) for w in words.distinct], dtype=np.uint64)[words.ids]
    pairs = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])
    return (np.r_[h, pairs] >> np.uint64(64 - bits)).astype(np.int64)


def labelled(labels: DataFrame, most: int = MAX_LABELLED) -> tuple[DataFrame, DataFrame]:
    """(sample, rest): good documents (l_id) for the model, `most` at most, and all labelled ones (l_id, good) of the other half of ids.

    The halves are by a hash of the id; ids that are null or have labels of both
    kinds, or other ones, count as unlabelled.
    """
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    one = one.where("lo = hi and lo in (0, 1)").select(F.col("doc_id").alias("l_id"), (F.col("lo") == 1).alias("good"), (F.xxhash64("doc_id", F.lit("fold")) % 2 == 0).alias("fitted"))
    one = stored(one, "labelled")
    return one.where("good and fitted").orderBy(F.xxhash64("l_id"), "l_id").limit(most).select("l_id"), one.where("not fitted").select("l_id", "good")


def fit(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, bits: int = BUCKET_BITS) -> np.ndarray:
    """log p_target - log p_raw for every bucket; zeros without a good document."""
    small_batches(docs.sparkSession)
    good = F.broadcast(sample.select("l_id", F.lit(True).alias("target")))  # MAX_LABELLED rows at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).join(good, F.col("id") == F.col("l_id"), "left").select("t", F.coalesce("target", F.lit(False)).alias("target"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("quality")
        total = np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in by_size(batches, "t", 4 << 20):
            for data, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data:
                    found = np.bincount(grams(words_of(data), bits), minlength=1 << bits)
                    total[0] += found
                    if target:
                        total[1] += found
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0][used]), pa.array(total[1][used])], ["bucket", "raw", "target"])

    counted = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    table = np.zeros((2, 1 << bits))
    for r in counted.collect():  # as many rows as there are buckets at most
        table[:, r["bucket"]] = r["raw"], r["target"]
    if not table[1].any():
        return np.zeros(1 << bits)
    raw, target = table
    p_raw = (raw + 1) / (raw.sum() + (1 << bits))
    p_target = (target + (1 << bits) * p_raw) / (target.sum() + (1 << bits))
    return np.log(p_target) - np.log(p_raw)


def score(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str, bits: int = BUCKET_BITS, carry: bool = False) -> DataFrame:
    """(id, BASE, llr) per row of docs; llr is null without words.  carry: all columns of docs follow, as c0, c1 ..."""
    spark = docs.sparkSession
    small_batches(spark)
    table = spark.sparkContext.broadcast(ratio)  # 2**bits doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serve("quality")
        for batch in by_size(batches, "t", 4 << 20):
            rows = []
            for data in batch.column(1).to_pylist():
                words = words_of(data or b"")
                rows.append((*base_counts(data or b"", words), float(table.value[grams(words, bits)].mean()) if len(words.ids) else None))
            kinds = [pa.int64()] * 5 + [pa.float64()]
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[2:]], [f.name for f in schema])

    more = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)] if carry else []
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"), *more)
    fields = [rows.schema["id"], *(T.StructField(x.split()[0], T.LongType()) for x in BASE.split(", ")), T.StructField("llr", T.DoubleType()), *rows.schema.fields[2:]]
    schema = T.StructType(fields)
    return rows.mapInArrow(run, schema)


def threshold(scored: DataFrame, rest: DataFrame) -> float | None:
    """The score below which a document is rejected; None if there are none of a class, or the good ones don't score higher.

    The LOWEST quantile of the good scores, less a MARGIN of the distance between
    the medians, so that clean documents unlike the sample still pass.  Quantiles
    are over all of `rest`, to a step of STEP: counts of steps come to the driver,
    as many as scores, which are logarithms of ratios of shares, can have.
    """
    met = scored.select("id", F.floor(F.col("llr") / STEP).cast("long").alias("step")).where("step is not null").join(rest, F.col("id") == F.col("l_id"))
    steps: dict[bool, list[tuple[int, int]]] = {True: [], False: []}
    for r in met.groupBy("good", "step").agg(F.count("*").alias("n")).orderBy("step").collect():
        steps[r["good"]].append((r["step"], r["n"]))
    if not steps[True] or not steps[False]:
        return None

    def quantile(good: bool, share: float) -> float:
        at, ends = zip(*steps[good], strict=True)
        ends = np.cumsum(ends)
        return at[int(np.searchsorted(ends, share * ends[-1], "left"))] * STEP

    middle, bad = quantile(True, 0.5), quantile(False, 0.5)
    return quantile(True, LOWEST) - MARGIN * (middle - bad) if middle > bad else None


def _verdict(scored: DataFrame, least: float | None, rules: Rules) -> DataFrame:
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    verdict = ~failed if least is None else ~failed & (F.col("llr") >= F.lit(least))
    return scored.withColumns({"base_failed": failed, "kept": verdict, "min_llr": F.lit(least).cast("double")})


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, BASE, base_failed, kept, llr, min_llr) for every row of docs.

    A null or empty text has no words, so it fails the base rules and has a null
    llr.  Without labels of both classes nothing fails on llr.  Rows with the same
    id are judged one by one; a null id never counts as labelled.  Other columns
    are ignored.
    """
    sample, rest = labelled(labels)
    scored = stored(score(docs, fit(docs, sample, id_col, text_col), id_col, text_col), "quality")
    judged = _verdict(scored, threshold(scored, rest), rules)
    return judged.select(F.col("id").alias(id_col), *(x.split()[0] for x in BASE.split(", ")), "base_failed", "kept", "llr", "min_llr")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that quality() keeps, with all their columns.

    The labelled documents that set the threshold are scored ahead, so that no
    text is stored.
    """
    sample, rest = labelled(labels)
    ratio = fit(docs, sample, id_col, text_col)
    asked = broadcast_few(rest.select(F.col("l_id").alias("_asked")))
    ahead = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(asked, F.col("id") == F.col("_asked"), "left_semi")
    least = threshold(stored(score(ahead, ratio, "id", "t"), "quality"), rest)
    kept = _verdict(score(docs, ratio, id_col, text_col, carry=True), least, rules).where("kept")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
