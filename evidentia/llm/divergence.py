"""Audit of how sources of a language differ in their words.

Counts of a term become one wide vector indexed by the language's sources; array
functions turn it into smoothed shares and emit each pair's contribution, which is
summed where it arises before anything moves.  All shares are integers.  Terms are
counted from the bytes of texts in Arrow batches, a few times faster than as arrays
of strings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.llm.common import broadcast_few, cut, partitions, small_batches, stored

#: A term: letters, and all that is not ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A share of 1, and what is added to each count.
UNIT, PRIOR = 1_000_000_000, 5
#: Terms that a task counts before it hands them on.
MOST_TERMS = 300_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_TERM, _OTHER = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")


def _parts(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in parts of about `size` bytes, cut where no term is."""
    at = 0
    while at < len(text):
        cut_at = _OTHER.search(text, at + size)
        end = cut_at.start() if cut_at else len(text)
        yield text[at:end]
        at = end


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, n_docs): occurrences, and documents that have the term; a few rows of a term for each task.

    Terms are found in the UTF-8 bytes, of which all beyond ASCII belong to terms.
    """
    small_batches(docs.sparkSession)
    schema = "lang string, source string, term string, n long, n_docs long"

    def counted(groups: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, n_docs) in groups.items():
            terms = pa.array(list(n), pa.binary()).cast(pa.string())
            same = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(terms), dtype=np.int32))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*same, terms, pa.array(n.values(), pa.int64()), pa.array(map(n_docs.__getitem__, n), pa.int64())], ["lang", "source", "term", "n", "n_docs"])
        groups.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                n, n_docs = groups.setdefault(key, (Counter(), Counter()))
                seen, before = set(), len(n)
                for part in _parts((texts[i].as_py() or b"").translate(_LOWER)):
                    terms = _TERM.findall(part)
                    n.update(terms)
                    seen.update(terms)
                n_docs.update(seen)
                held += len(n) - before
                if held >= MOST_TERMS:
                    yield from counted(groups)
                    held = 0
        yield from counted(groups)

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (count + PRIOR) / (total + PRIOR * kept)), exact; as a decimal where a long is too short."""
    floor = lambda kind: F.call_function("div", (count + PRIOR).cast(kind) * F.lit(UNIT).cast(kind), (total + kept * PRIOR).cast(kind))
    return F.when(count < (1 << 63) // UNIT - PRIOR, floor("bigint")).otherwise(floor("decimal(19,0)")) + 1


def wide_terms(docs: DataFrame, least_docs: int, lang_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(langs, terms): langs (lang, kept, total, sides) has a language's sources in order with their totals; terms (lang, term, counts, shares, share) the kept terms, arrays as sides."""
    # dealt by term alone, so that all that follows has its rows at hand
    dealt = term_counts(docs, lang_col, source_col, text_col).repartition(partitions(docs.sparkSession), "lang", "term")
    counted = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    kept = stored(counted.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.collect_list(F.struct("source", "n")).alias("cells")).where(F.col("n_docs") >= least_docs), "kept-terms")
    groups = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    counts = kept.select("lang", F.inline("cells")).unionByName(groups.withColumn("n", F.lit(0).cast("long")))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sides = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("sides"), F.sum("total").alias("total"))
    number = kept.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("kept"))
    langs = cut(sides.join(number, F.col("lang") == F.col("l"), "left").select("lang", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), "total", "sides"))
    few = broadcast_few(langs.select(F.col("lang").alias("l"), "kept", "total", "sides"))
    rows = kept.join(few, F.col("lang") == F.col("l")).withColumn("by", F.map_from_entries("cells"))
    rows = rows.withColumn("counts", F.transform("sides", lambda s: F.coalesce(F.try_element_at("by", s["source"]), F.lit(0).cast("long"))))
    shares = F.zip_with("counts", "sides", lambda c, s: share(c, s["total"], F.col("kept")))
    whole = share(F.aggregate("counts", F.lit(0).cast("long"), lambda t, c: t + c), F.col("total"), F.col("kept"))
    return langs, rows.select("lang", "term", F.transform("sides", lambda s: s["source"]).alias("sources"), "counts", shares.alias("shares"), whole.alias("share"))


def _pairs(sources: str, value: Callable[[Column, Column], Column]) -> Column:
    """(a, b, value) of each two of an array of sources."""
    size = F.size(sources)
    later = lambda i: F.sequence(i + 1, size - 1)
    each = lambda i: F.transform(later(i), lambda j: F.struct(F.get(sources, i).alias("a"), F.get(sources, j).alias("b"), value(i, j).alias("value")))
    return F.flatten(F.transform(F.sequence(F.lit(0), size - 2), each))


def audit(docs: DataFrame, least_docs: int = 30, ranks: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) of each language and source in docs.

    A language keeps the terms that at least `least_docs` of its documents have.
    Part pair: for each other source of the language, how far their shares of all
    kept terms are apart in sum; without kept terms 0.  Part term: the terms whose
    share is furthest above the language's, to rank `ranks`.  Equal values go by
    item.  A null text, language or source is the empty one, and every row counts
    as a document, whatever its id; other columns are ignored.  The sources of one
    language are held as an array; a text is read in parts, so only its different
    terms are held.
    """
    langs, terms = wide_terms(docs, least_docs, lang_col, source_col, text_col)
    terms = stored(terms, "wide-terms")
    apart = terms.where(F.size("sources") > 1).select("lang", F.inline(_pairs("sources", lambda i, j: F.abs(F.get("shares", i) - F.get("shares", j)))))
    # every two sources once with nothing, so that languages without terms have them too
    bare = langs.where(F.size("sides") > 1).select("lang", F.transform("sides", lambda s: s["source"]).alias("sources")).select("lang", F.inline(_pairs("sources", lambda i, j: F.lit(0).cast("long"))))
    summed = apart.unionByName(bare).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = summed.select("lang", "value", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
    above = F.filter(F.arrays_zip("sources", "counts", "shares"), lambda x: (x["counts"] > 0) & (x["shares"] > F.col("share")))
    more = terms.select("lang", F.col("term").alias("item"), "share", F.explode(above).alias("x")).select("lang", F.col("x.sources").alias("source"), "item", (F.col("x.shares") - F.col("share")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    ranked = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(*columns)
    return ranked.unionByName(more.withColumn("rank", rank).where(F.col("rank") <= ranks).withColumn("part", F.lit("term")).select(*columns))
