"""Submittal regions: candidates, ends, and the greedy choice of broad spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import predicates as P
from evidentia.functions import text as X
from evidentia.plans.lineage import cut

_EXACT = r"^\d+\.\d+$"


def _rows(evidence: DataFrame, unicode: bool) -> DataFrame:
    rows = evidence.withColumn("idx", F.row_number().over(Window.partitionBy("document_id").orderBy("pos")) - 1)
    t, clause = X.strip("raw_text"), F.coalesce(X.strip("source_clause"), F.lit(""))
    return rows.withColumns({"t": t, "clause": clause, "heading": F.col("evidence_kind") == "heading", "article": X.article_of("source_clause", "raw_text"), "folded": X.fold("raw_text", unicode)})


def priority() -> Column:
    """How good a start a row is: broad articles before lettered parts of them."""
    t, clause, folded = F.col("t"), F.col("clause"), F.col("folded")
    exact = clause.rlike(_EXACT)
    nested = t.rlike(r"(?U)^[A-Z]\.\s+") | ((clause != "") & ~exact & (F.length(clause) - F.length(F.replace(clause, F.lit("."), F.lit(""))) >= 2))
    value = lambda c, n: F.when(c, n).otherwise(0)
    phrase = F.when(folded.contains("supplemental submittal"), 10).when(folded.rlike(f"(?U){P.SUBMITTAL}"), 5).otherwise(0)
    return value(F.col("heading"), 20) + value(exact, 50) + value(t.rlike(X.ARTICLE), 30) - value(nested, 40) + phrase


def candidates(evidence: DataFrame, unicode: bool = True) -> DataFrame:
    """Starts with priority, inclusive end and warnings.

    A region ends before the first later row of another article (before the first
    numbered heading, if it has no article itself) or PART heading; a SECTION
    heading on the way is a warning.
    """
    return _candidates(_marked(evidence, unicode))


def _marked(evidence: DataFrame, unicode: bool) -> DataFrame:
    """The rows of evidence by their places, with what the search for regions asks of them; made once for all its steps."""
    rows = _rows(evidence, unicode).withColumns({"part": P.part_heading(F.col("heading"), F.col("t")), "boundary": P.section_boundary(F.col("heading"), F.col("t"), "clause")})
    opens = P.submittal_text(F.col("folded"), F.col("t")) & (F.col("heading") | F.col("t").rlike(X.ARTICLE))
    return cut(rows.select("document_id", "idx", "id", "t", "heading", "article", "part", "boundary", opens.alias("opens"), priority().alias("priority")))


def _candidates(marked: DataFrame) -> DataFrame:
    rows = _stops(marked)
    starts = cut(rows.where("opens").select("document_id", F.col("idx").alias("start_index"), F.col("id").alias("start_id"), F.col("t").alias("heading"), F.col("article").alias("own"), "priority", "stop", "last", "seen", "seen_at_end"))
    # the passed SECTION headings by their numbers in the document, which are a run
    sections = rows.where("boundary").select(F.col("document_id").alias("d"), F.col("seen").alias("number"), "idx", "id")
    asked = starts.where("seen_at_end > seen").select("document_id", "start_index", F.explode(F.sequence(F.col("seen") + 1, F.col("seen_at_end"))).alias("n"))
    met = asked.join(sections, (F.col("document_id") == F.col("d")) & (F.col("n") == F.col("number")))
    told = F.transform(F.array_sort(F.collect_list(F.struct("idx", "id"))), lambda x: F.concat(F.lit("ambiguous_section_heading_at_index_"), x["idx"], F.lit(":"), x["id"]))
    passed = met.groupBy(F.col("document_id").alias("d"), F.col("start_index").alias("s")).agg(told.alias("told"))
    none = F.array().cast("array<string>")
    found = starts.join(passed, (F.col("document_id") == F.col("d")) & (F.col("start_index") == F.col("s")), "left")
    told = F.concat(F.coalesce("told", none), F.when(F.col("stop").isNull(), F.array(F.lit("ended_at_catalog_eof"))).otherwise(none), F.when(F.col("priority") < 20, F.array(F.lit("low_priority_candidate_start"))).otherwise(none))
    return found.select(
        "document_id", "start_index", F.coalesce(F.col("stop") - 1, F.col("last")).alias("end_index"), "start_id", "heading", F.col("own").alias("source_clause"), "priority",
        F.when(F.col("own").isNotNull(), "article_clause").otherwise("heading_order_fallback").alias("detection_method"), told.alias("warnings"),
    )


def _stops(rows: DataFrame) -> DataFrame:
    """rows with stop, the row before which a region that starts there ends, and last, the last row of the document.

    seen is the number of SECTION headings up to the row, seen_at_end that up to the
    row before the stop.  Everything is running values along the document, forwards
    or backwards.
    """
    on = Window.partitionBy("document_id").orderBy("idx")
    back = Window.partitionBy("document_id").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    before = on.rowsBetween(Window.unboundedPreceding, -1)
    numbered = F.when(F.col("heading"), X.article_root("t"))
    # of rows with an article, those of another one than the row with an article before: there a run of one article ends
    turns = F.col("article").isNotNull() & (F.col("article") != F.last("article", ignorenulls=True).over(before))
    rows = rows.withColumns({"turns": turns, "numbered": numbered.isNotNull() & (F.col("article").isNotNull() | F.col("part") | F.col("boundary")), "seen": F.count_if("boundary").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    first = lambda c: F.min(F.when(c, F.col("idx"))).over(back)
    rows = rows.withColumns({"next_part": first(F.col("part")), "next_turn": first(F.col("turns")), "next_numbered": first(F.col("numbered")), "last": F.max("idx").over(Window.partitionBy("document_id"))})
    rows = rows.withColumn("stop", F.least("next_part", F.when(F.col("article").isNotNull(), F.col("next_turn")).otherwise(F.col("next_numbered"))))
    upto = rows.select(F.col("document_id").alias("d"), F.col("idx").alias("i"), F.col("seen").alias("seen_at_end"))
    met = rows.join(upto, (F.col("document_id") == F.col("d")) & (F.coalesce(F.col("stop") - 1, F.col("last")) == F.col("i")))
    return met.drop("d", "i", "turns", "numbered", "next_part", "next_turn", "next_numbered")


def outermost(spans: DataFrame, key: str) -> DataFrame:
    """Spans that no other of their key contains; of equal ones that of the highest priority.

    In order of start, the longest first, a span lies in an earlier one exactly if
    the furthest end so far reaches its own.
    """
    before = Window.partitionBy(key).orderBy("start_index", F.desc("end_index"), F.desc("priority")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end_index").over(before)
    return spans.withColumn("_reach", reach).where("_reach is null or _reach < end_index").drop("_reach")


def greedy_spans(spans: DataFrame, key: str) -> DataFrame:
    """The outermost spans (start_index, end_index, priority, ...) of every key, less those that overlap an earlier chosen one.

    Outermost spans end in the order in which they start, so one overlaps a chosen
    span exactly if it starts before the last chosen one has ended.  Where a span
    starts after all before it, an island begins that has nothing to do with the
    others; the choice runs along each island.
    """
    before = Window.partitionBy(key).orderBy("start_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = outermost(spans, key).withColumn("_opens", F.coalesce(F.col("start_index") > F.max("end_index").over(before), F.lit(True)))
    rows = rows.withColumn("_island", F.count_if("_opens").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rest = [c for c in spans.columns if c not in ("start_index", "end_index", key)]
    held = F.array_sort(F.collect_list(F.struct("start_index", "end_index", *rest)))
    islands = rows.groupBy(key, "_island").agg(held.alias("_spans"))
    take = lambda out, x: F.when((F.size(out) == 0) | (F.element_at(out, -1)["end_index"] < x["start_index"]), F.concat(out, F.array(x))).otherwise(out)
    chosen = F.aggregate("_spans", F.slice("_spans", 1, 0), take)
    return islands.select(key, F.inline(chosen)).select(*spans.columns)


def overlaps(spans: DataFrame, key: str, name: str) -> DataFrame:
    """(key, outer, inner, contains): pairs of a key's spans that overlap; contains says that the first holds the second whole.

    A span has the level of its length, a power of two, and lies in one or two
    blocks of that size.  Two spans meet in the blocks of the longer one's level,
    of which the shorter one reaches two at most too, and count in the block where
    the overlap begins.  So a span has a few rows for each level that there is,
    however long it is.  Spans that end before they start, or lack an end, overlap
    with none.
    """
    size = F.col("e") - F.col("s") + 1
    level = F.length(F.regexp_replace(F.bin(size - 1), "^0$", ""))  # the least power of two that holds the span
    rows = spans.select(key, F.col(name).alias("a"), F.col("start_index").cast("long").alias("s"), F.col("end_index").cast("long").alias("e")).where("e >= s").withColumn("level", level)
    levels = sorted(r["level"] for r in rows.select("level").distinct().collect())  # 64 at most
    blocks = lambda df: df.select("*", F.explode(F.array_distinct(F.array(F.expr("shiftright(s, at)"), F.expr("shiftright(e, at)")))).alias("block"))
    long = blocks(rows.withColumn("at", F.col("level")))
    short = blocks(rows.select("*", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col("level"))).alias("at")))
    other = short.select(F.col(key).alias("_k"), F.col("a").alias("b"), F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("level").alias("_level"), F.col("at").alias("_at"), F.col("block").alias("_block"))
    once = ((F.col("level") > F.col("_level")) & (F.col("a") != F.col("b"))) | ((F.col("level") == F.col("_level")) & (F.col("a") < F.col("b")))
    met = long.join(other, (F.col(key) == F.col("_k")) & (F.col("at") == F.col("_at")) & (F.col("block") == F.col("_block")) & once & (F.col("s") <= F.col("_e")) & (F.col("_s") <= F.col("e")))
    met = met.where(F.expr("shiftright(greatest(s, _s), at)") == F.col("block"))
    pair = lambda outer, inner, holds: F.struct(F.col(outer).alias("outer"), F.col(inner).alias("inner"), holds.alias("contains"))
    whole = lambda s, e, s2, e2: (F.col(s) <= F.col(s2)) & (F.col(e) >= F.col(e2))
    return met.select(key, F.inline(F.array(pair("a", "b", whole("s", "e", "_s", "_e")), pair("b", "a", whole("_s", "_e", "s", "e")))))


def locate(evidence: DataFrame, unicode: bool = True) -> DataFrame:
    """Regions that do not overlap, with their evidence ids in order."""
    marked = _marked(evidence, unicode)
    spans = greedy_spans(_candidates(marked).where("end_index >= start_index"), "document_id")
    rows = marked.select(F.col("document_id").alias("d"), "idx", "id")
    keys = spans.columns
    joined = spans.join(rows, (F.col("document_id") == F.col("d")) & F.col("idx").between(F.col("start_index"), F.col("end_index")))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("idx", "id"))), lambda x: x["id"])
    return joined.groupBy(*keys).agg(ids.alias("evidence_ids"), F.max_by("id", "idx").alias("end_evidence_id")).withColumnRenamed("start_id", "start_evidence_id")


def region_evidence(regions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence rows of regions in catalog order."""
    named = regions.select(F.explode("evidence_ids").alias("_id")).distinct()
    return evidence.join(named, F.col("id") == F.col("_id"), "left_semi")


