"""Product candidate spans: articles of the PRODUCTS part, else product-like headings.

A strategy is a function (evidence rows, excluded ids) -> spans; collect() takes the
first strategy that finds any in a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import predicates as P
from evidentia.functions import text as X

Strategy = Callable[[DataFrame], DataFrame]
_DOC = ["document_id"]


def prepared(evidence: DataFrame, exclude: DataFrame | None = None, unicode: bool = True) -> DataFrame:
    """Rows with index and flags; exclude (document_id, id) names evidence that spans leave out."""
    rows = evidence.withColumn("idx", F.row_number().over(Window.partitionBy(*_DOC).orderBy("pos")) - 1)
    t, heading = X.strip("raw_text"), F.col("evidence_kind") == "heading"
    rows = rows.withColumns({"t": t, "heading": heading})
    flags = {
        "part": P.part_heading(heading, t, numbered=True), "part_no": X.part_number(t), "article_head": P.article_heading(heading, t, "source_clause"),
        "article": X.article_of("source_clause", "raw_text"), "chrome": P.page_chrome(heading, t), "folded": X.fold("raw_text", unicode),
    }
    rows = rows.withColumns(flags)
    if exclude is None:
        return rows.withColumn("excluded", F.lit(False))
    out = exclude.select("document_id", "id").distinct().withColumn("x", F.lit(True))
    return rows.join(out, ["document_id", "id"], "left").withColumn("excluded", F.coalesce("x", F.lit(False))).drop("x")


def _spans(rows: DataFrame, opens: Column, ends: Callable, method: str) -> DataFrame:
    """Spans from each opening row to before the first later row of its group where ends(article) holds."""
    w = Window.partitionBy(*_DOC).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("opens", opens)
    rows = rows.withColumns({"span": F.count(F.when(F.col("opens"), True)).over(w), "own": F.last(F.when(F.col("opens"), F.col("article")), ignorenulls=True).over(w)}).where("span > 0")
    inside = Window.partitionBy(*_DOC, "span").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("over", F.max(F.coalesce(~F.col("opens") & ends(F.col("own")), F.lit(False)).cast("int")).over(inside)).where("over = 0")
    kept = ~F.col("excluded") & ~F.col("chrome") & ~F.col("part")
    first = F.row_number().over(Window.partitionBy(*_DOC, "id", "kept").orderBy("idx")) == 1
    rows = rows.withColumn("kept", kept).withColumn("named", F.col("kept") & first)
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("named"), F.struct("idx", "id")))), lambda x: x["id"])
    head = lambda c: F.min_by(c, "idx")
    found = rows.groupBy(*_DOC, "span").agg(
        head("id").alias("heading_evidence_id"), head("t").alias("heading"), head("article").alias("source_clause"), ids.alias("evidence_ids"),
        F.min("idx").alias("start_index"), F.max("idx").alias("end_index"), F.count_if("kept").alias("kept"), F.sum(F.when(F.col("named"), F.length("raw_text"))).alias("chars"),
    )
    return found.where("kept > 0").drop("kept", "span").withColumn("detection_method", F.lit(method))


def part_products(rows: DataFrame) -> DataFrame:
    """Articles between the first PART that is 2 or says PRODUCTS and the next PART of another number."""
    says = F.col("t").rlike(r"(?iU)^PART\s+\d+\b.*\bPRODUCTS?\b") | (F.col("part_no") == 2) & (F.col("folded").contains("product") | F.upper("t").startswith("PART 2"))
    every = Window.partitionBy(*_DOC)
    rows = rows.withColumn("from", F.min(F.when(F.col("part") & says, F.col("idx"))).over(every))
    rows = rows.withColumn("from_no", F.max(F.when(F.col("idx") == F.col("from"), F.col("part_no"))).over(every))
    rows = rows.withColumn("to", F.min(F.when(F.col("part") & (F.col("idx") > F.col("from")) & (F.col("part_no") != F.col("from_no")), F.col("idx"))).over(every))
    area = rows.where("`from` is not null and idx > `from` and (`to` is null or idx < `to`)")
    # a heading opens a span unless the heading before it is of the same article; a PART line in between opens anew
    event = F.when(F.col("part"), F.lit("")).when(F.col("article_head"), F.col("article"))
    before = F.last(event, ignorenulls=True).over(Window.partitionBy(*_DOC).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("article_head") & F.col("article").isNotNull() & (before.isNull() | (before != F.col("article"))), F.lit(False))
    return _spans(area, opens, lambda own: F.col("part"), "part_products")


def heading_fallback(rows: DataFrame) -> DataFrame:
    """Articles numbered 2.x and those whose title speaks of products."""
    opens = F.col("article_head") & ~F.col("excluded") & F.col("article").isNotNull() & (F.col("article").startswith("2.") | F.col("t").rlike(P.PRODUCT_CONCEPT))
    ends = lambda own: F.col("part") | F.col("article_head") & (F.col("article") != own)
    return _spans(rows, F.coalesce(opens, F.lit(False)), ends, "heading_fallback")


STRATEGIES: dict[str, Strategy] = {"part_products": part_products, "heading_fallback": heading_fallback}


def collect(evidence: DataFrame, exclude: DataFrame | None = None, strategies: tuple[Strategy | str, ...] = ("part_products", "heading_fallback"), unicode: bool = True) -> DataFrame:
    """Spans of the first strategy with any, per document."""
    rows = prepared(evidence, exclude, unicode)
    out = None
    for s in strategies:
        found = (STRATEGIES[s] if isinstance(s, str) else s)(rows)
        out = found if out is None else out.unionByName(found.join(out.select("document_id").distinct(), "document_id", "left_anti"))
    return out


def totals(spans: DataFrame) -> DataFrame:
    """Per document: spans, evidence and characters."""
    return spans.groupBy("document_id").agg(F.count("*").alias("total_regions"), F.sum(F.size("evidence_ids")).alias("total_evidence"), F.sum(F.coalesce("chars", F.lit(0))).alias("approx_char_count"))


def warnings(evidence: DataFrame, spans: DataFrame) -> DataFrame:
    """(document_id, warnings): how the spans of each document came about."""
    rows = prepared(evidence)
    says = F.col("t").rlike(r"(?iU)^PART\s+\d+\b.*\bPRODUCTS?\b") | (F.col("part_no") == 2) & (F.col("folded").contains("product") | F.upper("t").startswith("PART 2"))
    start = rows.where(F.col("part") & says).groupBy("document_id").agg(F.min_by("part_no", "idx").alias("no"), F.min("idx").alias("at"))
    ends = rows.where("part").select(F.col("document_id").alias("d"), "idx", "part_no")
    closed = start.join(ends, (F.col("document_id") == F.col("d")) & (F.col("idx") > F.col("at")) & (F.col("part_no") != F.col("no")), "left").groupBy("document_id").agg(F.count("idx").alias("closed"))
    used = spans.groupBy("document_id").agg(F.max(F.col("detection_method") == "part_products").alias("by_part"))
    every = evidence.select("document_id").distinct().join(closed, "document_id", "left").join(used, "document_id", "left")
    by_part = F.coalesce("by_part", F.lit(False))
    eof = F.when(F.col("closed") == 0, F.array(F.lit("product_part_ended_at_catalog_eof"))).otherwise(F.array().cast("array<string>"))
    fallback = F.array(F.lit("no_explicit_product_part_detected"), F.lit("used_heading_fallback"))
    return every.select("document_id", F.when(by_part, eof).otherwise(fallback).alias("warnings"))
