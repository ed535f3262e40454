"""Specification sections: candidates, filters, spans, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from evidentia.functions import predicates as P
from evidentia.functions import text as X

#: Rows looked at after a heading for a body, and on either side for a table of contents.
LOOKAHEAD, CLUSTER, CLUSTER_NUMBERS = 49, 25, 3


def _doc() -> WindowSpec:
    return Window.partitionBy("document_id").orderBy("idx")


def marked(evidence: DataFrame, unicode: bool = True) -> DataFrame:
    """evidence with its index in the document and what each row may be."""
    rows = evidence.withColumn("idx", F.row_number().over(Window.partitionBy("document_id").orderBy("pos")) - 1)
    rows = rows.withColumns({"heading": F.col("evidence_kind") == "heading", "t": X.strip("raw_text"), "normal": X.normalize("raw_text", unicode)})
    rows = rows.withColumn("parsed", X.parse_section(F.col("normal")))
    t, heading = F.col("t"), F.col("heading")
    part = t.rlike(r"(?iU)^PART\s+\d+\b")
    return rows.withColumns({
        "is_part": part,
        "is_article": t.rlike(X.ARTICLE),
        "is_body": part | heading & t.rlike(X.ARTICLE),
        "division": F.when(t.rlike(X.DIVISION), F.struct(F.regexp_extract(t, X.DIVISION, 1).alias("number"), X.clean_title(F.regexp_extract(t, X.DIVISION, 2), unicode).alias("title"))),
        "section": F.when(heading, F.col("parsed.number")),
        "is_title": P.title_line(F.col("normal"), F.col("parsed")),
    })


def look_ahead(body: Column, stop: Column, w: WindowSpec, rows: int = LOOKAHEAD, idx: str = "idx") -> Column:
    """Whether `body` holds within the next rows before `stop` does."""
    ahead = w.rowsBetween(1, rows)
    first = lambda c: F.min(F.when(c, F.col(idx))).over(ahead)
    return F.coalesce(first(body) < F.coalesce(first(stop), F.lit(1 << 62)), F.lit(False))


def candidates(rows: DataFrame) -> DataFrame:
    """Heading rows that may open a section, with number, title, method, what follows and what went before."""
    w = _doc()
    nxt = lambda c, n: F.lead(c, n).over(w)
    stop = lambda n: nxt("parsed", n).isNotNull() | F.coalesce(nxt("is_part", n) | nxt("is_article", n), F.lit(False))
    seen = lambda n: nxt("idx", n).isNotNull()
    first = seen(1) & ~stop(1) & nxt("is_title", 1)
    second = seen(2) & ~stop(1) & ~nxt("is_title", 1) & ~stop(2) & nxt("is_title", 2) & nxt("heading", 2)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    made = rows.withColumns({
        "title_at": F.when(first, 1).when(second, 2),
        "next_title": F.when(first, nxt("normal", 1)).when(second, nxt("normal", 2)),
        "next_id": F.when(first, nxt("id", 1)).when(second, nxt("id", 2)),
        "confirmed": look_ahead(F.col("is_body"), F.col("section").isNotNull(), w),
        # body before, and one section number there at most
        "before_ok": F.coalesce((F.sum(F.col("is_body").cast("int")).over(before) >= 1) & F.coalesce(F.min("section").over(before) == F.max("section").over(before), F.lit(True)), F.lit(False)),
    })
    own = F.col("parsed.title")
    taken = own.isNull() & F.col("next_title").isNotNull()
    found = made.where("section is not null and division is null").select(
        "document_id", "idx", "id", F.col("section").alias("number"), F.coalesce(own, X.blank_to_null(F.col("next_title"))).alias("title"),
        F.when(taken, "heading_plus_title").otherwise(F.col("parsed.method")).alias("method"),
        F.when(taken, F.array("id", "next_id")).otherwise(F.array("id")).alias("heading_ids"), "confirmed", "before_ok",
    )
    near = Window.partitionBy("document_id").orderBy("idx").rangeBetween(-CLUSTER, CLUSTER)
    return found.withColumn("toc", F.size(F.collect_set("number").over(near)) >= CLUSTER_NUMBERS)


def accept(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, skipped): the first candidate of each number that passes, and (document_id, idx, warning) of those before it that don't."""
    passes = F.col("confirmed") | (~F.col("toc") & (F.col("before_ok") | (F.col("method") != "numbered_heading")))
    first = F.min(F.when(F.col("passes"), F.col("idx"))).over(Window.partitionBy("document_id", "number"))
    judged = found.withColumn("passes", passes).withColumn("first", first)
    weak = ~F.col("confirmed") & ~F.col("before_ok")
    accepted = judged.where("idx = first").withColumn("warnings", F.when(weak, F.array(F.lit("weak_body_confirmation"))).otherwise(F.array().cast("array<string>")))
    why = F.when(F.col("toc"), "skipped_toc_like_section_number:").otherwise("skipped_unconfirmed_numbered_heading:")
    skipped = judged.where("not passes and (first is null or idx < first)").select("document_id", "idx", F.concat(why, F.col("number"), F.lit("@index="), F.col("idx")).alias("warning"))
    return accepted.drop("passes", "first"), skipped


def section_id(document: Column, number: Column, heading_id: Column) -> Column:
    return X.content_id("sec", document, number, heading_id)


def discover(evidence: DataFrame, unicode: bool = True) -> DataFrame:
    """One row per section: number, title, span, pages, ids, division, warnings.

    A section runs to the next one's start; the first reaches back to the top if
    what precedes it looks like its body.
    """
    rows = marked(evidence, unicode)
    accepted, skipped = accept(candidates(rows))
    by_start = Window.partitionBy("document_id").orderBy("idx")
    spans = accepted.withColumn("no", F.row_number().over(by_start))
    back = (F.col("no") == 1) & (F.col("idx") > 0) & F.col("before_ok")
    spans = spans.withColumns({"start": F.when(back, 0).otherwise(F.col("idx")), "extended": back})
    starts = spans.select("document_id", F.col("start").alias("idx"), F.col("no").alias("opens"))
    w = _doc()
    inside = rows.join(starts, ["document_id", "idx"], "left").withColumns({"no": F.last("opens", ignorenulls=True).over(w), "div": F.last("division", ignorenulls=True).over(w)}).where("no is not null")
    first, last = (lambda c: F.min_by(c, "idx")), (lambda c: F.max_by(c, "idx"))
    sums = inside.groupBy("document_id", "no").agg(
        first("id").alias("start_evidence_id"), last("id").alias("end_evidence_id"), F.min("idx").alias("start_index"), F.max("idx").alias("end_index"),
        F.coalesce(F.min("page_number"), F.lit(1)).alias("start_page"), F.coalesce(F.max("page_number"), F.lit(1)).alias("end_page"),
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "id"))), lambda x: x["id"]).alias("evidence_ids"), F.max(F.when(F.col("opens").isNotNull(), F.col("div"))).alias("div"),
    )
    told = skipped.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "warning"))), lambda x: x["warning"]).alias("skipped"))
    out = spans.drop("idx", "start").join(sums, ["document_id", "no"]).join(told, "document_id", "left")
    none = F.array().cast("array<string>")
    more = F.when(F.col("no") == 1, F.concat(F.when(F.col("extended"), F.array(F.lit("start_extended_before_heading"))).otherwise(none), F.coalesce("skipped", none))).otherwise(none)
    return out.select(
        section_id(F.col("document_id"), F.col("number"), F.col("id")).alias("id"), "document_id", F.col("number").alias("section_number"), "title", "start_evidence_id", "end_evidence_id", "evidence_ids",
        "start_page", "end_page", F.col("heading_ids").alias("heading_evidence_ids"), F.col("div.number").alias("division_number"), F.col("div.title").alias("division_title"),
        F.col("method").alias("detection_method"), F.concat("warnings", more).alias("warnings"), "start_index", "end_index",
    )


def coverage(evidence: DataFrame, sections: DataFrame) -> DataFrame:
    """Per document: rows in all, assigned, before the first section and unassigned, and ids assigned twice."""
    named = sections.select("document_id", F.explode("evidence_ids").alias("id")).groupBy("document_id", "id").agg(F.count("*").alias("times"))
    first = sections.groupBy("document_id").agg(F.min_by("start_evidence_id", "start_index").alias("first_id"))
    rows = evidence.select("document_id", "id", "pos").join(named, ["document_id", "id"], "left").join(first, "document_id", "left")
    at = F.min(F.when(F.col("id") == F.col("first_id"), F.col("pos"))).over(Window.partitionBy("document_id"))
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("pos", "id")))), lambda x: x["id"])
    rows = rows.withColumn("first_pos", at)
    return rows.groupBy("document_id").agg(
        F.count("*").alias("total_evidence"), F.count_distinct(F.when(F.col("times") > 0, F.col("id"))).alias("assigned_evidence"),
        F.count_if(F.col("first_id").isNotNull() & (F.col("first_pos").isNull() | (F.col("pos") < F.col("first_pos")))).alias("evidence_before_first_section"),
        F.count_if(F.col("times").isNull()).alias("evidence_unassigned"), ids(F.col("times").isNull()).alias("unassigned_evidence_ids"),
        F.array_distinct(ids(F.col("times") > 1)).alias("duplicate_assignment_ids"),
    )
