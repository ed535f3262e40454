"""Projects: documents with their sections, and the register over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import text as X
from evidentia.operators import evidence as E
from evidentia.operators import sections as S


def document_id(filename: Column, content: Column) -> Column:
    """Of the content, or of the name where there is none."""
    return F.concat(F.lit("doc_"), F.substring(F.sha2(F.when(F.length(content) > 0, content).otherwise(filename.cast("binary")), 256), 1, 16))


def section_key(document: Column, section: Column) -> Column:
    return F.concat(document, F.lit("::"), section)


def parse_key(key: Column) -> Column:
    """(document_id, section_id) at the first '::'; an empty half is an error."""
    at = F.locate("::", key)
    left, right = F.when(at > 0, F.expr(f"substring({_name(key)}, 1, locate('::', {_name(key)}) - 1)")), F.when(at > 0, F.expr(f"substring({_name(key)}, locate('::', {_name(key)}) + 2)"))
    good = (F.coalesce(left, F.lit("")) != "") & (F.coalesce(right, F.lit("")) != "")
    return F.when(good, F.struct(left.alias("document_id"), right.alias("section_id"))).otherwise(F.raise_error(F.concat(F.lit("Invalid project section key: "), key)))


def _name(key: Column) -> str:
    return f"`{key._jc.toString()}`"


def split_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, warnings) of uploads (ord, filename, content, items).

    Without parsed items, or without content under a name that is not .pdf, an
    upload is left out; of the same id the last upload stays.
    """
    name = F.coalesce(X.blank_to_null(F.col("filename")), F.lit("document.pdf"))
    rows = uploads.withColumn("filename", name)
    pdf = F.lower("filename").endswith(".pdf")
    rows = rows.withColumn("note", F.when(F.col("items").isNull(), "missing DoclingDocument").when(F.col("content").isNull() & ~pdf, "skipped (not a PDF)").when(F.col("content").isNull(), "missing pdf_bytes; skipped for Specs Review PDF"))
    used = rows.where("items is not null and (content is not null or lower(filename) like '%.pdf')").withColumn("document_id", document_id(F.col("filename"), F.col("content")))
    last = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("ord")))
    documents = used.withColumn("_rn", last).where("_rn = 1").drop("_rn", "note")
    return documents, rows.where("note is not null").select("ord", F.concat("filename", F.lit(": "), F.col("note")).alias("warning"))


def build(uploads: DataFrame, unicode: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, evidence, sections, warnings) of a project."""
    documents, warnings = split_uploads(uploads)
    evidence = E.catalog(documents.select("document_id", "items"), unicode=unicode)
    found = S.discover(evidence, unicode)
    named = found.join(documents.select("document_id", "filename"), "document_id")
    sections = named.select(section_key(F.col("document_id"), F.col("id")).alias("key"), "document_id", "filename", F.col("id").alias("section_id"), "section_number", F.col("title").alias("section_title"), "start_page", "end_page", F.size("evidence_ids").cast("long").alias("evidence_count"))
    empty = documents.join(found.select("document_id").distinct(), "document_id", "left_anti").select("ord", F.concat("filename", F.lit(": no specification sections detected")).alias("warning"))
    return documents, evidence, sections, warnings.unionByName(empty)


def register(sections: DataFrame, views: DataFrame, statuses: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Rows of the register: requirements of processed sections with their counts.

    views has the columns of present.section_view with `key`; statuses (key,
    status); confirmed (key, requirement_id, product_ids).
    """
    done = sections.join(statuses, "key", "left").where(F.coalesce("status", F.lit("not_processed")).isin("completed", "no_submittals")).drop("status")
    rows = done.join(views.select("key", "requirement_id", "submittal_type", "title", "source_clause", "available_product_count", "suggested_product_count"), "key").join(confirmed, ["key", "requirement_id"], "left")
    return rows.select(F.col("key").alias("project_section_key"), "document_id", "filename", "section_number", "section_title", "requirement_id", "submittal_type", "title", "source_clause", "available_product_count", "suggested_product_count", F.coalesce(F.size(F.coalesce("product_ids", F.array().cast("array<string>"))), F.lit(0)).alias("confirmed_product_count"))


def register_counts(sections: DataFrame, rows: DataFrame, statuses: DataFrame) -> DataFrame:
    """(processed_section_count, requirement_count)."""
    done = sections.select("key").join(statuses, "key").where(F.col("status").isin("completed", "no_submittals")).agg(F.count("*").alias("processed_section_count"))
    return done.crossJoin(rows.agg(F.count("*").alias("requirement_count")))


def filter_register(rows: DataFrame, section_number: str | None) -> DataFrame:
    return rows.where(F.col("section_number") == section_number) if section_number else rows


def selection_order(sections: DataFrame) -> DataFrame:
    """Sections in the order in which they are run."""
    return sections.orderBy("key")


def can_export(statuses: DataFrame) -> bool:
    return bool(statuses.agg(F.bool_or(F.col("status").isin("completed", "no_submittals")).alias("x")).first()["x"])


def stability(runs: DataFrame) -> DataFrame:
    """runs (run, item): in how many and which runs each item is, and whether in all, or some."""
    total = runs.agg(F.count_distinct("run").alias("total"))
    held = runs.groupBy("item").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    return held.crossJoin(F.broadcast(total)).select("item", "runs", F.size("runs").alias("n_runs"), (F.size("runs") == F.col("total")).alias("always"))
