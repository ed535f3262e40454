"""Uploads and cached documents as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia import schemas
from evidentia.plans.lineage import cut

# Suffixes that are taken in (fixed values).
SUFFIXES = ("pdf", "docx", "pptx", "xlsx", "html", "htm", "png", "jpg", "jpeg")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, file_type, content) of all files of a known kind under path, large ones too."""
    names = "{" + ",".join(f"*.{s}" for x in SUFFIXES for s in (x, x.upper())) + "}"
    found = spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select(name.alias("filename"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("file_type"), "content")


# What a parser is asked for unless told otherwise (fixed values).
PARSER_OPTIONS = {"do_ocr": True, "do_table_structure": True, "generate_picture_images": True, "images_scale": 2.0}


def parse(files: DataFrame, parser: Callable[..., list[dict]], options: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): parser(filename, content) gives schemas.ITEM rows; a file that fails is an error row, others go on.

    `options`, PARSER_OPTIONS or others, go to the parser by name.  The parser runs
    once for each file: what it gives is checkpointed before errors are told apart.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    item = T.StructType([f for f in schemas.ITEM.fields if f.name not in ("document_id", "pos")])
    schema = T.StructType([T.StructField("filename", T.StringType()), T.StructField("file_type", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("items", T.ArrayType(item)), T.StructField("error", T.StringType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    made, error = parser(row["filename"], row["content"], **(options or {})), None
                except Exception as e:  # noqa: BLE001  one file's failure is its own
                    made, error = None, f"{row['filename']}: {e}"
                yield pa.RecordBatch.from_pylist([row | {"items": made, "error": error}], schema=kinds)

    done = cut(files.select("filename", "file_type", "content").mapInArrow(run, schema))
    return done.where("error is null").drop("error"), done.where("error is not null").select("filename", "error")


def read_cached(spark: SparkSession, path: str, schema: T.StructType = schemas.ITEM) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): JSON lines of parsed documents; lines that do not fit the schema are rejects."""
    both = spark.read.text(path).select(F.col("value"), F.from_json("value", T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x"))
    good = F.col("x").isNotNull() & F.col("x._bad").isNull()
    return both.where(good).select(*(F.col(f"x.{f.name}") for f in schema.fields)), both.where(~good).select("value")


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parsed documents, one JSON object of any number of lines per file, with the file's name."""
    found = spark.read.schema(schema).json(path, multiLine=True).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("_name"))
    return found.withColumnRenamed("_name", "filename") if "filename" not in schema.names else found.withColumn("filename", F.coalesce("filename", "_name")).drop("_name")


def parsed(texts: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of (document_id, json): what a parser has cached, as schemas.PARSED; a text that is no such object is a reject."""
    schema = T.StructType([*schemas.PARSED.fields, T.StructField("_bad", T.StringType())])
    read = texts.select("document_id", F.col(json).alias("_json"), F.from_json(json, schema, {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    good = F.col("x").isNotNull() & F.col("x._bad").isNull() & F.col("x.body").isNotNull()
    return read.where(good).select("document_id", *(F.col(f"x.{f.name}") for f in schemas.PARSED.fields)), read.where(~good).select("document_id", F.col("_json").alias("json"))


def read_parsed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of the cached documents under path, one JSON object per file; document_id is the file's name."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return parsed(spark.read.text(path, wholetext=True).select(F.url_decode(name).alias("document_id"), F.col("value").alias("json")))


def downloads(documents: DataFrame, items: str = "items") -> DataFrame:
    """(document_id, json, markdown): what is offered to save of each parsed document.

    In the Markdown, headings have as many signs as their level says, list items a
    dash, other texts a paragraph.
    """
    label = lambda x: F.lower(F.trim(F.coalesce(x["label"], F.lit(""))))
    said = lambda x: F.coalesce(x["text"], x["orig"], F.lit(""))
    sign = lambda x: F.when(label(x).isin("title", "section_header", "page_header") | label(x).contains("header"), F.concat(F.repeat(F.lit("#"), heading_level(label(x))), F.lit(" "))).when(label(x) == "list_item", "- ").otherwise("")
    lines = F.transform(F.filter(items, lambda x: F.trim(said(x)) != ""), lambda x: F.concat(sign(x), said(x)))
    return documents.select("document_id", F.to_json(F.struct("document_id", items)).alias("json"), F.array_join(lines, "\n\n").alias("markdown"))


def summary(documents: DataFrame) -> DataFrame:
    """Counts of the parts of parsed documents (pages, texts, tables, pictures as arrays)."""
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    return documents.select("filename", size("pages").alias("pages"), size("texts").alias("text_items"), size("tables").alias("tables"), size("pictures").alias("pictures"))


def heading_level(label: Column) -> Column:
    """1 for a title, 2 for whatever names a section (subsections too), else 4."""
    return F.when(label == "title", 1).when(label.contains("section"), 2).otherwise(4)


def hierarchy(items: DataFrame) -> DataFrame:
    """Headings of items with type, text, page and level."""
    label = F.lower(F.trim(F.coalesce("label", F.lit(""))))
    heads = items.where(label.isin("title", "section_header", "page_header") | label.contains("header"))
    return heads.select("document_id", "pos", F.coalesce(F.nullif(label, F.lit("")), F.lit("header")).alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.get("prov", 0)["page_no"].alias("page"), heading_level(label).alias("level"))


def tables(documents: DataFrame) -> DataFrame:
    """One row per table: number, page, caption, rows and columns; a ragged or missing grid is an error row."""
    each = documents.select("document_id", F.posexplode("tables").alias("i", "t"))
    widths = F.array_distinct(F.transform("t.cells", lambda r: F.size(r)))
    error = F.when(F.col("t.cells").isNull(), "no cells").when(F.size(widths) > 1, "rows of different length")
    ok = error.isNull()
    return each.select("document_id", (F.col("i") + 1).alias("table_number"), F.when(ok, F.col("t.page")).alias("page"), F.when(ok, F.col("t.caption")).alias("caption"), F.when(ok, F.size("t.cells")).alias("n_rows"), F.when(ok, F.coalesce(F.get(widths, 0), F.lit(0))).alias("n_columns"), (~ok | (F.size("t.cells") == 0)).alias("is_empty"), error.alias("error"))


def pictures(documents: DataFrame) -> DataFrame:
    each = documents.select("document_id", F.posexplode("pictures").alias("i", "p"))
    return each.select("document_id", (F.col("i") + 1).alias("picture_number"), F.get("p.prov", 0)["page_no"].alias("page"), F.col("p.caption").alias("caption"), F.get("p.prov", 0)["bbox"].alias("bounding_box"))
