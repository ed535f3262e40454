"""The register as rows, workbook, Markdown and JSON."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import text as X

# Headings, metrics and notes of the exports (fixed values).
HEADERS = ("Source File", "Spec Section", "Spec Title", "Source Clause", "Submittal Type", "Submittal Title", "Products", "Product Count", "Products Status", "Row Kind")
WIDTHS = (36, 14, 28, 14, 20, 42, 36, 12, 22, 20)
METRICS = (
    ("Uploaded PDF files", "uploaded_file_count"), ("Detected sections", "detected_section_count"), ("Processed sections", "processed_section_count"), ("Completed", "completed_count"),
    ("No submittals", "no_submittals_count"), ("Failed", "failed_count"), ("Not processed", "not_processed_count"), ("Exported register rows", "exported_register_row_count"),
)
MARKDOWN_HEADERS = ("Source File", "Spec Section", "Type", "Submittal Title", "Products", "Source Clause", "Status", "Row Kind")
INCLUDED, AVAILABLE = "Included", "Available / Not Reviewed"
EXTRACTED, CREATED = "Extracted Requirement", "Created Submittal"
LATE = 10_000
#: Rows of a workbook; it is made on the driver, and more rows go into further ones.
MOST_ROWS = 100_000
ORDER = ["doc_rank", "start_page", "spec_section", "project_section_key", "kind", "ord", "item"]


class Bundle(NamedTuple):
    rows: DataFrame
    summary: DataFrame
    status_lines: DataFrame


def ranked(sections: DataFrame, document_order: list[str] | None = None) -> DataFrame:
    """sections with doc_rank: by the given order of documents, the rest late; else by first appearance (`ord`)."""
    if document_order:
        order = sections.sparkSession.createDataFrame([(d, i) for i, d in enumerate(document_order)], "document_id string, doc_rank int")
        return sections.join(order, "document_id", "left").withColumn("doc_rank", F.coalesce("doc_rank", F.lit(LATE)))
    first = sections.groupBy("document_id").agg(F.min("ord").cast("int").alias("doc_rank"))
    return sections.join(first, "document_id")


def build(sections: DataFrame, views: DataFrame, products: DataFrame, statuses: DataFrame, confirmed: DataFrame, drafts: DataFrame, document_order: list[str] | None = None, uploaded: int | None = None) -> Bundle:
    """Rows of completed sections (requirements, then drafts), a summary row and a line per section.

    sections: schemas.SECTION and ord; views: requirements with key and ord;
    products: (key, product_id, name); confirmed: (key, requirement_id,
    product_ids); drafts: packaging.drafts() and ord.
    """
    placed = ranked(sections, document_order).join(statuses, "key", "left").withColumn("status", F.coalesce("status", F.lit("not_processed")))
    head = ["doc_rank", "start_page", F.col("filename").alias("source_file"), F.col("key").alias("project_section_key"), F.col("section_number").alias("spec_section"), F.col("section_title").alias("spec_title")]
    done = placed.where("status = 'completed'")
    named = confirmed.select("key", "requirement_id", F.posexplode("product_ids").alias("i", "product_id")).join(products.select("key", "product_id", "name"), ["key", "product_id"], "left")
    names = named.groupBy("key", "requirement_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("name", F.lit("")) != "", F.struct("i", "name")))), lambda x: x["name"]).alias("names"))
    asked = done.join(views.select("key", "requirement_id", "source_clause", "submittal_type", "title", F.col("ord").alias("o")), "key").join(names, ["key", "requirement_id"], "left")
    has = F.col("names").isNotNull()
    extracted = asked.select(*head, "source_clause", X.type_title("submittal_type").alias("submittal_type"), F.col("title").alias("submittal_title"), F.coalesce("names", F.array().cast("array<string>")).alias("products"), F.when(has, INCLUDED).otherwise(AVAILABLE).alias("products_status"), F.lit(EXTRACTED).alias("row_kind"), "requirement_id", F.lit(None).cast("string").alias("draft_id"), F.lit(0).alias("kind"), F.col("o").alias("ord"), F.lit(0).alias("item"))
    made = done.join(drafts.select("key", "requirement_id", "source_clause", "submittal_type", "title", "product_names", F.col("id").alias("draft_id"), F.col("ord").alias("o"), "item"), "key")
    created = made.select(*head, "source_clause", X.type_title("submittal_type").alias("submittal_type"), F.col("title").alias("submittal_title"), F.col("product_names").alias("products"), F.lit(INCLUDED).alias("products_status"), F.lit(CREATED).alias("row_kind"), "requirement_id", "draft_id", F.lit(1).alias("kind"), F.col("o").alias("ord"), "item")
    rows = extracted.unionByName(created).withColumn("product_count", F.size("products"))
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    counts = placed.agg(F.count_distinct("document_id").alias("docs"), F.count("*").alias("detected_section_count"), n("completed", "no_submittals", "failed").alias("processed_section_count"), n("completed").alias("completed_count"), n("no_submittals").alias("no_submittals_count"), n("failed").alias("failed_count"), n("not_processed", "processing").alias("not_processed_count"))
    files = F.lit(uploaded) if uploaded is not None else F.lit(len(document_order)) if document_order is not None else F.col("docs")
    summary = counts.crossJoin(rows.agg(F.count("*").alias("exported_register_row_count"))).withColumn("uploaded_file_count", files.cast("long")).drop("docs")
    note = F.replace("status", F.lit("_"), F.lit(" "))
    lines = placed.select("doc_rank", "start_page", F.col("section_number").alias("spec_section"), F.col("key").alias("project_section_key"), F.concat(X.section_label("section_number", "section_title"), F.lit(" — "), note).alias("line"))
    return Bundle(rows, summary.select(*(c for _, c in METRICS)), lines)


def _column(i: int) -> str:
    return chr(65 + i)


def _sheet(rows: Iterable[tuple], widths: tuple[int, ...], wrap: frozenset[int], plain: bool) -> str:
    out = ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">']
    out.append('<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>')
    out += [f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1)]
    out.append("</cols><sheetData>")
    last = 0
    for r, row in enumerate(rows, 1):
        out.append(f'<row r="{r}">')
        for i, value in enumerate(row):
            style = (1 if plain else 2) if r == 1 else 0 if plain else 4 if i in wrap else 3
            if isinstance(value, int):
                out.append(f'<c r="{_column(i)}{r}" s="{style}"><v>{value}</v></c>')
            else:
                out.append(f'<c r="{_column(i)}{r}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(value or "")}</t></is></c>')
        out.append("</row>")
        last = r
    out.append("</sheetData>" + ("" if plain else f'<autoFilter ref="A1:{_column(len(widths) - 1)}{last}"/>') + "</worksheet>")
    return "".join(out)


_STYLES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
    '<fonts count="2"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font></fonts>'
    '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="5"><xf/><xf fontId="1" applyFont="1"/>'
    '<xf fontId="1" applyFont="1" applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf>'
    '<xf applyAlignment="1"><alignment vertical="top"/></xf><xf applyAlignment="1"><alignment vertical="top" wrapText="1"/></xf></cellXfs></styleSheet>'
)


def workbook(bundle: Bundle) -> bytes:
    """The bundle as an .xlsx of three sheets; more than MOST_ROWS rows are an error, and need workbooks()."""
    made = list(islice(workbooks(bundle), 2))
    if len(made) > 1:
        raise ValueError(f"the register has more than {MOST_ROWS} rows: take workbooks()")
    return made[0]


def workbooks(bundle: Bundle, most: int | None = None) -> Iterator[bytes]:
    """The bundle as .xlsx files of `most` register and status rows each, one after the other as rows come in; the same bundle gives the same bytes."""
    most = most or MOST_ROWS
    rows, lines = (iter(df.orderBy(*order).toLocalIterator()) for df, order in ((bundle.rows, ORDER), (bundle.status_lines, ORDER[:4])))
    summary = bundle.summary.first()
    part = list(islice(rows, most)), list(islice(lines, most))
    while True:
        yield _workbook(part[0], part[1], summary)
        part = list(islice(rows, most)), list(islice(lines, most))
        if not part[0] and not part[1]:
            return


def _workbook(rows: list, status: list, summary: object) -> bytes:
    table = [(r.source_file, r.spec_section, r.spec_title, r.source_clause, r.submittal_type, r.submittal_title, "\n".join(r.products), r.product_count, r.products_status, r.row_kind) for r in rows]
    lines = [r.line for r in status]
    notes = [tuple(x.split(" — ", 1)) if " — " in x else (x, "") for x in lines]
    sheets = (
        ("Submittal Register", _sheet([HEADERS, *table], WIDTHS, frozenset({5, 6}), False)),
        ("Project Summary", _sheet([("Metric", "Value"), *((name, int(summary[c])) for name, c in METRICS)], (28, 14), frozenset(), True)),
        ("Processing Status", _sheet([("Section", "Note"), *notes], (48, 18), frozenset(), True)),
    )
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    relation = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    numbers = range(1, len(sheets) + 1)
    parts = {
        "[Content_Types].xml": f'{xml}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}styles+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}worksheet+xml"/>' for i in numbers) + "</Types>",
        "_rels/.rels": f'{xml}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{relation}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{xml}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{relation}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in zip(numbers, sheets, strict=True)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{xml}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{relation}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + f'<Relationship Id="rId{len(sheets) + 1}" Type="{relation}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": _STYLES,
    } | {f"xl/worksheets/sheet{i}.xml": body for i, (_, body) in zip(numbers, sheets, strict=True)}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def markdown_rows(rows: DataFrame) -> DataFrame:
    """(section key, order columns, line): the table lines of the register, without a driver."""
    dash = F.lit("—")
    said = lambda c: F.coalesce(X.blank_to_null(c), dash)
    cells = [F.col("source_file"), F.col("spec_section"), F.col("submittal_type"), F.col("submittal_title"), said(X.product_cell("products", True)), said(F.col("source_clause")), F.col("products_status"), F.col("row_kind")]
    return rows.select(*ORDER, "spec_title", "source_file", F.concat(F.lit("| "), F.concat_ws(" | ", *(X.markdown_cell(c) for c in cells)), F.lit(" |")).alias("line"))


def markdown_lines(bundle: Bundle) -> Iterator[str]:
    """The lines of the bundle as Markdown, as its rows come in: summary, status, a table per section."""
    s = bundle.summary.first()
    yield from ("# Submittal Register", "", "## Project Summary", "", *(f"- {name}: **{s[c]}**" for name, c in METRICS), "")
    first = True
    for r in bundle.status_lines.orderBy(*ORDER[:4]).toLocalIterator():
        yield from ("### Processing Status", "") if first else ()
        yield f"- {r.line}"
        first = False
    yield from ("## Register", "") if first else ("", "## Register", "")
    seen = None
    for r in markdown_rows(bundle.rows).orderBy(*ORDER).toLocalIterator():
        if r.project_section_key != seen:
            yield from () if seen is None else ("",)
            seen = r.project_section_key
            yield from (f"## {r.spec_section} — {r.spec_title or 'Untitled'}", "", f"_Source file: `{r.source_file}`_", "", f"| {' | '.join(MARKDOWN_HEADERS)} |", "|" + "---|" * len(MARKDOWN_HEADERS))
        yield r.line
    if seen is None:
        yield "_No register rows to export from completed sections._"
    yield ""


def markdown(bundle: Bundle) -> str:
    """markdown_lines() as one text."""
    return "\n".join(markdown_lines(bundle))


def json_artifact(document: DataFrame, **parts: DataFrame) -> DataFrame:
    """One JSON text per document row, each part an array of its rows of that document_id."""
    out = document
    for name, df in parts.items():
        rows = df.groupBy("document_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns)))).alias(name))
        out = out.join(rows, "document_id", "left")
    fields = [F.lit('{"document_id":'), F.to_json(F.struct("document_id")).substr(F.lit(16), F.length(F.to_json(F.struct("document_id"))) - 16)]
    for name in parts:
        fields += [F.lit(f',"{name}":['), F.coalesce(F.array_join(name, ","), F.lit("")), F.lit("]")]
    return out.select("document_id", F.concat(*fields, F.lit("}")).alias("json"))
