"""Text functions as column expressions.

All but one run in the JVM.  nfkc() needs Python, as Spark has no Unicode
normalisation: the texts that it may change go there in Arrow batches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters that normalisation maps to ASCII (fixed values).
DASHES = "‐‑‒–—―−﹘﹣－"
SINGLE_QUOTES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„‟″«»"

#: White space as Unicode has it, with the four information separators.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]+"
NOT_SPACE = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"
#: What match keys drop: all but letters, numbers, underscores and white space.
NO_WORD = r"[^\p{L}\p{N}_\s]"
# Patterns of headings, clauses and markers (fixed values).
NUMBER = r"(?:\d{2}\s+\d{2}\s+\d{2}|\d{5,6})"
ARTICLE = r"(?U)^(\d+\.\d+)\b"
PART = r"(?i)^PART\b"
PART_NUMBER = r"(?iU)^PART\s+(\d+)\b"
SECTION = r"(?i)^SECTION\b"
DIVISION = r"(?iU)^DIVISION\s+(\d+)\s*(?:[-–—:]\s*(.+))?$"
LETTERED = r"^([A-Z])\.\s+\S"
SECTION_KEYWORD = rf"(?iU)^SECTION\s+({NUMBER})\b(?:\s*[-–—:]\s*(.+))?$"
SECTION_BARE = rf"(?iU)^({NUMBER})\s*(?:[-–—:]\s*|\s+)(.+)$"
SECTION_ALONE = rf"(?iU)^({NUMBER})$"
PART_HEADING = r"(?iU)^PART\s+\d+\b"
MARKER = r"(?U)^([A-Z]\.|[a-z]\.|\d+\.)\s"
PARENTHETICAL = r"(?sU)^(.*?)\s*\(([^()]+)\)\s*$"

ColumnOrName = Column | str


def col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of the value, made once however often f names it; f must be without nfkc(), as it goes into a lambda."""
    return F.get(F.transform(F.array(value), f), 0)


def blank_to_null(x: Column) -> Column:
    return F.when(x == "", None).otherwise(x)


def found(x: ColumnOrName, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return blank_to_null(F.regexp_extract(col(x), pattern, group))


#: What NFKC may change: all but ASCII, the C1 controls and the characters of Latin-1 that it leaves alone.
NFKC_CHANGES = "[^\\x00-\\x9F¡-§©«-®°±¶·»¿-ÿ]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(x: ColumnOrName) -> Column:
    """The text in NFKC; only texts that it may change go to Python."""
    return F.coalesce(_nfkc(F.when(col(x).rlike(NFKC_CHANGES), col(x))), col(x))


def strip(x: ColumnOrName) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(F.regexp_replace(col(x), f"^{SPACE}", ""), f"{SPACE}$", "")


def normalize(x: ColumnOrName, unicode: bool = True) -> Column:
    """NFKC, dashes and quotes to ASCII, white space collapsed and stripped; null gives ''.

    unicode=False leaves NFKC out and stays in the JVM; both agree on texts that
    are in NFKC already.
    """
    value = F.coalesce(col(x).cast("string"), F.lit(""))
    value = nfkc(value) if unicode else value
    value = F.translate(value, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))
    return F.btrim(F.regexp_replace(value, SPACE, " "))


def text_hash(x: ColumnOrName, unicode: bool = True) -> Column:
    return F.sha2(normalize(x, unicode), 256)


def has_text(x: ColumnOrName) -> Column:
    """Whether normalize() leaves anything; without normalising, as filters go below projections and would do it again."""
    return F.coalesce(col(x).rlike(NOT_SPACE), F.lit(False))


def match_key(x: ColumnOrName, unicode: bool = True) -> Column:
    """normalize(), in lower case, hyphens and punctuation as single spaces."""
    return key_of(normalize(x, unicode))


def key_of(normal: ColumnOrName) -> Column:
    """The match key of a normalised text."""
    lowered = F.replace(F.lower(col(normal)), F.lit("-"), F.lit(" "))
    return F.btrim(F.regexp_replace(F.regexp_replace(lowered, NO_WORD, " "), SPACE, " "))


def fold(x: ColumnOrName, unicode: bool = True) -> Column:
    return F.lower(normalize(x, unicode))


def section_number(x: ColumnOrName, unicode: bool = True) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(normalize(x, unicode), "[-–—]", " "), SPACE, " "))


def clean_title(x: ColumnOrName, unicode: bool = True) -> Column:
    return blank_to_null(normalize(x, unicode))


def article_root(x: ColumnOrName) -> Column:
    return found(strip(x), ARTICLE)


def article_of(clause: ColumnOrName, text: ColumnOrName) -> Column:
    """The article of the clause, else of the text."""
    return F.coalesce(article_root(clause), article_root(text))


def part_number(x: ColumnOrName) -> Column:
    return found(strip(x), PART_NUMBER).try_cast("int")


def parse_section(normal: Column) -> Column:
    """(number, title, method) of a normalised heading line; null if it is none."""
    spaced = lambda pattern: F.regexp_replace(F.regexp_extract(normal, pattern, 1), SPACE, " ")
    made = lambda pattern, titled, method: F.when(
        normal.rlike(pattern), F.struct(spaced(pattern).alias("number"), (blank_to_null(F.btrim(F.regexp_extract(normal, pattern, 2))) if titled else F.lit(None).cast("string")).alias("title"), F.lit(method).alias("method"))
    )
    other = normal.rlike(ARTICLE) | normal.rlike(PART_HEADING) | normal.rlike(DIVISION)
    return F.when(~other, F.coalesce(made(SECTION_KEYWORD, True, "explicit_section_heading"), made(SECTION_BARE, True, "numbered_heading"), made(SECTION_ALONE, False, "numbered_heading")))


def heading_rank(text: ColumnOrName, label: ColumnOrName) -> Column:
    t = strip(text)
    return (
        F.when((col(label) == "title") | t.rlike(SECTION), 10)
        .when(t.rlike(PART), 20)
        .when(t.rlike(ARTICLE), 30)
        .when(t.rlike(LETTERED), 40)
        .when(col(label).isin("title", "section_header", "page_header", "document_index"), 15)
        .otherwise(50)
    )


def marker_token(marker: ColumnOrName, text: ColumnOrName) -> Column:
    return F.coalesce(blank_to_null(strip(marker)), found(strip(text), MARKER))


def raw_text(orig: ColumnOrName, text: ColumnOrName) -> Column:
    """The first that is not blank, as it is."""
    said = lambda x: F.when(strip(x) != "", col(x))
    return F.coalesce(said(orig), said(text))


def first_provenance(prov: ColumnOrName) -> Column:
    """The first entry with a page of 1 or more."""
    return F.get(F.filter(col(prov), lambda p: p["page_no"] >= 1), 0)


def first_page(prov: ColumnOrName) -> Column:
    """The first page that is not null, whatever it is."""
    return F.get(F.filter(F.transform(col(prov), lambda p: p["page_no"]), lambda p: p.isNotNull()), 0)


def ordered_labels(labels: ColumnOrName) -> Column:
    return F.array_join(F.array_distinct(F.filter(col(labels), lambda x: x.isNotNull())), " | ")


def headings_list(headings: ColumnOrName) -> Column:
    return F.filter(F.transform(F.coalesce(col(headings), F.array().cast("array<string>")), strip), lambda x: x != "")


def heading_line(headings: ColumnOrName) -> Column:
    return F.array_join(headings_list(headings), " > ")


def context_lines(parts: ColumnOrName) -> Column:
    """Parts stripped, blanks and repeats of the one before dropped, one a line."""
    said = headings_list(parts)
    return F.array_join(F.filter(said, lambda x, i: (i == 0) | (x != F.get(said, i - 1))), "\n")


def trailing_parenthetical(x: ColumnOrName) -> Column:
    """(core, qualifier) of 'Core (qualifier)'; else (text, null)."""

    def parts(t: Column) -> Column:
        return F.struct(t.alias("t"), *(strip(F.regexp_extract(t, PARENTHETICAL, i)).alias(c) for i, c in ((1, "core"), (2, "inside"))))

    def split(v: Column) -> Column:
        both = (v["core"] != "") & (v["inside"] != "")
        return F.struct(F.when(both, v["core"]).otherwise(v["t"]).alias("core"), F.when(both, v["inside"]).alias("qualifier"))

    return let(let(F.coalesce(strip(x), F.lit("")), parts), split)


def type_title(x: ColumnOrName) -> Column:
    return F.initcap(F.replace(col(x), F.lit("_"), F.lit(" ")))


def product_cell(names: ColumnOrName, one_line: bool = False) -> Column:
    return F.array_join(F.coalesce(col(names), F.array().cast("array<string>")), "; " if one_line else "\n")


def export_basename(x: ColumnOrName, suffix: str = "_submittal_register", default: str = "submittal_register") -> Column:
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(x), r"(?U)[^\w\-]+", "_"), "^_+", ""), "_+$", "")
    return F.when(F.coalesce(base, F.lit("")) == "", F.lit(default)).otherwise(F.concat(base, F.lit(suffix)))


def markdown_cell(x: ColumnOrName) -> Column:
    return F.replace(F.replace(F.coalesce(col(x), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def section_label(number: ColumnOrName, title: ColumnOrName) -> Column:
    return F.concat(col(number), F.lit(" — "), F.coalesce(blank_to_null(col(title)), F.lit("Untitled")))


def count_label(n: ColumnOrName, noun: str = "product") -> Column:
    return F.concat(col(n).cast("string"), F.when(col(n) == 1, f" {noun}").otherwise(f" {noun}s"))


def l2_normalize(v: ColumnOrName) -> Column:
    """v over its length; a zero vector stays as it is."""
    x = F.transform(col(v), lambda c: c.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c))
    return F.when(norm > 0, F.transform(x, lambda c: c / norm)).otherwise(x)


def unique_names(names: list[str]) -> list[str]:
    """Column names with _2, _3 ... after repeats."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def preview(x: ColumnOrName, n: int = 500) -> Column:
    return F.substring(col(x), 1, n)


def message_text(parts: ColumnOrName) -> Column:
    """Text of message parts (type, text): the text parts, one after the other."""
    return F.array_join(F.transform(F.filter(col(parts), lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")


def prompt_block(id_: ColumnOrName, page: ColumnOrName, clause: ColumnOrName, path: ColumnOrName, text: ColumnOrName) -> Column:
    """One evidence item as the extractor's prompt shows it."""
    told = lambda x, default: F.coalesce(blank_to_null(col(x).cast("string")), F.lit(default))
    heading = blank_to_null(F.array_join(F.coalesce(col(path), F.array().cast("array<string>")), " > "))
    return F.concat(
        F.lit("[EVIDENCE ID: "), col(id_), F.lit("]\nClause: "), told(clause, "(none)"), F.lit("\nPage: "), told(page, "(unknown)"),
        F.lit("\nHeading Path:\n"), F.coalesce(heading, F.lit("(none)")), F.lit("\n\nText:\n"), F.coalesce(col(text), F.lit("")),
    )


def term_present(text: ColumnOrName, term: ColumnOrName) -> Column:
    """Whether the text holds the term in any case; .75 and 0.75 are one."""
    t, w = F.lower(col(text)), F.lower(col(term))
    return t.contains(w) | (w.startswith(".") & t.contains(F.concat(F.lit("0"), w))) | (w.startswith("0.") & t.contains(F.substring(w, 2, 1 << 30)))


def pixel_rect(box: ColumnOrName, page_width: ColumnOrName, page_height: ColumnOrName, width: ColumnOrName, height: ColumnOrName) -> Column:
    """(x0, y0, x1, y1) of a page box in an image of width x height pixels, from its top left.

    Null under an origin other than BOTTOMLEFT (also if null) and TOPLEFT, or if
    less than a pixel is left.
    """
    b, wide, high = col(box), col(width).cast("double"), col(height).cast("double")
    scale_x = F.when(col(page_width) != 0, wide / col(page_width)).otherwise(1.0)
    scale_y = F.when(col(page_height) != 0, high / col(page_height)).otherwise(1.0)
    said = F.upper(F.coalesce(blank_to_null(b["coord_origin"]), F.lit("BOTTOMLEFT")))
    y = lambda v: F.when(said.contains("TOPLEFT"), v).otherwise(col(page_height) - v) * scale_y
    clamp = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    xs, ys = (b["l"] * scale_x, b["r"] * scale_x), (y(b["t"]), y(b["b"]))
    x0, x1, y0, y1 = clamp(F.least(*xs), wide), clamp(F.greatest(*xs), wide), clamp(F.least(*ys), high), clamp(F.greatest(*ys), high)
    known = said.contains("TOPLEFT") | said.contains("BOTTOMLEFT")
    return F.when(known & (x1 - x0 >= 1) & (y1 - y0 >= 1), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def content_id(prefix: str, *parts: Column, bits: int = 256, length: int = 16, sep: str = "\0") -> Column:
    """prefix and the first hex digits of a SHA over the parts; null parts count as empty."""
    joined = F.concat_ws(sep, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    digest = F.sha1(joined) if bits == 160 else F.sha2(joined, bits)
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, length))
