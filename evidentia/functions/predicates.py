"""Predicates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.functions.text import ColumnOrName, col

# Labels of headings (fixed values).
HEADING_LABELS = ("title", "section_header", "page_header", "document_index")
# Phrases that open a submittal article, in folded text, and those of schedules (fixed values).
SUBMITTAL_PHRASES = (
    r"\bsupplemental\s+submittals?\b",
    r"\baction\s+submittals?\b",
    r"\binformational\s+submittals?\b",
    r"\bquality\s+control\s+submittals?\b",
    r"\bcloseout\s+submittals?\b",
    r"\boperation\s+and\s+maintenance\s+data\b",
    r"\bmaintenance\s+data\b",
)
SCHEDULE_PHRASES = (
    r"\blist\s+of\s+submittals?\b",
    r"\bsubmittal\s+schedule\b",
    r"\bsubmittal\s+log\b",
    r"\bsubmittal\s+register\b",
    r"\bsubmittal\s+index\b",
)
SUBMITTAL = r"\bsubmittals?\b"
# Words of product headings (fixed values).
PRODUCT_CONCEPT = (
    r"(?iU)\b(products?|materials?|systems?|equipment|fabrication|fabricated|manufacturers?|assembl(?:y|ies)|ductwork|"
    r"sealants?|cements?|gaskets?|liners?|traps?|exhaust|resistive)\b"
)
# Words that a qualifier in brackets may have, and cores that say too little alone (fixed values).
BENIGN_WORDS = ("indoor", "outdoor", "corrosive", "area", "finish", "finishes", "use", "application", "and", "or", "for", "in", "the", "a", "an", "of", "to")
GENERIC_WORDS = ("system", "systems", "product", "products", "material", "materials", "item", "items", "equipment", "assembly", "assemblies", "component", "components")
# What text that refers to a section holds, and what no title line starts with (fixed values).
CROSS_REFERENCE = r"(?iU)\b(?:refer\s+to\s+)?section\s+\d"
NO_TITLE = r"(?iU)^(?:PART\s+\d+|SECTION\b|DIVISION\b|\d+\.\d+\b|[A-Z]\.\s)"
# What a rate-limit message holds (fixed values).
RATE_LIMIT_MARKERS = ("429", "rate limit", "resource exhausted", "quota", "too many requests")


def meaningful(x: ColumnOrName) -> Column:
    return F.coalesce(X.strip(x), F.lit("")) != ""


def is_heading_label(label: ColumnOrName) -> Column:
    return F.coalesce(col(label).isin(*HEADING_LABELS) | col(label).contains("header"), F.lit(False))


def _any(x: Column, patterns: tuple[str, ...]) -> Column:
    return x.rlike("(?U)" + "|".join(patterns))


def submittal_text(folded: Column, stripped: Column) -> Column:
    """Whether a line opens a submittal article: a telling phrase, or the bare word in a numbered title."""
    return ~_any(folded, SCHEDULE_PHRASES) & (_any(folded, SUBMITTAL_PHRASES) | folded.rlike(f"(?U){SUBMITTAL}") & stripped.rlike(X.ARTICLE))


def part_heading(heading: Column, stripped: Column, numbered: bool = False) -> Column:
    return heading & stripped.rlike(X.PART_NUMBER if numbered else X.PART)


def section_boundary(heading: Column, stripped: Column, clause: ColumnOrName) -> Column:
    """A SECTION heading without a clause; with one it is the header of a page."""
    return heading & stripped.rlike(X.SECTION) & (F.coalesce(X.strip(clause), F.lit("")) == "")


def article_heading(heading: Column, stripped: Column, clause: ColumnOrName) -> Column:
    c = F.coalesce(X.strip(clause), F.lit(""))
    return heading & stripped.rlike(X.ARTICLE) & ~stripped.rlike(X.PART_NUMBER) & ~stripped.rlike(X.SECTION) & ((c == "") | c.rlike(r"^\d+\.\d+$"))


def page_chrome(heading: Column, stripped: Column) -> Column:
    """Blank, a SECTION line, or a short title in capitals that names no product."""
    shout = (F.length(stripped) <= 40) & (F.upper(stripped) == stripped) & stripped.contains(" ")
    plain = ~stripped.rlike(X.ARTICLE) & ~stripped.rlike(X.PART_NUMBER) & ~stripped.rlike(PRODUCT_CONCEPT)
    return (stripped == "") | stripped.rlike(X.SECTION) | (heading & shout & plain)


def body_cross_reference(heading: Column, stripped: Column) -> Column:
    return ~heading & stripped.rlike(CROSS_REFERENCE)


def title_line(normal: Column, parsed: Column) -> Column:
    """A short line of letters that is no heading of another kind; parsed is its parse_section()."""
    letters = F.length(F.regexp_replace(normal, r"\P{L}", ""))
    return (normal != "") & (F.length(normal) <= 120) & ~normal.rlike(NO_TITLE) & parsed.isNull() & (letters >= 3)


def _glue(x: Column) -> Column:
    return F.regexp_replace(x, "[^a-z0-9]", "")


def contains_key(hay: Column, needle: Column, glued: Column | None = None) -> Column:
    """Containment of match keys in three tiers: as it is, without what is not a-z0-9, and word by word.

    hay must be a column, not an expression with nfkc(), as it goes into a lambda.  The third tier needs two words or more of over two characters, each found anywhere.
    glued is hay without what is not a-z0-9, where it is at hand.
    """
    words = F.filter(F.split(needle, " "), lambda w: F.length(w) > 2)
    tiers = hay.contains(needle) | ((_glue(needle) != "") & (_glue(hay) if glued is None else glued).contains(_glue(needle))) | ((F.size(words) >= 2) & F.forall(words, lambda w: hay.contains(w)))
    return F.coalesce((hay != "") & (needle != "") & tiers, F.lit(False))


def contains(hay: ColumnOrName, needle: ColumnOrName, unicode: bool = True) -> Column:
    return contains_key(X.match_key(hay, unicode), X.match_key(needle, unicode))


def clause_supports(required: ColumnOrName, given: ColumnOrName) -> Column:
    """The given clause is the required one or lies below it."""
    r, g = F.coalesce(X.strip(required), F.lit("")), F.coalesce(X.strip(given), F.lit(""))
    return (r != "") & (g != "") & ((g == r) | g.startswith(F.concat(r, F.lit("."))))


def core_acceptable(core_key: Column) -> Column:
    """The core has a word of over two characters and is not one generic word alone."""
    words = F.filter(F.split(core_key, " "), lambda w: w != "")
    generic = (F.size(words) == 1) & F.get(words, 0).isin(*GENERIC_WORDS)
    return F.exists(words, lambda w: F.length(w) > 2) & ~F.coalesce(generic, F.lit(False))


def qualifier_supported(qualifier_key: Column, blob_key: Column, glued: Column | None = None) -> Column:
    """The blob holds the qualifier, or each of its words is benign or in the blob."""
    words = F.filter(F.split(qualifier_key, " "), lambda w: w != "")
    each = F.forall(words, lambda w: w.isin(*BENIGN_WORDS) | contains_key(blob_key, w, glued))
    return F.coalesce(contains_key(blob_key, qualifier_key, glued) | (F.size(words) > 0) & each, F.lit(False))


def name_support(name: ColumnOrName, normalized: ColumnOrName, blob_key: Column, unicode: bool = True) -> Column:
    """(mode, core, qualifier): name, normalized_name, core_fallback or unsupported, the first that holds.

    Keys and parts of the names are made once a row, before the tests that share them.
    """
    none = F.lit(None).cast("string")
    made = lambda mode, core=none, qualifier=none: F.struct(F.lit(mode).alias("mode"), core.alias("core"), qualifier.alias("qualifier"))
    names = [X.col(name), X.col(normalized)]
    split = F.array(*(F.when(x.contains(")"), X.trailing_parenthetical(x)) for x in names))

    def judged(v: Column) -> Column:
        hay, glued = v["hay"], v["glued"]
        held = lambda x: contains_key(hay, x, glued)

        def fallback(part: Column, core: Column, qualifier: Column) -> Column:
            ok = part["qualifier"].isNotNull() & core_acceptable(core) & held(core) & qualifier_supported(qualifier, hay, glued)
            return F.when(ok, made("core_fallback", part["core"], part["qualifier"]))

        return F.coalesce(
            F.when(held(v["keys"][0]), made("name")),
            F.when(held(v["keys"][1]), made("normalized_name")),
            *(fallback(v["split"][i], v["cores"][i], v["qualifiers"][i]) for i in (0, 1)),
            made("unsupported"),
        )

    keys = lambda parts: F.array(*(X.match_key(x, unicode) for x in parts))
    with_split = lambda s: F.struct(blob_key.alias("hay"), _glue(blob_key).alias("glued"), keys(names).alias("keys"), s.alias("split"), *(keys([s[i][c] for i in (0, 1)]).alias(f"{c}s") for c in ("core", "qualifier")))
    # nfkc() cannot go into a lambda
    bound = with_split(split) if unicode else X.let(split, with_split)
    return X.let(bound, judged)


def cross_reference_supported(ref: ColumnOrName, blob_key: Column, unicode: bool = True) -> Column:
    numbers = F.regexp_extract_all(col(ref), F.lit(r"(?U)\b\d{3,5}\b"), F.lit(0))
    return contains_key(blob_key, X.match_key(ref, unicode)) | F.coalesce(F.exists(numbers, lambda n: contains_key(blob_key, n)), F.lit(False))


def search(fields: list[ColumnOrName], query: str) -> Column:
    """Whether the fields together hold the query in any case; an empty query holds everywhere."""
    if not query.strip():
        return F.lit(True)
    return F.lower(F.concat_ws(" ", *(col(x) for x in fields))).contains(query.strip().lower())


def is_rate_limit(message: str) -> bool:
    lowered = message.lower()
    return any(m.lower() in lowered for m in RATE_LIMIT_MARKERS)
