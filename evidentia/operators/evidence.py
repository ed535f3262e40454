"""Parsed items to ordered, content-addressed evidence.

Ordered state is windows on one key, document_id, so the cascade shares an
exchange.  Of the heading path, only titles and PARTs depend on what was accepted
before; those rows alone are run through in an array per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import predicates as P
from evidentia.functions import text as X
from evidentia.operators import tree


def explode_items(documents: DataFrame, items: str = "items") -> DataFrame:
    """document_id and an array of items to one row per item, in reading order."""
    return documents.select("document_id", F.posexplode(items).alias("pos", "item")).select("document_id", "pos", "item.*")


def read_items(items: DataFrame) -> DataFrame:
    """items with label in lower case, raw_text, page entry, and `skip`, the reason why an item is no evidence.

    The first item that qualifies keeps its ref; an item that does not qualify
    reserves none.
    """
    entry = X.first_provenance("prov")
    read = items.withColumns({"label": F.lower(X.strip(F.coalesce("label", F.lit("")))), "ref": X.blank_to_null(F.col("self_ref")), "raw_text": X.raw_text("orig", "text"), "entry": entry})
    good = F.col("raw_text").isNotNull() & F.col("entry").isNotNull()
    first = F.min(F.when(good, F.col("pos"))).over(Window.partitionBy("document_id", "ref"))
    reason = (
        F.when(F.col("ref").isNotNull() & (F.col("pos") > first), "duplicate_docling_ref")
        .when(F.col("raw_text").isNull(), "no_meaningful_text")
        .when(F.col("entry").isNull(), "no_page_provenance")
    )
    return read.withColumn("skip", reason)


def skip_log(read: DataFrame) -> DataFrame:
    """(document_id, pos, reason, docling_ref, preview) of items that are no evidence."""
    shown = F.when(F.col("skip") == "no_page_provenance", F.substring("raw_text", 1, 120))
    return read.where("skip is not null").select("document_id", "pos", F.col("skip").alias("reason"), F.col("ref").alias("docling_ref"), shown.alias("preview"))


def clause_cascade(df: DataFrame, key: str, order: str, article: Column, letter: Column, number: Column, subletter: Column) -> DataFrame:
    """df with `clause`, built from four levels of markers, each null where a row sets none.

    A level holds until one above it is set; a marker counts only where all levels
    above it are set.
    """
    names = ["_article", "_letter", "_number", "_subletter"]
    out, groups = df.withColumns(dict(zip(names, (article, letter, number, subletter), strict=True))), [key]
    for i, name in enumerate(names):
        frame = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = F.col(name) if i == 0 else F.when(F.col(f"{names[i - 1]}_v").isNotNull(), F.col(name))
        out = out.withColumn(f"{name}_v", F.last(counts, ignorenulls=True).over(frame)).withColumn(f"{name}_g", F.count(counts).over(frame))
        groups = [*groups, f"{name}_g"]
    parts = [F.col(f"{n}_v") for n in names]
    clause = F.when(parts[0].isNotNull(), F.concat_ws(".", *parts))
    made = [f"{n}{s}" for n in names for s in ("", "_v", "_g")]
    return out.withColumn("clause", clause).drop(*made)


def add_clauses(df: DataFrame) -> DataFrame:
    """df (document_id, pos, raw_text, heading, marker) with source_clause."""
    t = X.strip("raw_text")
    is_article = F.col("heading") & t.rlike(X.ARTICLE)
    neutral = F.col("heading") & (t.rlike(X.SECTION) | t.rlike(X.PART))
    lettered = F.col("heading") & t.rlike(X.LETTERED)
    marker = F.when(~is_article & ~neutral & ~lettered, X.marker_token("marker", t))
    letter = F.when(~is_article & ~neutral & lettered, F.substring(t, 1, 1)).otherwise(X.found(marker, r"^([A-Z])\.$"))
    made = clause_cascade(df, "document_id", "pos", F.when(is_article, X.found(t, X.ARTICLE)), letter, X.found(marker, r"(?U)^(\d+)\.$"), X.found(marker, r"^([a-z])\.$"))
    return made.withColumnRenamed("clause", "source_clause")


#: Ranks of headings: those up to NAMES are titles and section names, those from ARTICLES on articles and what is in them.
RANKS, NAMES, PART, ARTICLES = (10, 15, 20, 30, 40, 50), 15, 20, 30


def heading_paths(heads: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, path) after each heading row (key, order, rank, t); rank is one of RANKS.

    A heading replaces those of its rank and below.  A name counts only if no
    article is open, which is so exactly if the last heading that is no name is a
    PART, and if the path does not have it.  Only the names that may count, and the
    PARTs, depend on each other: those few are run through per key; the ranks
    below are windows, as a PART or a higher article clears them.
    """
    w = Window.partitionBy(key).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_name = F.col("rank") <= NAMES
    open_ = F.last(F.when(~is_name, F.col("rank")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)) >= ARTICLES
    rows = heads.select(key, order, "rank", "t").withColumn("top", (F.col("rank") == PART) | (is_name & ~F.coalesce(open_, F.lit(False))))
    tops = _top_paths(rows.where("top"), key, order).select(F.col(key).alias("_k"), F.col(order).alias("_o"), "names")
    rows = rows.join(tops, F.col(key).eqNullSafe(F.col("_k")) & (F.col(order) == F.col("_o")), "left").drop("_k", "_o")
    rows = rows.withColumn("names", F.last("names", ignorenulls=True).over(upto))
    groups, below = [key], []
    for rank in (PART, *(r for r in RANKS if r >= ARTICLES)):
        frame = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        mine = F.col("rank") == rank
        if rank >= ARTICLES:
            rows = rows.withColumn(f"t{rank}", F.last(F.when(mine, F.col("t")), ignorenulls=True).over(frame))
            below.append(f"t{rank}")
        if rank != RANKS[-1]:
            rows = rows.withColumn(f"g{rank}", F.count_if(mine).over(frame))
            groups.append(f"g{rank}")
    return rows.select(key, order, F.array_compact(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.array(*below))).alias("path"))


def _top_paths(top: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, names): the title, section name and PART after each row."""
    text = F.lit(None).cast("string")
    kind = dict(top.dtypes)[order]
    start = F.struct(text.alias("a"), text.alias("b"), text.alias("c"), F.array().cast(f"array<struct<o:{kind},names:array<string>>>").alias("out"))

    def step(at: Column, x: Column) -> Column:
        known = F.array_contains(F.array(*(F.coalesce(at[c], F.lit("")) for c in "abc")), x["t"])
        stays = (x["rank"] <= NAMES) & known
        a = F.when((x["rank"] == RANKS[0]) & ~known, x["t"]).otherwise(at["a"])
        b = F.when(stays | (x["rank"] == PART), at["b"]).when(x["rank"] == NAMES, x["t"])
        c = F.when(x["rank"] == PART, x["t"]).when(stays, at["c"])
        after = F.struct(x["o"].alias("o"), F.array_compact(F.array(a, b, c)).alias("names"))
        return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), F.concat(at["out"], F.array(after)).alias("out"))

    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "rank", "t")))
    run = top.groupBy(key).agg(held.alias("x")).select(key, F.inline(F.aggregate("x", start, step, lambda at: at["out"])))
    return run.withColumnRenamed("o", order)


def add_heading_paths(df: DataFrame, initial: list[str] | None = None) -> DataFrame:
    """df (document_id, pos, raw_text, heading, label) with heading_path.

    Rows see the path of heading_paths().  `initial` headings count as section
    headers that stand before the first row of every document.
    """
    first = _ranked_texts(df, initial) if initial else []
    heads = df.where(F.col("heading") & (X.strip("raw_text") != "")).select("document_id", "pos", X.strip("raw_text").alias("t"), X.heading_rank("raw_text", "label").alias("rank"))
    if first:
        ahead = F.array(*[F.struct(F.lit(i - len(first) - 1).cast(df.schema["pos"].dataType).alias("pos"), F.lit(r["t"]).alias("t"), F.lit(r["rank"]).alias("rank")) for i, r in enumerate(first)])
        heads = df.select("document_id").distinct().select("document_id", F.inline(ahead)).unionByName(heads)
    paths = heading_paths(heads, "document_id", "pos").select(F.col("document_id").alias("_d"), F.col("pos").alias("_p"), F.col("path").alias("_path"))
    start = F.array().cast("array<string>")
    if first:
        before = paths.where("_p < 0").groupBy("_d").agg(F.max_by("_path", "_p").alias("_start"))
        df, start = df.join(before, df["document_id"].eqNullSafe(F.col("_d")), "left").drop("_d"), F.col("_start")
    joined = df.join(paths, df["document_id"].eqNullSafe(F.col("_d")) & (F.col("pos") == F.col("_p")), "left").drop("_d", "_p")
    frame = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn("heading_path", F.coalesce(F.last("_path", ignorenulls=True).over(frame), start)).drop("_path", "_start")


def _ranked_texts(df: DataFrame, texts: list[str]) -> list:
    rows = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("label", F.lit("section_header"))
    return rows.select("i", X.strip("t").alias("t"), X.heading_rank("t", "label").alias("rank")).where("t <> ''").orderBy("i").collect()


def evidence_id(document_id: Column, ref: Column, page: Column, text_hash: Column) -> Column:
    return X.content_id("ev", document_id, F.coalesce(X.blank_to_null(ref), page.cast("string")), text_hash)


def build_evidence(items: DataFrame, spec_section_id: str = "document", initial: list[str] | None = None, unicode: bool = True) -> DataFrame:
    """Evidence rows (schemas.EVIDENCE) of items (schemas.ITEM), in the order of pos within a document."""
    kept = read_items(items).where("skip is null").withColumn("heading", P.is_heading_label("label"))
    made = add_heading_paths(add_clauses(kept), initial).withColumn("text_hash", X.text_hash("raw_text", unicode))
    page = F.col("entry.page_no")
    return made.select(
        evidence_id(F.col("document_id"), F.col("ref"), page, F.col("text_hash")).alias("id"), "document_id", F.lit(spec_section_id).alias("spec_section_id"),
        F.coalesce("ref", F.lit("")).alias("docling_ref"), page.alias("page_number"), F.col("entry.bbox").alias("bbox"), "raw_text", "text_hash", "heading_path", "source_clause",
        F.when(F.col("heading"), "heading").otherwise("other").alias("evidence_kind"), F.lit(None).cast("int").alias("chunk_id"), F.lit(None).cast("string").alias("contextualized_text"), "pos",
    )


def catalog(documents: DataFrame, items: str = "items", **options: object) -> DataFrame:
    """Evidence of documents: with an array of items, or as a parser has cached them (schemas.PARSED), in reading order."""
    read = explode_items(documents, items) if items in documents.columns else tree.reading_order(documents)[0]
    return build_evidence(read, **options)


def resolve(ids: DataFrame, evidence: DataFrame, id_col: str = "evidence_id") -> tuple[DataFrame, DataFrame]:
    """(resolved, missing): evidence rows that `ids` names, and named ids (in first-seen order by `ord`) without one."""
    wanted = ids.groupBy(id_col).agg(F.min("ord").alias("ord"))
    return evidence.join(wanted, evidence["id"] == F.col(id_col), "left_semi"), wanted.join(evidence, evidence["id"] == F.col(id_col), "left_anti")


def dedupe_first(df: DataFrame, key: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """(first, later) of the rows with the same key, as first_of() tells them."""
    ranked = first_of(df, key, order, "_first")
    return ranked.where("_first").drop("_first"), ranked.where("not _first").drop("_first")


def first_of(df: DataFrame, key: list[str], order: list, name: str = "first") -> DataFrame:
    """df with whether a row is the first with its key; rows with a null in the last key column are all first."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn(name, rank == 1).withColumn(name, F.col(key[-1]).isNull() | F.col(name))


def pages(evidence: DataFrame) -> DataFrame:
    """Pages of evidence rows, in first-seen order."""
    return evidence.where("page_number is not null").groupBy("document_id", "page_number").agg(F.min("pos").alias("first_pos"))


def highlights(ids: DataFrame, evidence: DataFrame) -> DataFrame:
    """Rows of a review: the resolved evidence in its order, then the missing ids in theirs."""
    resolved, missing = resolve(ids, evidence)
    rows = resolved.select(F.col("id").alias("evidence_id"), "page_number", "bbox", "raw_text", "source_clause", "heading_path", F.lit(False).alias("missing"), F.lit(0).alias("part"), F.col("pos").cast("long").alias("ord"))
    gone = missing.select("evidence_id", F.lit("").alias("raw_text"), F.lit(True).alias("missing"), F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"))
    return rows.unionByName(gone, allowMissingColumns=True).orderBy("part", "ord")


def review_selection(entity_type: str, entity_id: str, title: str, ids: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row for the review of an entity: its ids, its highlights and the missing ids."""
    rows = highlights(ids, evidence)
    order = F.struct("part", "ord", "evidence_id", "page_number", "raw_text", "missing")
    named = ids.groupBy("evidence_id").agg(F.min("ord").alias("ord")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"))
    made = rows.agg(F.array_sort(F.collect_list(order)).alias("highlights"))
    full = named.crossJoin(made).withColumn("missing_evidence_ids", F.transform(F.filter("highlights", lambda x: x["missing"]), lambda x: x["evidence_id"]))
    return full.select(F.lit(entity_type).alias("entity_type"), F.lit(entity_id).alias("entity_id"), F.lit(title).alias("title"), "*")


class ScopeError(ValueError):
    """A scope names evidence that is not there."""

    code = "invalid_scope_evidence_ids"


def scope(evidence: DataFrame, ids: DataFrame) -> DataFrame:
    """Evidence of a scope in catalog order; ids (evidence_id, ord) that are missing raise, the first eight named."""
    resolved, missing = resolve(ids, evidence)
    count = missing.count()
    if count:
        first = [r["evidence_id"] for r in missing.orderBy("ord").limit(8).collect()]
        more = f" (+{count - 8} more)" if count > 8 else ""
        raise ScopeError(f"scope_evidence_ids missing from catalog: {', '.join(first)}{more}")
    return resolved


def flatten_ids(spans: DataFrame, evidence: DataFrame, ids: str = "evidence_ids") -> DataFrame:
    """Evidence that any span names, once, in catalog order."""
    named = spans.select(F.explode(ids).alias("_id")).distinct()
    return evidence.join(named, evidence["id"] == F.col("_id"), "left_semi")
