"""The read model: requirements with the whole product catalogue, suggested products flagged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.predicates import search
from evidentia.functions.text import type_title
from evidentia.operators.validate import KEY, Extraction

UNGROUPED_ID, UNGROUPED_NAME = "__ungrouped__", "Other / Ungrouped"
LAST = 10**9


def group_order(groups: DataFrame, evidence: DataFrame) -> DataFrame:
    """groups with `place`: by the first cited evidence, then as they came."""
    cited = groups.select(KEY, F.col("id").alias("_g"), F.explode_outer("evidence_ids").alias("_e"))
    at = cited.join(evidence.select(F.col(KEY).alias("_k"), F.col("id").alias("_id"), "pos"), (F.col(KEY) == F.col("_k")) & (F.col("_e") == F.col("_id")), "left")
    first = at.groupBy(KEY, "_g").agg(F.coalesce(F.min("pos"), F.lit(LAST)).alias("first_pos"))
    joined = groups.join(first.withColumnRenamed("_g", "id"), [KEY, "id"])
    return joined.withColumn("place", F.row_number().over(Window.partitionBy(KEY).orderBy("first_pos", "ord")))


def suggested(links: DataFrame, products: DataFrame) -> DataFrame:
    """The first link of each requirement and product that exists, in link order."""
    known = links.join(products.select(KEY, F.col("id").alias("product_id")), [KEY, "product_id"], "left_semi")
    first = known.withColumn("_rn", F.row_number().over(Window.partitionBy(KEY, "requirement_id", "product_id").orderBy("ord"))).where("_rn = 1").drop("_rn")
    return first


def catalogue(x: Extraction, evidence: DataFrame) -> DataFrame:
    """One row per requirement and product of a section: group, place and the link, if there is one."""
    groups = group_order(x.product_groups, evidence).select(KEY, F.col("id").alias("group_id"), F.col("name").alias("group_name"), F.col("code").alias("group_code"), "place")
    products = x.products.select(KEY, F.col("id").alias("product_id"), "name", "normalized_name", F.col("product_group_id").alias("group_id"), F.col("evidence_ids").alias("product_evidence_ids"), F.col("ord").alias("product_ord"))
    placed = products.join(groups, [KEY, "group_id"], "left")
    free = F.col("place").isNull()
    placed = placed.withColumns({"group_id": F.when(free, UNGROUPED_ID).otherwise(F.col("group_id")), "group_name": F.when(free, UNGROUPED_NAME).otherwise(F.col("group_name")), "place": F.coalesce("place", F.lit(LAST))})
    links = suggested(x.links, x.products).select(KEY, "requirement_id", "product_id", "mapping_method", "review_required", "confidence", F.col("ord").alias("link_ord"))
    pairs = x.requirements.select(KEY, F.col("id").alias("requirement_id")).join(placed, KEY).join(links, [KEY, "requirement_id", "product_id"], "left")
    hit = F.col("link_ord").isNotNull()
    return pairs.withColumns({"suggested_for_requirement": hit, "review_required": F.coalesce("review_required", F.lit(False))})


def section_view(x: Extraction, evidence: DataFrame) -> DataFrame:
    """One row per requirement, with product_groups nested: every group in order, the ungrouped bucket last."""
    pairs = catalogue(x, evidence)
    product = F.struct("product_ord", "product_id", "name", "normalized_name", "group_id", "group_name", F.col("product_evidence_ids").alias("evidence_ids"), "suggested_for_requirement", "mapping_method", "review_required", "confidence")
    members = pairs.groupBy(KEY, "requirement_id", "group_id").agg(F.array_sort(F.collect_list(product)).alias("products"), F.count("*").alias("total_products"), F.count_if("suggested_for_requirement").alias("suggested_products"))
    ids = F.col("evidence_ids")
    groups = group_order(x.product_groups, evidence).select(KEY, "place", F.col("id").alias("group_id"), "name", "code", ids)
    bucket = x.requirements.select(KEY).distinct().select(KEY, F.lit(LAST).alias("place"), F.lit(UNGROUPED_ID).alias("group_id"), F.lit(UNGROUPED_NAME).alias("name"), F.lit(None).cast("string").alias("code"), F.array().cast("array<string>").alias("evidence_ids"))
    shelves = x.requirements.select(KEY, F.col("id").alias("requirement_id")).join(groups.unionByName(bucket), KEY).join(members, [KEY, "requirement_id", "group_id"], "left")
    none = F.array().cast(members.schema["products"].dataType)
    shelf = F.struct("place", "group_id", "name", "code", "evidence_ids", F.coalesce("products", none).alias("products"), F.coalesce("total_products", F.lit(0)).alias("total_products"), F.coalesce("suggested_products", F.lit(0)).alias("suggested_products"))
    nested = shelves.groupBy(KEY, "requirement_id").agg(F.array_sort(F.collect_list(shelf)).alias("product_groups"))
    hits = pairs.where("suggested_for_requirement").groupBy(KEY, "requirement_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("link_ord", "product_id"))), lambda p: p["product_id"]).alias("suggested_product_ids"))
    total = x.products.groupBy(KEY).agg(F.count("*").alias("available_product_count"))
    own = x.requirements.withColumnRenamed("id", "requirement_id")
    out = own.join(nested, [KEY, "requirement_id"], "left").join(hits, [KEY, "requirement_id"], "left").join(total, KEY, "left")
    out = out.withColumns({"suggested_product_ids": F.coalesce("suggested_product_ids", F.array().cast("array<string>")), "available_product_count": F.coalesce("available_product_count", F.lit(0))})
    return out.withColumn("suggested_product_count", F.size("suggested_product_ids"))


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy(KEY).agg(F.count_if(F.col("severity") == "warning").alias("validation_warning_count"), F.count_if(F.col("severity") == "error").alias("validation_error_count"))


def consistency(x: Extraction, view: DataFrame) -> DataFrame:
    """(key, requirement_id, failure): what does not add up between the entities and their view."""
    flat = view.select(KEY, "requirement_id", "suggested_product_ids", "suggested_product_count", "available_product_count", F.flatten(F.transform("product_groups", lambda g: g["products"])).alias("p"), "product_groups")
    ids = F.transform("p", lambda q: q["product_id"])
    flagged = F.transform(F.filter("p", lambda q: q["suggested_for_requirement"]), lambda q: q["product_id"])
    catalogue_ids = x.products.groupBy(KEY).agg(F.collect_set("id").alias("all"))
    rows = flat.join(catalogue_ids, KEY, "left").withColumn("all", F.coalesce("all", F.array().cast("array<string>")))
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    checks = F.array(
        F.when(~same(ids, F.col("all")), "product hierarchy membership != validated catalog"),
        F.when(F.size(ids) != F.size(F.array_distinct(ids)), "duplicate products in catalog hierarchy"),
        F.when(~F.exists("product_groups", lambda g: g["group_id"] == UNGROUPED_ID), "missing Other / Ungrouped view bucket"),
        F.when(F.col("available_product_count") != F.size("all"), "available_product_count mismatch"),
        F.when(F.size(F.array_except("suggested_product_ids", "all")) > 0, "suggested product not in catalog"),
        F.when(F.col("suggested_product_count") != F.size("suggested_product_ids"), "suggested_product_count mismatch"),
        F.when(~same(flagged, F.col("suggested_product_ids")), "suggested flags != suggested_product_ids"),
    )
    found = rows.select(KEY, "requirement_id", F.explode(F.filter(checks, lambda c: c.isNotNull())).alias("failure"))
    shown = view.select(KEY, "requirement_id", F.explode("suggested_product_ids").alias("product_id"))
    lost = x.links.join(shown, [KEY, "requirement_id", "product_id"], "left_anti").select(KEY, "requirement_id", F.concat(F.lit("link "), F.col("id"), F.lit(": not in suggested_product_ids")).alias("failure"))
    gone = x.requirements.select(KEY, F.col("id").alias("requirement_id")).exceptAll(view.select(KEY, "requirement_id")).withColumn("failure", F.lit("requirement missing from view"))
    return found.unionByName(lost).unionByName(gone)


def seed_selection(confirmed: Column, stored: Column, proposed: Column) -> Column:
    """What is ticked at first: confirmed products, else the stored choice, else the suggestions."""
    return F.coalesce(F.when(F.size(confirmed) > 0, confirmed), stored, proposed)


def toggle_group(selection: Column, visible: Column, on: Column) -> Column:
    return F.when(on, F.array_union(selection, visible)).otherwise(F.array_except(selection, visible))


def status_label(is_suggested: Column, is_selected: Column) -> Column:
    return F.when(is_suggested, "AI Suggested").when(is_selected, "Selected manually").otherwise("Available")


def search_products(pairs: DataFrame, query: str) -> DataFrame:
    """Rows of catalogue() that a search shows: a hit on the group keeps all its members."""
    q = query.strip().lower()
    if not q:
        return pairs
    return pairs.where(F.lower(F.coalesce("group_name", F.lit(""))).contains(q) | F.lower(F.coalesce("name", F.lit(""))).contains(q))


def search_requirements(requirements: DataFrame, query: str) -> DataFrame:
    said = [F.coalesce(c, F.lit("")) for c in ("title", "source_clause", type_title("submittal_type"), "requirement_text", "source_category")]
    return requirements.where(search(said, query))


def search_chunks(chunks: DataFrame, query: str = "", enriched_only: bool = False) -> DataFrame:
    """Chunks whose raw or enriched text holds the query."""
    q = query.lower()
    rows = chunks.where("was_enriched") if enriched_only else chunks
    return rows.where(F.lower("raw_text").contains(q) | F.lower("page_content").contains(q)) if q else rows


def per_clause(requirements: DataFrame) -> DataFrame:
    return requirements.groupBy(KEY, F.coalesce(F.nullif("source_clause", F.lit("")), F.lit("(none)")).alias("clause")).agg(F.count("*").alias("n"))


def review_targets(x: Extraction, evidence: DataFrame) -> DataFrame:
    """What a review opens for each entity: title, evidence ids, and the clauses of that evidence in first-seen order."""
    one = lambda df, kind, title: df.select(KEY, F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"), F.col(title).alias("title"), "evidence_ids")
    rows = one(x.requirements, "requirement", "title").unionByName(one(x.products, "product", "name")).unionByName(one(x.product_groups, "product_group", "name"))
    cited = rows.select(KEY, "entity_type", "entity_id", F.posexplode("evidence_ids").alias("i", "_e"))
    known = evidence.select(F.col(KEY).alias("_k"), F.col("id").alias("_id"), "source_clause")
    met = cited.join(known, (F.col(KEY) == F.col("_k")) & (F.col("_e") == F.col("_id"))).where("source_clause <> ''")
    clauses = met.groupBy(KEY, "entity_type", "entity_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "source_clause"))), lambda c: c["source_clause"])).alias("clauses"))
    return rows.join(clauses, [KEY, "entity_type", "entity_id"], "left").withColumn("clauses", F.coalesce("clauses", F.array().cast("array<string>")))
