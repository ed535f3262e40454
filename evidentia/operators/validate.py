"""Validation of extracted entities against the evidence that they cite.

Four tables (requirements, groups, products, links) come in, each keyed by
project_section_key and ordered by ord.  Every rule gives rows that stay and rows
of issues; rejects propagate from groups to products and from requirements and
products to links.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import predicates as P
from evidentia.functions import text as X
from evidentia.plans.lineage import cut

KEY = "project_section_key"
ENTITIES = ("requirement", "product_group", "product", "link")


class Extraction(NamedTuple):
    requirements: DataFrame
    product_groups: DataFrame
    products: DataFrame
    links: DataFrame


class Validated(NamedTuple):
    extraction: Extraction
    issues: DataFrame
    rejected: DataFrame
    downgrades: DataFrame
    stripped_cross_references: DataFrame
    stripped_conditions: DataFrame


class _Log:
    """Issues and rejects, as they come up."""

    def __init__(self) -> None:
        self.issues: list[DataFrame] = []
        self.rejected: list[DataFrame] = []

    def issue(self, rows: DataFrame, severity: str, entity: str, code: str, message: Column | str, phase: int, rule: int, ids: Column | None = None, item: Column | None = None) -> None:
        self.issues.append(rows.select(
            KEY, F.lit(severity).alias("severity"), F.lit(entity).alias("entity_type"), F.col("id").alias("entity_id"), F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"),
            (F.array() if ids is None else ids).cast("array<string>").alias("evidence_ids"), F.lit(phase).alias("phase"), "ord", F.lit(rule).alias("rule"), (F.lit(0) if item is None else item).cast("int").alias("item"),
        ))

    def reject(self, rows: DataFrame, entity: str, code: str, message: Column | str, phase: int, rule: int, ids: Column | None = None) -> None:
        self.issue(rows, "error", entity, code, message, phase, rule, ids)
        ends = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("requirement_id", "product_id")]  # of links
        self.rejected.append(rows.select(KEY, F.lit(entity).alias("entity_type"), F.col("id").alias("entity_id"), F.lit(code).alias("reason"), F.lit(phase).alias("phase"), "ord", *ends))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _unique(rows: DataFrame, entity: str, log: _Log) -> DataFrame:
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(KEY, "id").orderBy("ord")))
    later = ranked.where("id is not null and _rn > 1")
    log.reject(later, entity, "duplicate_entity_id", F.concat(F.lit(f"Duplicate {entity} ID '"), F.col("id"), F.lit("' rejected.")), 0, ENTITIES.index(entity))
    return ranked.where("id is null or _rn = 1").drop("_rn")


def _cite(tables: list[DataFrame], evidence: DataFrame, log: _Log, unicode: bool) -> list[DataFrame]:
    """The four tables with evidence_ids known and unique, blob_key and clauses of what they cite; rows that cite nothing known go.

    What all of them cite is joined with the evidence in one go.
    """
    each = _union([rows.select(KEY, F.lit(entity).alias("entity"), "ord", "id", F.posexplode("evidence_ids").alias("item", "_eid")) for rows, entity in zip(tables, ENTITIES, strict=True)])
    known = evidence.select(F.col(KEY).alias("_k"), F.col("id").alias("_e"), "raw_text", "heading_path", "source_clause")
    met = cut(each.join(known, (F.col(KEY) == F.col("_k")) & (F.col("_eid") == F.col("_e")), "left"))
    lines = F.array_join(F.concat(F.array(F.coalesce("raw_text", F.lit(""))), F.coalesce("heading_path", F.array().cast("array<string>")), F.when(F.coalesce("source_clause", F.lit("")) != "", F.array("source_clause")).otherwise(F.array().cast("array<string>"))), "\n")
    first = met.where("_e is not null").groupBy(KEY, "entity", "ord", "_eid").agg(F.min("item").alias("item"), F.first(lines).alias("said"), F.first("source_clause").alias("clause"))
    held = first.groupBy(KEY, "entity", "ord").agg(F.array_sort(F.collect_list(F.struct("item", "_eid", "said", "clause"))).alias("x"))
    got = held.select(KEY, "entity", "ord", F.transform("x", lambda c: c["_eid"]).alias("kept"), F.array_join(F.transform("x", lambda c: c["said"]), "\n").alias("blob"), F.filter(F.transform("x", lambda c: c["clause"]), lambda c: c.isNotNull()).alias("clauses"))
    got = cut(got.withColumn("blob_key", X.match_key("blob", unicode)).drop("blob"))
    out = []
    for rows, entity, phase in zip(tables, ENTITIES, (1, 2, 3, 5), strict=True):
        log.issue(met.where((F.col("entity") == entity) & F.col("_e").isNull()), "error", entity, "unknown_evidence_id", F.concat(F.lit("Unknown evidence ID '"), F.col("_eid"), F.lit("' stripped.")), phase, 0, F.array("_eid"), F.col("item"))
        joined = rows.join(got.where(F.col("entity") == entity).drop("entity"), [KEY, "ord"], "left")
        shown = {"requirement": "Requirement", "product_group": "ProductGroup", "product": "Product", "link": "Link"}[entity]
        log.reject(joined.where("kept is null"), entity, "no_valid_evidence", f"{shown} rejected: no valid evidence IDs remain.", phase, 1)
        out.append(joined.where("kept is not null").withColumn("evidence_ids", F.col("kept")).drop("kept"))
    return out


def _quoted(before: str, name: str, after: str) -> Column:
    return F.concat(F.lit(before), F.coalesce(F.col(name), F.lit("None")), F.lit(after))


def _groups(rows: DataFrame, log: _Log, unicode: bool) -> DataFrame:
    judged = rows.withColumn("_ok", P.contains_key(F.col("blob_key"), X.match_key("name", unicode)))
    log.reject(judged.where("not _ok"), "product_group", "unsupported_group_name", _quoted("ProductGroup name '", "name", "' not supported by cited evidence."), 2, 2, F.col("evidence_ids"))
    return judged.where("_ok").drop("_ok")


def _products(rows: DataFrame, groups: DataFrame, log: _Log, unicode: bool) -> DataFrame:
    judged = rows.withColumn("support", P.name_support("name", "normalized_name", F.col("blob_key"), unicode))
    judged = cut(judged)
    ids = F.col("evidence_ids")
    log.reject(judged.where("support.mode = 'unsupported'"), "product", "unsupported_product_name", _quoted("Product name/normalized_name not supported by cited evidence (name='", "name", "')."), 3, 2, ids)
    kept = judged.where("support.mode <> 'unsupported'")
    fell = kept.where("support.mode = 'core_fallback'")
    log.issue(fell, "warning", "product", "product_name_qualifier_not_source_literal", F.concat(F.lit("Core product name '"), F.col("support.core"), F.lit("' is supported; qualifier '"), F.col("support.qualifier"), F.lit("' was treated as a display qualifier.")), 3, 3, ids)
    alive = groups.select(F.col(KEY).alias("_k"), F.col("id").alias("_g")).distinct()
    joined = kept.join(alive, (F.col(KEY) == F.col("_k")) & (F.col("product_group_id") == F.col("_g")), "left")
    dangling = (F.coalesce("product_group_id", F.lit("")) != "") & F.col("_g").isNull()
    log.issue(joined.where(dangling), "warning", "product", "dangling_product_group_id", _quoted("product_group_id '", "product_group_id", "' is dangling; cleared to None."), 3, 4)
    return joined.withColumn("product_group_id", F.when(~dangling, F.col("product_group_id"))).drop("_k", "_g")


def _requirements(rows: DataFrame, log: _Log, unicode: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, stripped cross references, stripped conditions)."""
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    ids = F.col("evidence_ids")
    clause = F.exists("clauses", lambda c: P.clause_supports("source_clause", c))
    log.issue(rows.where(said("source_clause") & ~F.coalesce(clause, F.lit(False))), "warning", "requirement", "unsupported_source_clause", _quoted("source_clause '", "source_clause", "' not supported by cited evidence clauses."), 4, 0, ids)
    holds = lambda c: P.contains_key(F.col("blob_key"), X.match_key(c, unicode))
    log.issue(rows.where(said("source_category") & ~holds("source_category")), "warning", "requirement", "unsupported_source_category", _quoted("source_category '", "source_category", "' not clearly supported by cited evidence text/headings."), 4, 2, ids)
    rows = rows.withColumn("_strip", said("condition") & ~holds("condition"))
    log.issue(rows.where("_strip"), "warning", "requirement", "unsupported_condition", _quoted("condition '", "condition", "' not supported by cited evidence; cleared to None."), 4, 3, ids)
    conditions = rows.where("_strip").select(KEY, F.col("id").alias("requirement_id"), "condition", "ord")
    refs = rows.select(KEY, "ord", "id", "evidence_ids", "blob_key", F.posexplode("cross_references").alias("item", "ref"))
    refs = cut(refs.withColumn("_ok", P.cross_reference_supported("ref", F.col("blob_key"), unicode)))
    gone = refs.where("not _ok")
    log.issue(gone, "warning", "requirement", "unsupported_cross_reference", _quoted("cross_reference '", "ref", "' not found in cited evidence; stripped."), 4, 4, ids, F.col("item"))
    kept = refs.where("_ok").groupBy(KEY, "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "ref"))), lambda x: x["ref"]).alias("_refs"))
    out = rows.join(kept, [KEY, "ord"], "left").withColumns({"condition": F.when(~F.col("_strip"), F.col("condition")), "cross_references": F.coalesce("_refs", F.array().cast("array<string>"))})
    return out.drop("_strip", "_refs"), gone.select(KEY, F.col("id").alias("requirement_id"), F.col("ref").alias("cross_reference"), "ord", "item"), conditions


def _links(rows: DataFrame, requirements: DataFrame, products: DataFrame, log: _Log, unicode: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, downgrades)."""
    req = requirements.select(F.col(KEY).alias("_rk"), F.col("id").alias("_r"), F.col("blob_key").alias("req_key"))
    prod = products.select(F.col(KEY).alias("_pk"), F.col("id").alias("_p"), F.col("blob_key").alias("prod_key"), F.col("name").alias("_name"), F.col("normalized_name").alias("_normal"))
    met = rows.join(req, (F.col(KEY) == F.col("_rk")) & (F.col("requirement_id") == F.col("_r")), "left").join(prod, (F.col(KEY) == F.col("_pk")) & (F.col("product_id") == F.col("_p")), "left")
    met = met.withColumns({"_phrase": X.match_key("source_phrase", unicode), "_n": X.match_key("_name", unicode), "_nn": X.match_key("_normal", unicode), "_has": F.coalesce("source_phrase", F.lit("")) != ""})
    within = lambda key: P.contains_key(F.col(key), F.col("_phrase")) & F.col("_has")
    any_in = lambda key: within(key) | P.contains_key(F.col(key), F.col("_n")) | P.contains_key(F.col(key), F.col("_nn"))
    # requirements and products have been through their own checks, so a product's name has support
    met = met.withColumns({"p_req": within("req_key"), "p_link": within("blob_key"), "a_req": any_in("req_key"), "a_prod": any_in("prod_key"), "a_link": any_in("blob_key")})
    ids = F.col("evidence_ids")
    method = F.col("mapping_method")
    explicit_ok = F.when(F.col("_has"), F.col("p_req")).otherwise(F.col("a_req"))
    fate = (
        F.when((method == "explicit") & ~explicit_ok, F.when(F.col("a_req") | F.col("a_link"), "downgrade").otherwise("reject"))
        .when((method == "normalized") & ~F.col("a_req"), F.lit("downgrade"))  # the product side always holds here
        .otherwise("keep")
    )
    met = cut(met.withColumn("fate", fate))
    log.reject(met.where("_r is null"), "link", "dangling_requirement_id", _quoted("Link rejected: requirement_id '", "requirement_id", "' does not exist in surviving requirements."), 5, 2)
    log.reject(met.where("_r is not null and _p is null"), "link", "dangling_product_id", _quoted("Link rejected: product_id '", "product_id", "' does not exist in surviving products."), 5, 3)
    met = met.where("_r is not null and _p is not null")
    log.issue(met.where("_has and not p_link and not p_req"), "warning", "link", "unsupported_source_phrase", _quoted("source_phrase '", "source_phrase", "' not found in cited link/requirement evidence."), 5, 4, ids)
    explicit = met.where("fate = 'downgrade' and mapping_method = 'explicit'")
    normal = met.where("fate = 'downgrade' and mapping_method = 'normalized'")
    log.issue(explicit, "warning", "link", "mapping_downgraded", "explicit unsupported; downgraded to inferred with review_required=True.", 5, 5, ids)
    log.issue(normal, "warning", "link", "mapping_downgraded", "normalized incomplete; downgraded to inferred with review_required=True.", 5, 5, ids)
    why = F.when(method == "explicit", "explicit_not_supported").otherwise("normalized_incomplete")
    downgrades = met.where("fate = 'downgrade'").select(KEY, F.col("id").alias("link_id"), method.alias("from"), F.lit("inferred").alias("to"), why.alias("reason"), "ord")
    log.reject(met.where("fate = 'reject'"), "link", "unsupported_explicit_mapping", "Link rejected: explicit mapping not source-supported.", 5, 6, ids)
    down = F.col("fate") == "downgrade"
    met = met.where("fate <> 'reject'").withColumns({
        "mapping_method": F.when(down, "inferred").otherwise(method),
        "confidence": F.when(down, F.coalesce("confidence", F.lit(0.5))).otherwise(F.col("confidence")),
        "review_required": F.when(down, True).otherwise(F.coalesce("review_required", F.lit(False))),
    })
    inferred = F.col("mapping_method") == "inferred"
    log.issue(met.where(inferred & ~F.col("review_required")), "warning", "link", "inferred_missing_review_required", "inferred link missing review_required; set True.", 5, 7, ids)
    log.reject(met.where(inferred & F.col("confidence").isNull()), "link", "inferred_missing_confidence", "Link rejected: inferred mapping requires confidence.", 5, 8, ids)
    met = met.where(~inferred | F.col("confidence").isNotNull()).withColumn("review_required", F.col("review_required") | inferred)
    plausible = F.col("a_req") | F.col("a_prod") | F.col("a_link")
    log.reject(met.where(inferred & ~plausible), "link", "unsupported_inferred_mapping", "Link rejected: inferred mapping has no plausible evidence.", 5, 9, ids)
    return met.where(~inferred | plausible), downgrades


def validate(found: Extraction, evidence: DataFrame, unicode: bool = True) -> Validated:
    """The entities that stand, and the report; evidence has project_section_key and the columns of schemas.EVIDENCE."""
    log = _Log()
    columns = [df.columns for df in found]
    requirements, groups, products, links = _cite([_unique(df, name, log) for df, name in zip(found, ENTITIES, strict=True)], evidence, log, unicode)
    groups = _groups(groups, log, unicode)
    products = _products(products, groups, log, unicode)
    requirements, refs, conditions = _requirements(cut(requirements), log, unicode)
    links, downgrades = _links(links, requirements, products, log, unicode)
    kept = Extraction(*(df.select(*c) for df, c in zip((requirements, groups, products, links), columns, strict=True)))
    kept = Extraction(*map(cut, kept))
    # issues and rejects are not made here: a view that asks for what stands does not pay for them
    return Validated(kept, _union(log.issues), _union(log.rejected), downgrades, refs, conditions)


ISSUE_ORDER = ["phase", "ord", "rule", "item"]


def tally(issues: DataFrame) -> DataFrame:
    """(key, severity, code, n): how often each issue came up."""
    return issues.groupBy(KEY, "severity", "code").agg(F.count("*").alias("n"))


def report(v: Validated, sections: DataFrame) -> DataFrame:
    """One row per section: valid, accepted and rejected counts by entity, tallies as warning:code and error:code."""
    names = dict(zip(ENTITIES, ("requirements", "product_groups", "products", "links"), strict=True))
    count = lambda parts: _union(parts).groupBy(KEY).pivot("entity_type", list(ENTITIES)).agg(F.count(F.lit(1)))
    accepted = count([df.select(KEY, F.lit(n).alias("entity_type")) for n, df in zip(ENTITIES, v.extraction, strict=True)])
    rejected = count([v.rejected.select(KEY, "entity_type")])
    as_map = lambda name: F.create_map(*[x for e in ENTITIES for x in (F.lit(names[e]), F.coalesce(F.col(f"`{e}`"), F.lit(0)))]).alias(name)
    tallied = tally(v.issues).groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "severity", "code"), "n"))).alias("warning_counts"), F.bool_or(F.col("severity") == "error").alias("bad"))
    out = sections.select(KEY).distinct().join(tallied, KEY, "left")
    out = out.join(accepted.select(KEY, as_map("accepted_counts")), KEY, "left").join(rejected.select(KEY, as_map("rejected_counts")), KEY, "left")
    zero = F.create_map(*[x for e in ENTITIES for x in (F.lit(names[e]), F.lit(0).cast("long"))])
    return out.select(KEY, (~F.coalesce("bad", F.lit(False))).alias("valid"), F.coalesce("accepted_counts", zero).alias("accepted_counts"), F.coalesce("rejected_counts", zero).alias("rejected_counts"), F.coalesce("warning_counts", F.create_map().cast("map<string,bigint>")).alias("warning_counts"))
