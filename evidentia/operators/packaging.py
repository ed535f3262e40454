"""Draft submittals from a requirement and a choice of products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import text as X


def draft_id(section: Column, requirement: Column, mode: Column, product_ids: Column) -> Column:
    """Equal for the same section, requirement, mode and set of products."""
    joined = F.array_join(F.concat(F.array(F.coalesce(section, F.lit("")), requirement, mode), F.array_sort(product_ids)), "|")
    return X.content_id("draft", joined, bits=160, length=12)


def choose(requirements: DataFrame, selections: DataFrame, products: DataFrame) -> DataFrame:
    """requirements with `ids` and `names` of the selected products that exist, in the order of choice.

    selections: (key, requirement_id, product_ids); products: (key, product_id, name).
    """
    picked = selections.select("key", "requirement_id", F.posexplode("product_ids").alias("i", "product_id")).join(products.select("key", "product_id", "name"), ["key", "product_id"])
    held = picked.groupBy("key", "requirement_id").agg(F.array_sort(F.collect_list(F.struct("i", "product_id", "name"))).alias("x"))
    joined = requirements.join(held, ["key", "requirement_id"], "left")
    none = F.array().cast("array<string>")
    return joined.withColumns({"ids": F.coalesce(F.transform("x", lambda p: p["product_id"]), none), "names": F.coalesce(F.transform("x", lambda p: p["name"]), none)}).drop("x")


def drafts(chosen: DataFrame, *modes: str) -> DataFrame:
    """Draft rows of choose() under one or more modes: one for all products (also for none), or one for each."""
    one = lambda mode, title, ids, names, item: F.struct(F.lit(mode).alias("packaging_mode"), title.alias("title"), ids.alias("product_ids"), names.alias("product_names"), item.cast("int").alias("item"))
    made = {
        "combined": F.array(one("combined", F.col("title"), F.col("ids"), F.col("names"), F.lit(0))),
        "one_per_product": F.transform("ids", lambda p, i: one("one_per_product", F.concat(F.col("title"), F.lit(" - "), F.get("names", i)), F.array(p), F.array(F.get("names", i)), i)),
    }
    if unknown := set(modes) - made.keys():
        raise ValueError(f"unknown packaging mode: {', '.join(sorted(unknown))}")
    base = ["key", "requirement_id", "spec_section_id", "source_clause", "submittal_type", F.col("evidence_ids").alias("requirement_evidence_ids")]
    rows = chosen.select(*base, F.inline(F.concat(*(made[m] for m in modes))))
    return rows.withColumn("id", draft_id(F.col("key"), F.col("requirement_id"), F.col("packaging_mode"), F.col("product_ids"))).withColumn("project_section_key", F.col("key"))


def merge(existing: DataFrame, new: DataFrame, order: str = "item") -> tuple[DataFrame, DataFrame]:
    """(all rows, added rows): new rows with an id that is not there yet, the first of each."""
    first = new.withColumn("_rn", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("_rn = 1").drop("_rn")
    added = first.join(existing.select("id"), "id", "left_anti").select(*new.columns)
    return existing.unionByName(added, allowMissingColumns=True), added
