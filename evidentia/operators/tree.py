"""Reading order of parsed documents: from a body, through children and nested groups.

A parsed document holds its parts in flat arrays; the body and the groups name
their children.  A part's place is the list of child numbers on the way down to it,
and these lists in order are the order in which a walk meets the parts.  The ways
are put together by pointer doubling: each round joins a part's way to its
ancestor's, so as many rounds are needed as the depth has binary digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.plans.lineage import cut

#: Where a walk starts, the arrays of parts and their kinds (fixed values).
ROOT = "#/body"
ARRAYS = {"groups": "group", "texts": "text", "pictures": "picture", "tables": "table", "key_value_items": "item", "form_items": "item"}
#: The layer that is read; parts of others, such as page headers, are left out, but not what is below them.
LAYER = "body"
ITEM = ("self_ref", "label", "orig", "text", "marker", "prov")


def _part(x: Column, kind: str, fields: list[str], prov: str) -> Column:
    own = lambda name, type_: (x[name] if name in fields else F.lit(None)).cast(type_).alias(name)
    return F.struct(
        x["self_ref"].alias("self_ref"), F.lit(kind).alias("kind"), F.coalesce(x["content_layer"], F.lit(LAYER)).alias("layer"), x["parent"]["$ref"].alias("said_parent"),
        F.transform(x["children"], lambda c: c["$ref"]).alias("children"), *(own(c, "string") for c in ITEM[1:-1]), own("prov", prov),
    )


def parts(documents: DataFrame) -> DataFrame:
    """One row for the body and each part of documents (document_id and the columns of schemas.PARSED)."""
    prov = documents.schema["texts"].dataType.elementType["prov"].dataType.simpleString()
    names = lambda c: documents.schema[c].dataType.elementType.names
    each = lambda c, kind: F.transform(c, lambda x: _part(x, kind, names(c), prov))
    all_of = [F.coalesce(each(c, kind), F.array()) for c, kind in ARRAYS.items()]
    root = F.array(_part(F.col("body"), "root", documents.schema["body"].dataType.names, prov))
    return documents.select("document_id", F.inline(F.concat(root, *all_of)))


def reading_order(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rejects): the parts that a walk from the body meets, and references that lead nowhere.

    items has document_id, pos from 0, level and the columns of ITEM; groups and
    parts of other layers have no place of their own, and what hangs on a picture is
    not read.  rejects (document_id, ref, reason): dangling_reference names no part
    of the document, second_reference a part that another reference has already (the
    one of the parent that the part itself names counts, else the first), repeated_ref
    a part under a ref that an earlier part of the array has, cycle parts that only
    each other lead to.  Parts that nothing leads to, such as the furniture, are
    neither.  Documents without a body have no items.
    """
    rank = F.row_number().over(Window.partitionBy("document_id", "self_ref").orderBy("kind", "n"))
    rows = parts(documents).where("self_ref is not null").withColumn("n", F.monotonically_increasing_id())
    ranked = cut(rows.withColumn("rank", rank))
    nodes, repeated = ranked.where("rank = 1").drop("rank", "n"), ranked.where("rank > 1")
    named = nodes.select("document_id", F.col("self_ref").alias("parent"), F.col("kind").alias("parent_kind"), F.posexplode("children").alias("place", "ref"))
    known = nodes.select(F.col("document_id").alias("d"), F.col("self_ref").alias("r"), "said_parent", "kind")
    met = named.join(known, (F.col("document_id") == F.col("d")) & (F.col("ref") == F.col("r")), "left")
    order = Window.partitionBy("document_id", "ref").orderBy(F.desc(F.coalesce(F.col("said_parent") == F.col("parent"), F.lit(False))), "parent", "place")
    met = cut(met.withColumn("rank", F.row_number().over(order)))
    edges = met.where("r is not null and rank = 1")
    reason = F.when(F.col("r").isNull(), "dangling_reference").when(F.col("rank") > 1, "second_reference")
    rejects = met.select("document_id", "ref", reason.alias("reason")).where("reason is not null").unionByName(repeated.select("document_id", F.col("self_ref").alias("ref"), F.lit("repeated_ref").alias("reason")))
    ways, lost = _ways(edges.select("document_id", "ref", F.col("parent").alias("top"), F.array("place").alias("way"), (F.col("parent_kind") == "picture").alias("hidden")))
    rejects = rejects.unionByName(lost.select("document_id", "ref", F.lit("cycle").alias("reason")))
    found = ways.where((F.col("top") == ROOT) & ~F.col("hidden")).select(F.col("document_id").alias("d"), "ref", "way")
    read = nodes.where((F.col("layer") == LAYER) & ~F.col("kind").isin("group", "root")).join(found, (F.col("document_id") == F.col("d")) & (F.col("self_ref") == F.col("ref")))
    pos = F.row_number().over(Window.partitionBy("document_id").orderBy("way")) - 1
    return read.select("document_id", pos.alias("pos"), F.size("way").alias("level"), *ITEM), rejects


def _ways(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ways, lost): edges (document_id, ref, top, way, hidden) with top the end of the line; lost are those that have none.

    Every part has one parent here, so a line ends at a part without one, or goes
    round.  As long as some part comes to an end in a round, the next may bring more.
    """
    now = cut(edges)
    done, left = None, now
    before = -1
    while True:
        up = now.select(F.col("document_id").alias("d"), F.col("ref").alias("r"), F.col("top").alias("t"), F.col("way").alias("w"), F.col("hidden").alias("h"))
        met = cut(left.join(up, (F.col("document_id") == F.col("d")) & (F.col("top") == F.col("r")), "left"))
        ended = met.where("r is null").select("document_id", "ref", "top", "way", "hidden")
        more = met.where("r is not null").select("document_id", "ref", F.col("t").alias("top"), F.concat("w", "way").alias("way"), (F.col("hidden") | F.col("h")).alias("hidden"))
        done = ended if done is None else done.unionByName(ended)
        count = more.count()
        if count in (0, before):
            return done, more
        before, left = count, more
        now = cut(done.unionByName(more))
