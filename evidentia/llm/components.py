"""Connected components by alternating star contractions.

Edges stay distributed; only counts reach the driver.  Each half round takes
the smallest neighbour of every node with a map-side combined minimum, cuts the
lineage, and joins it back.  Both sides of that join come from a checkpoint, so
adaptive execution can split the rows of a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v) to (u, v, m): m is the smallest of u and its neighbours."""
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")))
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    return cut(_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small(edges: DataFrame) -> DataFrame:
    """Edges run from the larger node u to the smaller node v."""
    kept = _least(edges).select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
    return cut(kept.where("u <> v").distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another; root is its component's smallest node.

    Rows with a null end and loops are no edges; repeated and reversed rows count
    once.  No edges give no rows.  Other columns of `edges` are ignored.
    """
    ends = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    now = cut(edges.where(F.col(a) != F.col(b)).select(ends[0].alias("u"), ends[1].alias("v")).distinct())
    state = None
    while True:
        # an order-free fingerprint of the edges: equal twice means that they are stars
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (found["n"], found["s"]) == state or not found["n"]:
            break
        state = found["n"], found["s"]
        now = _small(_large(now))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
