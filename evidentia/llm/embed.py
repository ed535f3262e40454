"""Near-duplicate embeddings by quantised tile products.

Vectors are scaled to unit length and rounded to int8 with a scale of their own;
the norm of what rounding lost is known for every vector.  A tile product of two
int8 blocks bounds every cosine from above, and only the pairs whose bound
reaches the threshold are computed again in double precision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm.common import cut, partitions, roots, small_batches, stored
from evidentia.llm.components import components

#: Slack for the rounding of the bounds' own arithmetic.
SLACK = 1e-9


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, errors): unit = codes * scales + e, and errors are the norms of e, rounded up."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / scale)
    error = np.linalg.norm(unit - codes * scale, axis=1) * (1 + 1e-12) + 1e-15
    return codes.astype(np.int8), scale[:, 0], error


def upper_bounds(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """Upper bounds of all cosines between two quantised blocks.

    x.y = (sx qx + ex).(sy qy + ey) <= sx sy qx.qy + |sx qx||ey| + |ex||sy qy| + |ex||ey|.
    """
    (qa, sa, ea), (qb, sb, eb) = a, b
    wide = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integers stay exact
    fa, fb = qa.astype(wide), qb.astype(wide)
    na, nb = (np.linalg.norm(f.astype(np.float64), axis=1) * s for f, s in ((fa, sa), (fb, sb)))
    dot = (fa @ fb.T).astype(np.float64)
    dot *= sa[:, None]
    dot *= sb[None, :]
    dot += np.outer(na + ea, eb)
    dot += (ea[:, None]) * nb[None, :]
    return dot + SLACK


def linked(x: np.ndarray, y: np.ndarray, least: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the rows of x and y whose cosine is `least` or more."""
    ux, uy = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    qx, qy = quantise(ux), quantise(uy)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    for at in range(0, len(x), step):
        i, j = np.nonzero(upper_bounds(tuple(v[at : at + step] for v in qx), qy) >= least)
        for part in range(0, len(i), 1 << 16):
            a, b = i[part : part + (1 << 16)] + at, j[part : part + (1 << 16)]
            cosine = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b])
            hit = cosine >= least
            yield a[hit], b[hit]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def vectors(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, key, v): v the vector as little-endian doubles, key its digest; null key and v if it can't link."""
    small_batches(table.sparkSession, 2048)
    kind = table.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, column = batch.column(1).to_pylist(), batch.column(2)
            at = column.offsets.to_numpy()
            x = column.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # null components are NaN, and there is one zero
            bad, some = (np.r_[0, np.cumsum(c)] for c in (~np.isfinite(x), x != 0))
            good = np.asarray(column.is_valid()) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
            data = memoryview(x.tobytes())
            kept = [bytes(data[8 * a : 8 * b]) if ok and label is not None else None for a, b, ok, label in zip(at[:-1].tolist(), at[1:].tolist(), good.tolist(), labels, strict=True)]
            keys = [None if v is None else hashlib.blake2b(f"{label}:".encode() + v, digest_size=16).digest() for v, label in zip(kept, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else str(x) for x in labels], pa.string()), pa.array(keys, pa.binary()), pa.array(kept, pa.binary())], ["id", "label", "key", "v"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("label", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("v", T.BinaryType())])
    return table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).mapInArrow(run, schema)


def tile_links(classes: DataFrame, least: float, tile: int) -> DataFrame:
    """Links between different vectors of a label, tile against tile.

    classes: (k, g, n, v), one row per different vector; g names its label and
    length, n counts its copies.  Rows (a, b, links): with b null, `links` more
    vectors link with a in one tile pair; else a-b is an edge of a spanning forest.
    """
    spark = classes.sparkSession
    sizes = cut(classes.groupBy("g").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).select(F.col("g").alias("g_"), "tiles"))
    met = classes.join(sizes, F.col("g") == F.col("g_")).withColumn("t", F.pmod(F.xxhash64("k", F.lit(1)), F.col("tiles")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda j: F.struct(F.least(F.col("t"), j).alias("x"), F.greatest(F.col("t"), j).alias("y"), F.when(F.col("t") == j, 2).when(F.col("t") < j, 0).otherwise(1).cast("tinyint").alias("side")),
    )
    rows = met.select("k", "n", "v", "g", F.inline(pairs)).select("k", "n", "v", F.xxhash64("g", "x", "y").alias("p"), "side")
    rows = rows.repartition(partitions(spark), "p").sortWithinPartitions("p", "side")

    def work(batch: pa.Table) -> Iterator[pa.RecordBatch]:
        k, n, side = (batch.column(c).to_numpy() for c in ("k", "n", "side"))
        v = np.frombuffer(b"".join(batch.column("v").to_pylist()), dtype="<f8").reshape(len(k), -1)
        v = _scaled(v)
        own = side[0] == 2
        left, right = (np.arange(len(k)),) * 2 if own else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        links, root = np.zeros(len(k), dtype=np.int64), np.arange(len(k))
        if len(left) and len(right):
            for i, j in linked(v[left], v[right], least):
                a, b = left[i], right[j]
                if own:
                    up = a < b  # both directions would count twice, and a vector is no link of its own
                    a, b = a[up], b[up]
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                moved = np.flatnonzero(root != np.arange(len(k)))
                root = roots(np.r_[moved, a], np.r_[root[moved], b], len(k))
        some, moved = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(k)))
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(k[some]), none, pa.array(links[some])], ["a", "b", "links"])
        yield pa.RecordBatch.from_arrays([pa.array(k[moved]), pa.array(k[root[moved]]), pa.array(np.zeros(len(moved), dtype=np.int64))], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            p = batch.column("p").to_numpy()
            edges = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and held[-1].column("p")[0].as_py() != p[a]:
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a long, b long, links long")


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, tile: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of table.

    Two vectors link if their labels are equal, their lengths too, and their
    cosine is `least` or more.  A vector that is null, empty or zero, that holds
    a null or non-finite component or has no label links with nothing: n_links is
    0 and component_id its own id.  Exact copies are one class and count one by
    one in n_links.  Repeated ids are separate vectors; component_id is the
    smallest non-null id.  Other columns are ignored.
    """
    assert 0 < least <= 1
    made = stored(vectors(table, id_col, vector_col, label_col), "vectors")
    some = made.where("key is not null")
    counted = some.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.min(F.struct("label", "v")).alias("x"))
    numbered = counted.select(F.monotonically_increasing_id().alias("k"), "key", "n", "least", F.xxhash64("x.label", F.length("x.v")).alias("g"), F.col("x.v").alias("v"))
    classes = stored(numbered, "vector-classes")
    found = cut(tile_links(classes.select("k", "g", "n", "v"), least, tile))
    groups = components(found.where("b is not null"))
    links = cut(found.where("b is null").groupBy("a").agg(F.sum("links").alias("others")))
    joined = classes.select("k", "key", "n", "least").join(links, F.col("k") == F.col("a"), "left").join(groups, F.col("k") == F.col("node"), "left")
    rooted = cut(joined.select("key", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "k").alias("root")))
    ids = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "root_"))
    labelled = cut(rooted.join(ids, F.col("root") == F.col("root_")).select(F.col("key").alias("key_"), "n_links", "component_id"))
    out = made.select("id", "key").join(labelled, F.col("key") == F.col("key_"), "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
