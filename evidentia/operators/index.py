"""A vector index of inverted lists, searched exactly.

Vectors go to the list of their nearest centre and keep the distance to it.  By the
triangle inequality a vector x of a list with centre c is no nearer to a query q
than |d(q, c) - d(x, c)|, so once k vectors are known, lists and vectors out of
reach need not be looked at.  Centres decide how much is read, never what is found.

On disk: `centres`, fitted once; `vectors/batch=.../list=...` with what each added
batch holds; `lists/batch=...` with its counts and reaches, written last.  A batch
without `lists` is not there yet; one that is added again replaces itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.operators.vector import MOST_NUMBERS, MOST_QUERIES, blocks, by_length, candidates
from evidentia.plans.lineage import cut

#: Vectors that centres are fitted on at most, and most centres.
MOST_SAMPLE, MOST_LISTS = 20_000, 1024
#: What rounding can make of a distance.
SLACK = 1e-9


class Index(NamedTuple):
    """An index that lies at `path`; unit says that vectors are scaled to length 1."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    unit: bool


def _finite(base: DataFrame, id_col: str, vector: str) -> DataFrame:
    whole = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return base.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & whole)


def create(base: DataFrame, path: str, id_col: str = "id", vector: str = "embedding", unit: bool = True, lists: int | None = None) -> Index:
    """An empty index at path with centres for vectors like those of base; add() fills it.

    The length of vectors is the commonest one (the larger of equally common ones).
    Centres come from at most MOST_SAMPLE of the vectors, those with the smallest
    hash of their id; their number is about the square root of the number of
    vectors unless given.  A base without a vector is an error.
    """
    spark = base.sparkSession
    rows = _finite(base, id_col, vector)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if sizes is None:
        raise ValueError("no vectors to index")
    size, n = sizes["size"], sizes["n"]
    k = min(lists or round(n**0.5) or 1, MOST_LISTS, n)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    own = F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v")) if unit else F.col("v")
    sample = rows.where(F.size("v") == size).orderBy(F.xxhash64("id"), "id").limit(MOST_SAMPLE).select(array_to_vector(own).alias("features"))
    centres = np.array(KMeans(k=k, maxIter=5, seed=1).fit(sample).clusterCenters()) if k > 1 else np.array([r["features"].toArray() for r in sample.limit(1).collect()])
    made = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(made, "list int, centre array<double>").withColumn("unit", F.lit(unit)).coalesce(1).write.parquet(f"{path}/centres")
    return Index(spark, path, centres, unit)


def open_index(spark: SparkSession, path: str) -> Index:
    rows = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r["list"])  # MOST_LISTS at most
    return Index(spark, path, np.array([r["centre"] for r in rows]), rows[0]["unit"])


def add(index: Index, rows: DataFrame, batch: str, id_col: str = "id", vector: str = "embedding") -> None:
    """Put the vectors of rows into their lists as `batch`, a name of letters, digits, _ and -.

    A vector of another length than the centres', or with null or non-finite
    components, is not indexed: no search could find it.  Adding a batch again
    replaces it.
    """
    if not re.fullmatch(r"[\w-]+", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    centres, unit, size = index.centres, index.unit, index.centres.shape[1]
    schema = T.StructType([T.StructField("id", rows.schema[id_col].dataType), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("away", T.DoubleType()), T.StructField("list", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if found := by_length(b.column(1), unit).get(size):
                at, v = found
                near = np.argmin((centres * centres).sum(axis=1) - 2 * (v @ centres.T), axis=1)
                away = np.sqrt(np.square(v - centres[near]).sum(axis=1))
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * size), pa.array(v.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), held, pa.array(away), pa.array(near.astype(np.int32))], ["id", "v", "away", "list"])

    dealt = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInArrow(run, schema)
    # a task writes a file for each list that it has; rebalanced, small lists share a task and large ones are split
    dealt.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{index.path}/vectors/batch={batch}")
    there = index.spark.read.schema(schema).option("basePath", f"{index.path}/vectors/batch={batch}").parquet(f"{index.path}/vectors/batch={batch}")
    there.groupBy("list").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).coalesce(1).write.mode("overwrite").parquet(f"{index.path}/lists/batch={batch}")


def lists(index: Index) -> DataFrame:
    """(batch, list, n, low, high): what each batch has in each list, and how far from the centre."""
    schema = "list int, n long, low double, high double, batch string"
    try:
        return index.spark.read.schema(schema).parquet(f"{index.path}/lists")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # nothing is added yet
            raise
        return index.spark.createDataFrame([], schema)


def search(index: Index, queries: DataFrame, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """(hits, report): the k nearest vectors of each row of queries (query_id, query), exactly.

    hits (query_id, id, distance, rank) are those of vector.top_k: squared L2, equal
    distances by id; queries that have no comparable vector get none.  report
    (query_id, lists, lists_read, vectors, vectors_read) tells how much of the
    index was read for a query.
    """
    held = lists(index).groupBy("list").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()  # MOST_LISTS at most
    batches = [r["batch"] for r in lists(index).select("batch").distinct().collect()]
    parts = [_search(index, part, k, held, batches) for part in blocks(queries.select("query_id", "query"), "query_id", MOST_QUERIES, F.size("query"), MOST_NUMBERS)]
    return tuple(reduce(DataFrame.unionByName, side) for side in zip(*parts, strict=True))


def _search(index: Index, queries: DataFrame, k: int, held: list, batches: list[str]) -> tuple[DataFrame, DataFrame]:
    spark, asked = index.spark, queries.toArrow()  # blocks() bounds it
    names, column = asked.column(0).combine_chunks(), asked.column(1).combine_chunks()
    own, q = by_length(column, index.unit).get(index.centres.shape[1], (np.zeros(0, dtype=np.int64), np.zeros((0, index.centres.shape[1]))))
    number = np.array([r["list"] for r in held], dtype=np.int64)
    n, low, high = (np.array([r[c] for r in held], dtype=float) for c in ("n", "low", "high"))
    to = np.sqrt(np.maximum(np.square(q[:, None, :] - index.centres[number][None]).sum(axis=2), 0)) if len(number) else np.zeros((len(q), 0))
    order = np.argsort(to, axis=1, kind="stable")
    # the nearest lists that have k vectors between them say how far the k-th can be
    before = np.cumsum(n[order], axis=1) - n[order]
    first = np.zeros(to.shape, dtype=bool)
    np.put_along_axis(first, order, before < k, axis=1)
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", _id_type(index, batches)), T.StructField("distance", T.DoubleType())])
    near = _measured(index, batches, number, first, to, np.full(len(q), np.inf), own, q, names, k, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    near = cut(near)
    reach = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("d")).toArrow()  # a row per query of the block
    by_name = dict(zip(reach.column(0).to_pylist(), reach.column(1).to_pylist(), strict=True))
    told = names.take(pa.array(own)).to_pylist()
    reach = np.array([np.inf if by_name.get(x) is None else by_name[x] ** 0.5 for x in told]) * (1 + SLACK) + SLACK
    least = np.maximum(np.maximum(to - high, low - to), 0)
    more = (least <= reach[:, None]) & ~first
    rest = _measured(index, batches, number, more, to, reach, own, q, names, k, schema)
    hits = near.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k)
    read = first | more
    counts = {i: (int(r.sum()), int(n[r].sum())) for i, r in zip(own.tolist(), read, strict=True)}
    rows = [(x, len(number), counts.get(i, (0, 0))[0], int(n.sum()), counts.get(i, (0, 0))[1]) for i, x in enumerate(names.to_pylist())]
    kinds = T.StructType([queries.schema["query_id"], *T._parse_datatype_string("lists int, lists_read int, vectors long, vectors_read long")])
    return hits, spark.createDataFrame(rows, kinds)


def _id_type(index: Index, batches: list[str]) -> T.DataType:
    return index.spark.read.parquet(f"{index.path}/vectors/batch={batches[0]}").schema["id"].dataType if batches else T.LongType()


def _measured(index: Index, batches: list[str], number: np.ndarray, wanted: np.ndarray, to: np.ndarray, reach: np.ndarray, own: np.ndarray, q: np.ndarray, names: pa.Array, k: int, schema: T.StructType) -> DataFrame:
    """Distances of queries to the vectors of the lists that they want; of a batch of rows those that can be among the k nearest."""
    spark = index.spark
    lists_of = {int(c): np.flatnonzero(wanted[:, i]) for i, c in enumerate(number) if wanted[:, i].any()}
    if not lists_of:
        return spark.createDataFrame([], schema)
    at = {int(c): to[:, i] for i, c in enumerate(number) if int(c) in lists_of}

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            which = b.column("list").to_numpy()
            for c in np.unique(which).tolist():
                rows, asking = np.flatnonzero(which == c), lists_of[c]
                part = b.take(pa.array(rows))
                v, away = part.column("v").flatten().to_numpy().reshape(len(rows), -1), part.column("away").to_numpy()
                inside = np.abs(at[c][asking][:, None] - away[None]) <= reach[asking][:, None]
                asking, rows = asking[inside.any(axis=1)], np.flatnonzero(inside.any(axis=0))
                if not len(asking):
                    continue
                i, j = candidates(q[asking], v[rows], k)
                distance = np.concatenate([np.square(q[asking[i[s : s + 65536]]] - v[rows[j[s : s + 65536]]]).sum(axis=1) for s in range(0, len(i), 65536)])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own[asking[i]])), part.column("id").take(pa.array(rows[j])), pa.array(distance)], ["query_id", "id", "distance"])

    kinds = T.StructType([schema["id"], T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("away", T.DoubleType()), T.StructField("list", T.IntegerType()), T.StructField("batch", T.StringType())])
    there = spark.read.schema(kinds).parquet(f"{index.path}/vectors").where(F.col("batch").isin(batches) & F.col("list").isin(sorted(lists_of)))
    return there.select("id", "v", "away", "list").mapInArrow(run, schema)
