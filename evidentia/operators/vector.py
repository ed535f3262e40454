"""Exact nearest vectors, and their results as text.

Queries are a small table by nature; their number and size are checked before
they are broadcast, and beyond the bound they are joined in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.functions import text as X

#: Most queries that go to the tasks at once, the numbers in them (about 6 MB), and queries in one matrix product.
MOST_QUERIES, MOST_NUMBERS, QUERY_ROWS = 1000, 768_000, 100


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def blocks(rows: DataFrame, key: str, most: int, size: Column | None = None, most_size: int = 0) -> list[DataFrame]:
    """rows in parts of about `most` rows by a hash of the key; one part if there are no more.

    With `size`, a number for each row, a part's sum of it is about `most_size` at most too.
    """
    told = rows.agg(F.count("*").alias("n"), F.sum(F.lit(0) if size is None else size).alias("s")).first()
    over = max(told["n"] / most, (told["s"] or 0) / most_size if most_size else 0)
    if over <= 1:
        return [rows]
    parts = -int(-over // 1) * 2
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(parts)))
    return [dealt.where(F.col("_b") == i).drop("_b") for i in range(parts)]


def top_k(base: DataFrame, queries: DataFrame, k: int = 8, id_col: str = "id", vector: str = "embedding", unit: bool = True) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of base for each row of queries (query_id, query).

    Distance is squared L2, between unit vectors if `unit`; equal distances go by
    id.  A vector that is null or empty, that has a null or non-finite component or
    another length than the query is no neighbour, and such a query has none.  A
    block of at most MOST_QUERIES queries and MOST_NUMBERS numbers goes to the
    tasks; there a matrix product bounds the distances to the rows of a batch, and
    only rows that can be among the k nearest are measured, so a task sends about k
    rows per query and batch.
    """
    near = None
    for part in blocks(queries.select("query_id", "query"), "query_id", MOST_QUERIES, F.size("query"), MOST_NUMBERS):
        found = _nearest(base, part, k, id_col, vector, unit)
        near = found if near is None else near.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def by_length(column: pa.Array, unit: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length above 0 the rows with a vector of finite numbers, and these as a matrix."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    out = {}
    for size in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == size)
        flat = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64())
        made = flat.to_numpy(zero_copy_only=False).reshape(len(rows), size)  # null components are NaN
        whole = np.isfinite(made).all(axis=1)
        rows, made = rows[whole], made[whole]
        if unit and len(rows):
            # a power of two in front, so that squares neither overflow nor vanish
            made = np.ldexp(made, -np.frexp(np.abs(made).max(axis=1, keepdims=True))[1])
            norm = np.sqrt(np.einsum("ij,ij->i", made, made))[:, None]
            made = np.divide(made, norm, out=made.copy(), where=norm > 0)
        if len(rows):
            out[size] = rows, made
    return out


def candidates(wanted: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, row) that hold the k nearest rows of v for each row of wanted; a few more within rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = (np.einsum("ij,ij->i", x, x) for x in (wanted, v))
        rough = a[:, None] + b - 2 * (wanted @ v.T)
        slack = 1e-12 * v.shape[1] * (a[:, None] + b)  # what rounding can make of it
        low, high = rough - slack, rough + slack
    unknown = ~(np.isfinite(low) & np.isfinite(high))  # squares beyond a double: measured in any case
    low[unknown], high[unknown] = -np.inf, np.inf
    at = min(k, len(v)) - 1
    return np.nonzero(low <= np.partition(high, at, axis=1)[:, at, None])


def _nearest(base: DataFrame, queries: DataFrame, k: int, id_col: str, vector: str, unit: bool) -> DataFrame:
    asked = queries.toArrow()  # blocks() bounds it
    names, column = asked.column(0).combine_chunks(), asked.column(1).combine_chunks()
    wanted = by_length(column, unit)
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", base.schema[id_col].dataType), T.StructField("distance", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, (rows, v) in by_length(batch.column(1), unit).items():
                own, q = wanted.get(size, ((), None))
                for at in range(0, len(own), QUERY_ROWS):
                    i, j = candidates(q[at : at + QUERY_ROWS], v, k)
                    with np.errstate(over="ignore"):
                        exact = np.concatenate([np.square(q[at + i[c : c + 65536]] - v[j[c : c + 65536]]).sum(axis=1) for c in range(0, len(i), 65536)])
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(own[at + i])), batch.column(0).take(pa.array(rows[j])), pa.array(exact)], ["query_id", "id", "distance"])

    return base.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).mapInArrow(run, schema)


def format_results(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, text): hits (query_id, id, distance, rank) on chunks (chunk_id, ...), as the search tool shows them."""
    rows = hits.join(chunks, hits["id"] == chunks["chunk_id"])
    page = F.when(F.col("page").isNotNull(), F.concat(F.lit("; page "), F.col("page"))).otherwise("")
    heads = F.when(F.coalesce("headings", F.lit("")) != "", F.concat(F.lit("\nHeadings: "), F.col("headings"))).otherwise("")
    raw, support = X.strip(F.coalesce("raw_text", F.lit(""))), X.strip(F.coalesce("supporting_context", F.lit("")))
    body = F.when(support != "", F.concat(F.lit("Supporting context:\n"), support, F.lit("\n\nPassage:\n"), raw)).when(raw != "", raw).otherwise(X.strip(F.coalesce("page_content", F.lit(""))))
    text = F.concat(F.lit("[Source "), F.col("rank"), F.lit(": "), F.coalesce("filename", "source", F.lit("Unknown")), F.lit("; chunk "), F.col("chunk_id"), page, F.format_string("; distance %.4f]", "distance"), heads, F.lit("\n"), body)
    held = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(held, lambda x: x["text"]), "\n\n---\n\n").alias("text"))


NO_RESULTS = "No relevant information was found in the uploaded documents."


def answers(queries: DataFrame, formatted: DataFrame) -> DataFrame:
    """(query_id, text) for every query, also those without a hit."""
    return queries.select("query_id").join(formatted, "query_id", "left").select("query_id", F.coalesce("text", F.lit(NO_RESULTS)).alias("text"))
