"""The search tool as a table function that SQL calls.

    register(spark)
    spark.sql("SELECT * FROM search_results(TABLE(hits), 3)")

where hits has the rows of vector.top_k() or index.search() beside those of their
chunks (schemas.CHUNK).  The function asks for its input by query and in order of
distance, so the caller need not say PARTITION BY.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SkipRestOfInputTableException, udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: What the input table must have.
NEEDED = ("query_id", "id", "distance", "chunk_id", "filename", "source", "page", "headings", "raw_text", "supporting_context", "page_content")
#: Results for a query unless told otherwise.
RESULTS = 8


def _said(x: object) -> str:
    return "" if x is None else str(x).strip()


def result(rank: int, row: Row) -> str:
    """One result as the search shows it."""
    raw, support = _said(row["raw_text"]), _said(row["supporting_context"])
    body = f"Supporting context:\n{support}\n\nPassage:\n{raw}" if support else raw or _said(row["page_content"])
    name = row["filename"] if row["filename"] is not None else row["source"] if row["source"] is not None else "Unknown"
    page = "" if row["page"] is None else f"; page {row['page']}"
    heads = f"\nHeadings: {row['headings']}" if row["headings"] else ""
    return f"[Source {rank}: {name}; chunk {row['chunk_id']}{page}; distance {row['distance']:.4f}]{heads}\n{body}"


@udtf
class SearchResults:
    """(query_id, n_results, text) for each query of a table of hits: its nearest chunks as one text.

    Results are numbered by distance, then id; after `k` of them the rest of a
    query's rows is not read.
    """

    @staticmethod
    def analyze(hits: AnalyzeArgument, k: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not hits.isTable:
            raise ValueError("search_results takes a table: TABLE(...)")
        if missing := [c for c in NEEDED if c not in hits.dataType.fieldNames()]:
            raise ValueError(f"search_results lacks columns: {', '.join(missing)}")
        if k is not None and (not k.isConstantExpression or not isinstance(k.value, int) or k.value < 1):
            raise ValueError("the number of results must be a constant of 1 or more")
        schema = StructType([StructField("query_id", hits.dataType["query_id"].dataType), StructField("n_results", IntegerType()), StructField("text", StringType())])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn("query_id")], orderBy=[OrderingColumn("distance"), OrderingColumn("id")])

    def __init__(self) -> None:
        self.query, self.results = None, []

    def eval(self, hits: Row, k: int = RESULTS) -> Iterator[tuple]:
        self.query = hits["query_id"]
        self.results.append(result(len(self.results) + 1, hits))
        if len(self.results) == k:
            raise SkipRestOfInputTableException("enough results")
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        if self.results:
            yield self.query, len(self.results), "\n\n---\n\n".join(self.results)


def register(spark: SparkSession, name: str = "search_results") -> None:
    """Make the table function known to the session's SQL."""
    spark.udtf.register(name, SearchResults.asDeterministic())
