"""Extension: drafts and evidence as streams.

Not part of what the batch engine mirrors; it shows how the keyed, ordered state
of the batch operators is kept over micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidentia.functions import text as X
from evidentia.sources import store


def first_by_id(stream: DataFrame, time_col: str, delay: str = "1 hour", id_col: str = "id") -> DataFrame:
    """The first row of each id within the watermark; late repeats are dropped, state is bounded by `delay`."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])


def evidence_lines(stream: DataFrame) -> DataFrame:
    """Documents to content-addressed lines, row by row and so without state."""
    rows = stream.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("n", X.normalize("line", unicode=False)).where("n <> ''")
    return rows.select("doc_id", "pos", F.sha2("n", 256).alias("text_hash"))


def status_counts(stream: DataFrame, time_col: str = "ts", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events by type in tumbling windows, emitted once the watermark has passed."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def append_new(stream: DataFrame, path: str, checkpoint: str, writer: str, order: list[str] | None = None) -> StreamingQuery:
    """Put rows whose key the store at `path` (sources.store) does not hold yet into it; a batch that is run again adds nothing.

    `writer` names the stream: its batches are known to the store by that name.
    """

    def add(batch: DataFrame, number: int) -> None:
        store.upsert(batch, path, order, writer=writer, batch=number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
