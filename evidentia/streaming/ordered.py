"""Extension: clause numbers and the last short lines, carried along documents that come in as a stream.

What the batch operators find by windows is kept per document here: the clause in
force and a few short texts.  The rows of a document must come in order from batch
to batch; how they are cut into batches makes no difference.  A document that gets
no rows for a while may be let go by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.operators.chunks import KEPT_LINES, SHORT

#: Markers of the four levels of a clause, from the outermost.
LEVELS = ("article", "letter", "number", "subletter")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Carry(StatefulProcessor):
    """Gives each row its clause (evidence.clause_cascade) and the short texts before it (chunks.recent_short)."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clause = handle.getValueState("clause", ", ".join(f"{x} string" for x in LEVELS))
        self.short = handle.getValueState("short", "texts array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        levels = list(self.clause.get()) if self.clause.exists() else [None] * len(LEVELS)
        short = list(self.short.get()[0]) if self.short.exists() else []
        batch = pd.concat(rows).sort_values("pos", kind="stable")
        clauses, before = [], []
        for row in batch.itertuples(index=False):
            for i, name in enumerate(LEVELS):
                marker = getattr(row, name)
                if marker is not None and (i == 0 or levels[i - 1] is not None):
                    levels[i:] = [marker] + [None] * (len(LEVELS) - i - 1)
            clauses.append(".".join(x for x in levels if x is not None) if levels[0] is not None else None)
            before.append(list(short))
            if row.raw_text is not None and len(row.raw_text) < SHORT:
                short = [*short, row.raw_text][-KEPT_LINES:]
        self.clause.update(tuple(levels))
        self.short.update((short,))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({"document_id": key[0], "pos": batch["pos"], "clause": clauses, "preceding": before})

    def handleExpiredTimer(self, key: tuple, timers: object, expired: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.clause.clear()
        self.short.clear()
        return iter(())

    def close(self) -> None:
        pass


def carry(stream: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """(document_id, pos, clause, preceding) of a stream (document_id, pos, raw_text and LEVELS, each null where a row sets none).

    With idle_ms, the state of a document is let go once it gets no rows for so
    long, and rows that come later begin anew.  A query with such timers goes on
    until it is stopped, also under the trigger availableNow.  Needs the RocksDB
    state store, and sets it if the session has the default one.
    """
    spark = stream.sparkSession
    if "HDFSBackedStateStoreProvider" in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = stream.select("document_id", "pos", "raw_text", *LEVELS).groupBy("document_id")
    kind = stream.schema["document_id"].dataType.simpleString(), stream.schema["pos"].dataType.simpleString()
    return rows.transformWithStateInPandas(Carry(idle_ms), f"document_id {kind[0]}, pos {kind[1]}, clause string, preceding array<string>", "Append", "None" if idle_ms is None else "ProcessingTime")
