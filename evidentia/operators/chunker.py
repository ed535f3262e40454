"""A structural chunker: the pieces of documents packed into chunks under a budget of tokens.

Neighbouring pieces under the same headings are peers.  Among peers a chunk takes
as many pieces as fit; where it ends depends only on where it starts, so each piece
can tell where a chunk from it on would end, and the chunks are those that one
meets from the first piece on, found by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.plans.lineage import cut

#: Tokens of a chunk, its headings counted in.
BUDGET = 700
#: White space, and a token: a word, or another sign by itself.
WHITE = " \t\n\x0b\f\r"
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_" + WHITE + "]"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _pieces(items: DataFrame, budget: int, key: str, order: str) -> DataFrame:
    """Items with room for their text beside the headings; a longer text becomes pieces of as many tokens as fit, with what stands between them."""
    room = F.greatest(F.lit(budget) - tokens(F.array_join("headings", "\n")), F.lit(1))
    rows = items.select(key, F.col(order).alias("_at"), "text", "headings", "labels", "page").withColumns({"room": room, "n": tokens(F.col("text"))})
    rows = rows.where("n > 0")
    # each token with the white space after it, so that the parts joined are the text
    spaced = F.regexp_extract_all("text", F.lit(f"(?:{TOKEN})[{WHITE}]*"), F.lit(0))
    cut_at = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("room"))
    parts = F.transform(F.array(spaced), lambda t: F.transform(cut_at, lambda i: F.rtrim(F.array_join(F.slice(t, (i + 1).cast("int"), F.col("room").cast("int")), ""), F.lit(WHITE))))[0]
    long = F.col("n") > F.col("room")
    each = rows.select(key, "_at", "headings", "labels", "page", "room", "n", F.posexplode(F.when(long, parts).otherwise(F.array("text"))).alias("_part", "text"))
    return each.withColumn("n", F.when(F.col("n") > F.col("room"), F.least(F.col("room"), F.col("n") - F.col("_part") * F.col("room"))).otherwise(F.col("n")))


def _segments(pieces: DataFrame, key: str) -> DataFrame:
    """pieces with segment, the run of peers that they are in, idx in it and start, the tokens before them in it."""
    w = Window.partitionBy(key).orderBy("_at", "_part")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = pieces.withColumn("turn", F.coalesce(F.lag("headings").over(w) != F.col("headings"), F.lit(True)).cast("int"))
    rows = rows.withColumn("segment", F.sum("turn").over(so_far))
    own = Window.partitionBy(key, "segment").orderBy("_at", "_part")
    return rows.withColumns({"idx": (F.row_number().over(own) - 1).cast("long"), "start": F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")}).drop("turn")


def next_cuts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, next): the piece after a chunk that starts at idx, null if there is none; rows (keys, idx, start, n, room), all of a segment with the same room.

    It is the last boundary within `room` of the start.  Boundaries and limits are
    put in one order, so the last boundary before a limit is the one sought: a
    binary search for all pieces at once.
    """
    boundary = rows.select(*keys, (F.col("start") + F.col("n")).alias("at"), F.lit(0).alias("asks"), (F.col("idx") + 1).alias("to"), F.lit(None).cast("long").alias("idx"))
    limit = rows.select(*keys, (F.col("start") + F.col("room")).alias("at"), F.lit(1).alias("asks"), F.lit(None).cast("long").alias("to"), "idx")
    w = Window.partitionBy(*keys).orderBy("at", "asks", "to").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.max("to").over(Window.partitionBy(*keys))
    met = boundary.unionByName(limit).withColumns({"last": F.max("to").over(w), "size": size}).where("asks = 1")
    after = F.greatest(F.coalesce("last", F.lit(0)), F.col("idx") + 1)
    return met.select(*keys, "idx", F.when(after < F.col("size"), after).alias("next"))


def chunk_starts(jumps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx): the pieces at which chunks start, from the first on; jumps (keys, idx, next).

    A round doubles the length of the jumps and adds what they reach from the
    starts known so far, so the rounds are the binary digits of the most chunks in
    a segment; jumps past the end are dropped.
    """
    same = lambda c: [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(c) == F.col("_i")]
    found = cut(jumps.where("idx = 0").select(*keys, "idx"))
    now = cut(jumps.where("next is not null"))
    while True:
        ahead = now.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("idx").alias("_i"), F.col("next").alias("_n"))
        reached = cut(found.join(ahead, same("idx")).select(*keys, F.col("_n").alias("idx")))
        if reached.isEmpty():
            return found
        found = found.unionByName(reached)
        now = cut(now.join(ahead, same("next")).select(*keys, "idx", F.col("_n").alias("next")))


def chunk(items: DataFrame, budget: int = BUDGET, key: str = "document_id", order: str = "pos") -> DataFrame:
    """(document_id, pos, raw_text, headings, labels, pages, n_tokens): items (document_id, pos, text, headings, labels, page) as chunks.

    Whole documents, in order.  Peers are packed until the next one would go over
    the budget, their headings counted in; joined by line ends.  A text that goes
    over it alone is cut between tokens, and its last part is a peer of what
    follows.  No chunk has more tokens than the budget unless the headings alone
    leave no room: then each token is a chunk.  A text of none is left out; null
    headings are none.  labels and pages are those of the pieces, in order and
    once.
    """
    plain = items.withColumn("headings", F.coalesce("headings", F.array().cast("array<string>")))
    keys = [key, "segment"]
    rows = cut(_segments(_pieces(plain, budget, key, order), key))
    starts = chunk_starts(next_cuts(rows, keys), keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("idx").alias("_i"))
    met = rows.join(starts, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("idx") == F.col("_i")], "left")
    w = Window.partitionBy(key).orderBy("segment", "idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumn("number", F.count("_i").over(w) - 1)
    held = F.array_sort(F.collect_list(F.struct("segment", "idx", "text", "labels", "page")))
    made = met.groupBy(key, "number").agg(held.alias("x"), F.first("headings").alias("headings"), F.sum("n").alias("n"))
    once = lambda a: F.array_distinct(F.filter(a, lambda v: v.isNotNull()))
    return made.select(
        key, F.col("number").cast("int").alias("pos"), F.array_join(F.transform("x", lambda p: p["text"]), "\n").alias("raw_text"), "headings", once(F.flatten(F.transform("x", lambda p: F.coalesce(p["labels"], F.array().cast("array<string>"))))).alias("labels"),
        once(F.transform("x", lambda p: p["page"])).alias("pages"), (F.col("n") + tokens(F.array_join("headings", "\n"))).alias("n_tokens"),
    )
