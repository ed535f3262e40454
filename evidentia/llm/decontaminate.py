"""Benchmark decontamination by a prefix-filtered join of word shingles.

A window is a run of benchmark words; it occurs in a document exactly if its
shingles stand there one after the other.  So a window is looked for by its rarest
shingle alone (the prefix that containment of all needs), candidates must fit the
document by position and length, and the shingles that cover the window must then
stand at their places, word for word.  Everything is DataFrame expressions; the
texts are read once, and only occurrences of benchmark shingles move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import FEW, cut, stored, words

#: A word: digits, letters, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of shingles that are broadcast at most; beyond, or beyond FEW rows, Spark shuffles.
BROADCAST_BYTES = 64 << 20


def _key(parts: list[Column]) -> Column:
    """A hash of words, null if one of them is: only for finding, as equal hashes are compared word for word."""
    missing = parts[-1].isNull()  # words run from the left
    return F.when(~missing, F.xxhash64(*parts))


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(windows, members): windows (window, size, words) are different, members (window, item) say whose they are."""
    own = words(text_col, WORD)
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), own.alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    texts = F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.lit(window)), " "))
    each = stored(rows.select("item", F.explode(texts).alias("text")).distinct(), "item-windows")
    windows = stored(each.select("text").distinct().select(F.monotonically_increasing_id().alias("window"), "text"), "windows")
    members = each.join(windows.withColumnRenamed("text", "t"), F.col("text") == F.col("t")).select("window", "item")
    split = F.split("text", " ")
    return windows.select("window", F.size(split).alias("size"), split.alias("words")), members


def shingles_of(windows: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(shingles, places): shingles (shingle, length, text) are different, places (window, size, offset, shingle, length) have each of a window's.

    A window of fewer words than `shingle` is one shingle.
    """
    length = F.least("size", F.lit(shingle))
    runs = F.transform(F.sequence(F.lit(0), F.col("size") - F.col("length")), lambda i: F.array_join(F.slice("words", i + 1, F.col("length")), " "))
    each = windows.withColumn("length", length).select("window", "size", "length", F.posexplode(runs).alias("offset", "text"))
    made = stored(each.select("length", "text").distinct().select(F.monotonically_increasing_id().alias("shingle"), "length", "text"), "shingles")
    places = each.join(made.select("shingle", F.col("text").alias("t")), F.col("text") == F.col("t")).select("window", "size", "offset", "shingle", "length")
    return made, stored(places, "places")


def occurrences(docs: DataFrame, shingles: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, n_words, pos, shingle, first): a row for each place where a document has one of the shingles.

    Each document has one row with `first` besides or among them; doc numbers rows
    of docs, so that repeated ids are apart.
    """
    told = shingles.groupBy("length").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # one row a length
    lengths = sorted(r["length"] for r in told)
    most = max(lengths, default=1)
    own = words(text_col, WORD)
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id_col).alias("id"), own.alias("w"))
    ahead = F.arrays_zip(*(F.slice("w", i + 1, F.greatest(F.size("w"), F.lit(1))).alias(f"w{i}") for i in range(most)))
    run = rows.select("doc", "id", F.size("w").alias("n_words"), F.posexplode_outer(ahead).alias("pos", "x"))
    run = run.select("doc", "id", "n_words", "pos", *(F.col(f"x.w{i}").alias(f"w{i}") for i in range(most)))
    w = [F.col(f"w{i}") for i in range(most)]
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    if not lengths:
        return run.where(first).select("doc", "id", "n_words", "pos", F.lit(None).cast("long").alias("shingle"), F.lit(True).alias("first"))
    if len(lengths) == 1:
        keyed = run.select("*", F.lit(most).alias("length"), first.alias("first"), _key(w).alias("key"))
    else:
        keys = F.array(*(F.struct(F.lit(k).alias("length"), (first & F.lit(k == most)).alias("first"), _key(w[:k]).alias("key")) for k in lengths))
        keyed = run.select("*", F.inline(keys)).where("key is not null or first")
    parts = F.split("text", " ")
    table = shingles.select("shingle", F.col("length").alias("l"), "text", F.coalesce(*(F.when(F.col("length") == k, F.xxhash64(*(F.get(parts, F.lit(i)) for i in range(k)))) for k in lengths)).alias("k"))
    small = sum(r["n"] for r in told) <= FEW and sum(r["bytes"] for r in told) <= BROADCAST_BYTES
    same = (F.col("key") == F.col("k")) & (F.col("length") == F.col("l"))
    for k in lengths:
        same &= (F.col("length") != k) | (F.concat_ws(" ", *w[:k]) == F.col("text"))
    met = keyed.join(F.broadcast(table) if small else table, same, "left")
    return met.where("shingle is not null or first").select("doc", "id", "n_words", "pos", "shingle", "first")


def contained(found: DataFrame, places: DataFrame, shingle: int) -> DataFrame:
    """(doc, window, start, size): where windows stand in documents; found as from occurrences()."""
    hits = found.where("shingle is not null").select("doc", "n_words", "pos", "shingle")
    counts = cut(hits.groupBy("shingle").agg(F.count("*").alias("n")).withColumnRenamed("shingle", "s"))
    rare = places.join(counts, F.col("shingle") == F.col("s"), "left").groupBy("window", "size", "length").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("least"))
    prefix = cut(rare.where("least.n > 0").select("window", "size", "length", F.col("least.shingle").alias("s"), F.col("least.offset").alias("offset")))
    near = hits.join(prefix, F.col("shingle") == F.col("s")).withColumn("start", F.col("pos") - F.col("offset"))
    near = near.where((F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n_words"))).select("doc", "window", "start", "size", "length")
    # the shingles that cover a window: every `shingle` words, and the last
    cover = F.array_union(F.sequence(F.lit(0), F.col("size") - F.col("length"), F.lit(shingle)), F.array(F.col("size") - F.col("length")))
    asked = near.select("*", F.size(cover).alias("wanted"), F.explode(cover).alias("offset"))
    at = places.select(F.col("window").alias("v"), F.col("offset").alias("o"), F.col("shingle").alias("s"))
    asked = cut(asked.join(at, (F.col("window") == F.col("v")) & (F.col("offset") == F.col("o"))).select("doc", "window", "start", "size", "wanted", (F.col("start") + F.col("offset")).alias("p"), "s"))
    there = hits.select(F.col("doc").alias("d"), F.col("pos").alias("q"), F.col("shingle").alias("h"))
    stand = asked.join(there, (F.col("doc") == F.col("d")) & (F.col("p") == F.col("q")) & (F.col("s") == F.col("h")))
    return stand.groupBy("doc", "window", "start", "size", "wanted").agg(F.count("*").alias("n")).where("n = wanted").select("doc", "window", "start", "size")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) per row of docs.

    A window is a run of `window` words of an item; an item of fewer words, but not
    none, is one window.  n_hit counts the words of a document that lie in a place
    where a window occurs, items has the ids of items with such windows as strings
    in order.  Null texts have no words; repeated rows and ids are rows of their
    own.  Rows of items with equal ids are one item, and one without an id has the
    empty string for it.  A text's words are held in memory, with about 200 bytes
    each.  Other columns are ignored.
    """
    assert 0 < shingle <= window
    windows, members = windows_of(items, item_col, item_text, window)
    shingles, places = shingles_of(windows, shingle)
    found = stored(occurrences(docs, shingles, id_col, text_col), "shingle-places")
    stand = cut(contained(found, places, shingle))
    covered = F.flatten(F.transform(F.collect_set(F.struct("start", "size")), lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1)))
    hit = stand.groupBy("doc").agg(F.size(F.array_distinct(covered)).cast("long").alias("n_hit"))
    whose = cut(stand.select("doc", "window").distinct()).join(members.withColumnRenamed("window", "v"), F.col("window") == F.col("v"))
    named = whose.groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    told = hit.join(named, "doc").select(F.col("doc").alias("d"), "n_hit", "items")
    out = found.where("first").select("doc", "id", "n_words").join(told, F.col("doc") == F.col("d"), "left")
    n_hit, held = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(held).cast("long").alias("n_items"), held.alias("items"), (n_hit > 0).alias("contaminated"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """decontaminate()'s rows with the SHA-256 of the comma-joined items in their place."""
    return found.select(id_col, "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
