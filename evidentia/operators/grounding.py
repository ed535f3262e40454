"""Which needles (phrases) are contained in which texts.

Long needles are found by three whole words inside them.  Short ones, and those
that may be glued together or scattered, go through an inverted index of the
character runs of needles: each needle is looked up by the run of its own that is
rarest in the texts, and only what that finds is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions import predicates as P
from evidentia.plans.lineage import cut

#: Needles of fewer words than this have no whole words inside, and are looked up by runs of characters.
LEAST_WORDS = 5
#: Most long needles that go to every task, and the bytes in them; more are joined by shuffling.
MOST_NEEDLES, MOST_BYTES = 10_000, 32 << 20
#: Longest runs of characters in the index, and most runs that go to every task (about 50 MB as a hash table).
RUN, MOST_RUNS = 6, 300_000
#: The two forms of a text: as it is, and only its a-z0-9.
PLAIN, GLUED = 0, 1


def contained(texts: DataFrame, needles: DataFrame, most: int = MOST_NEEDLES) -> DataFrame:
    """(text_id, needle_id): needles (needle_id, needle) inside texts (text_id, hay); both are match keys.

    Inside a needle only its first and last word can be parts of words of the
    text, so its second to fourth word must stand in the text as they are: an
    equi-join on their hash finds the candidates.  Up to `most` needles of
    MOST_BYTES go to the tasks, and a text is checked where it is; more are joined
    by their ids first.  Needles of fewer words go through the index of runs.
    """
    needles = cut(needles.where("needle <> ''").select("needle_id", "needle", F.split("needle", " ").alias("w")))
    told = needles.agg(F.count_if(F.size("w") >= LEAST_WORDS).alias("long"), F.count_if(F.size("w") < LEAST_WORDS).alias("short"), F.sum(F.octet_length("needle")).alias("bytes")).first()
    found = None
    if told["long"] or not told["short"]:
        found = _by_words(texts, needles.where(F.size("w") >= LEAST_WORDS).select("needle_id", "needle", F.xxhash64(*(F.get("w", F.lit(i)) for i in (1, 2, 3))).alias("h")), told["long"] <= most and (told["bytes"] or 0) <= MOST_BYTES)
    if told["short"]:
        short = _by_runs(texts, needles.where(F.size("w") < LEAST_WORDS).select("needle_id", "needle"), tiers=False)
        found = short if found is None else found.unionByName(short)
    return found


def _by_words(texts: DataFrame, needles: DataFrame, few: bool) -> DataFrame:
    w, far = F.split("hay", " "), F.lit(1 << 30)
    run = F.inline(F.arrays_zip(w.alias("a"), F.slice(w, 2, far).alias("b"), F.slice(w, 3, far).alias("c")))
    if few:
        each = texts.select("text_id", "hay", run).where("c is not null").withColumn("h", F.xxhash64("a", "b", "c"))
        met = each.join(F.broadcast(needles), "h")
    else:
        each = texts.select("text_id", run).where("c is not null").select("text_id", F.xxhash64("a", "b", "c").alias("h")).distinct()
        pairs = each.join(needles.select("h", "needle_id"), "h").select("text_id", "needle_id").distinct()
        met = pairs.join(needles.select("needle_id", "needle").distinct(), "needle_id").join(texts, "text_id")
    return met.where(F.col("hay").contains(F.col("needle"))).select("text_id", "needle_id").distinct()


def contained_tiers(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """Like contained(), by all three tiers of P.contains_key."""
    return _by_runs(texts, needles.where("needle <> ''").select("needle_id", "needle"), tiers=True)


def _glue(x: Column) -> Column:
    return F.regexp_replace(x, "[^a-z0-9]", "")


def _runs(x: Column, size: int) -> Column:
    """All different runs of `size` characters in x."""
    return F.array_distinct(F.regexp_extract_all(x, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _looked_up(needles: DataFrame, tiers: bool) -> DataFrame:
    """(needle_id, way, form, run): the runs that a text must all have, in a form, if it holds the needle in one of two ways.

    Way 0 is the needle in one piece: glued, if anything is left of it then (a text
    that holds it as it is holds it glued too), else as it is.  Way 1 is its words
    of over two characters, if they are two or more, each anywhere.
    """
    piece = F.struct(F.lit(0).alias("way"), F.lit(PLAIN).alias("form"), F.col("needle").alias("s"))
    parts = F.array(piece)
    if tiers:
        glued = _glue(F.col("needle"))
        words = F.filter(F.split("needle", " "), lambda w: F.length(w) > 2)
        piece = F.when(glued != "", F.struct(F.lit(0).alias("way"), F.lit(GLUED).alias("form"), glued.alias("s"))).otherwise(piece)
        apart = F.transform(words, lambda w: F.struct(F.lit(1).alias("way"), F.lit(PLAIN).alias("form"), w.alias("s")))
        parts = F.concat(F.array(piece), F.when(F.size(words) >= 2, apart).otherwise(F.slice(apart, 1, 0)))
    each = needles.select("needle_id", F.inline(parts)).withColumn("size", F.least(F.length("s"), F.lit(RUN)))
    run = F.coalesce(*(F.when(F.col("size") == k, _runs(F.col("s"), k)) for k in range(1, RUN + 1)))
    return each.select("needle_id", "way", "form", F.explode(run).alias("run")).distinct()


def _by_runs(texts: DataFrame, needles: DataFrame, tiers: bool) -> DataFrame:
    needles = cut(needles.distinct())
    wanted = cut(_looked_up(needles, tiers))
    runs = cut(wanted.select("form", "run").distinct())
    told = runs.groupBy("form", F.length("run").alias("size")).agg(F.count("*").alias("n")).collect()  # 2 * RUN rows at most
    if not told:
        return texts.sparkSession.createDataFrame([], T.StructType([texts.schema["text_id"], needles.schema["needle_id"]]))
    of = lambda form: _glue(F.col("hay")) if form == GLUED else F.col("hay")
    own = F.array(*(F.struct(F.lit(r["form"]).alias("form"), _runs(of(r["form"]), r["size"]).alias("runs")) for r in sorted(told)))
    there = texts.select("text_id", F.inline(own)).select("text_id", "form", F.explode("runs").alias("run"))
    # of the runs of texts only those that a needle has are kept
    hits = cut(there.join(F.broadcast(runs) if sum(r["n"] for r in told) <= MOST_RUNS else runs, ["form", "run"]))
    counts = hits.groupBy("form", "run").agg(F.count("*").alias("n"))
    least = wanted.join(counts, ["form", "run"], "left").groupBy("needle_id", "way").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "form", "run")).alias("x"))
    key = cut(least.where("x.n > 0").select("needle_id", F.col("x.form").alias("form"), F.col("x.run").alias("run")).distinct())
    pairs = cut(hits.join(key, ["form", "run"]).select("text_id", "needle_id").distinct())
    met = pairs.join(needles, "needle_id").join(texts, "text_id")
    holds = P.contains_key(F.col("hay"), F.col("needle")) if tiers else F.col("hay").contains(F.col("needle"))
    return met.where(holds).select("text_id", "needle_id").distinct()


def below(clauses: DataFrame, required: DataFrame) -> DataFrame:
    """(clause, required): a clause and those required ones that it is, or lies below; an equi-join on its prefixes."""
    parts = F.split("clause", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return clauses.where("clause <> ''").select("clause", F.explode(prefixes).alias("required")).join(required, "required", "left_semi")
