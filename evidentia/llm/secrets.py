"""Secret scans over a ledger of blobs.

Every version of every document is content-addressed.  The ledger says which
(blob, rule version) pairs were scanned and what was found; only unseen pairs are
scanned, each text once, and findings are joined back to all rows that hold the
blob.  Everything is DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from evidentia.llm.common import cut, stored


class Rule(NamedTuple):
    """A pattern of which group `group` must have `least` characters; others match, and are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


#: The base rules.
BASE = (
    Rule("assign", f"({_either_case('password')}|{_either_case('passwd')}|{_either_case('secret')}|{_either_case('token')}|{_either_case('api')}_?{_either_case('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
_KEY = "[A-Z ]{0,24}PRIVATE KEY(?: BLOCK)?-----"
_HEADERS = "(?:[A-Za-z][A-Za-z-]{1,30}:[^\\r\\n]*\\r?\\n){0,9}"
#: Further kinds; they add spans.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    # group 1 is what follows the first part; a run without it matches too, so that none is searched twice
    Rule("jwt", "eyJ[A-Za-z0-9_-]{8,}((?:\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,})?)", 1, 1, version=2),
    # to the END line, which stands before any other dash but those of header lines; without one, to the last long line of base64.
    # No group is repeated over lines and none looks beyond the next BEGIN, so the time is in proportion to the text.
    Rule("private_key", f"-----BEGIN {_KEY}(?:(?:\\r?\\n{_HEADERS})?[A-Za-z0-9+/=:,.\\\\\\x20\\r\\n\\t]*-----END {_KEY}|\\r?\\n{_HEADERS}[A-Za-z0-9+/=\\r\\n]*[A-Za-z0-9+/=]{{16,}})?", version=2),
)
RULES = BASE + MORE
#: Spans of a text that are cut out in one go.
TOGETHER = 256
#: Patterns that match exactly the passing matches of a rule, where one exists; scanning them is faster.
_PASSING = {"[0-9a-f]+": "[0-9a-f]{24,}", "AKIA[A-Z0-9]+": "AKIA[A-Z0-9]{16,}"}
FINDINGS = T.StructType([T.StructField("blob", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


class Ledger(NamedTuple):
    """scanned (blob, rule) and findings (blob, rule, start, end); a rule is kind:version."""

    scanned: DataFrame
    findings: DataFrame


def blob_of(text: str | Column) -> Column:
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def _matches(rule: Rule, text: Column) -> Column:
    """Per match: the characters before it since the last one, its own, and those of the rule's group."""
    pattern = _PASSING.get(rule.pattern, rule.pattern)
    all_of = lambda g: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), lambda x: F.length(x))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = all_of(0)
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("size"), (all_of(rule.group) if rule.group else whole).alias("key"))
    return F.when(text.rlike(pattern), F.filter(parts, lambda x: x["size"].isNotNull()))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of (blob, text, done); rules whose key is in the array `done` are left out."""
    text = F.col("text")
    each = F.array(*[F.struct(F.lit(r.key).alias("rule"), F.lit(r.least).alias("least"), F.when(~F.array_contains("done", r.key), _matches(r, text)).alias("parts")) for r in rules])
    rows = blobs.select("blob", F.inline(F.filter(each, lambda x: x["parts"].isNotNull()))).select("blob", "rule", "least", F.posexplode("parts").alias("i", "p"))
    order = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("p.gap") + F.col("p.size")).over(order)
    found = rows.select("blob", "rule", "least", "p", end.cast("long").alias("end"))
    return found.where("p.key >= least").select("blob", "rule", (F.col("end") - F.col("p.size")).alias("start"), "end").distinct()


def update(docs: DataFrame, ledger: Ledger | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, Ledger]:
    """(rows, ledger): rows has (id, blob) per row of docs; the ledger now covers all their blobs.

    Null texts are empty ones.  Of each unseen blob the row with the smallest id
    is scanned; equal texts under equal ids are scanned once more at most.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), blob_of(text_col).alias("blob")))
    first = rows.groupBy("blob").agg(F.min("id").alias("least"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is not None:
        seen = ledger.scanned.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        first = first.join(seen, "blob", "left").select("blob", "least", F.coalesce("seen", F.array().cast("array<string>")).alias("done"))
        first = first.where(F.size(F.array_except(keys, "done")) > 0)
    else:
        first = first.withColumn("done", F.array().cast("array<string>"))
    first = cut(first)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("b", blob_of("text"))
    unseen = texts.join(first, (F.col("b") == F.col("blob")) & F.col("id").eqNullSafe(F.col("least"))).select("blob", "text", "done")
    findings = stored(scan(unseen, rules), "findings")
    scanned = first.select("blob", F.explode(F.array_except(keys, "done")).alias("rule"))
    if ledger is not None:
        scanned, findings = ledger.scanned.unionByName(scanned), ledger.findings.unionByName(findings)
    return rows, Ledger(scanned, findings)


def by_blob(findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans): spans (start, kind_no, kind, end) by start, then kind as listed."""
    number = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.struct(F.lit(i).alias("no"), F.lit(r.kind).alias("kind")))])
    named = findings.withColumn("k", number[F.col("rule")]).where("k is not null")
    return named.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", F.col("k.no").alias("kind_no"), F.col("k.kind").alias("kind"), "end"))).alias("spans"))


def scan_documents(docs: DataFrame, ledger: Ledger | None = None, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, blob, spans) per row of docs; spans is empty where nothing was found.

    Matches are leftmost and non-overlapping per kind, in code points, ends
    exclusive.  Null ids and repeated rows are kept; other columns are ignored.
    """
    rows, after = update(docs, ledger, id_col, text_col, rules)
    found = cut(by_blob(after.findings, rules)).withColumnRenamed("blob", "b")
    out = rows.join(found, F.col("blob") == F.col("b"), "left")
    return out.select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.expr("array()").cast(found.schema["spans"].dataType)).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): spans as kind:start:end, comma-joined."""
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind_no"] < len(BASE))
    return found.select(id_col, *(count(r.kind).alias(f"n_{r.kind}") for r in BASE), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def cuts(findings: DataFrame) -> DataFrame:
    """(blob, cuts): the spans of any kind (start, end, before) in order, those that touch or overlap as one; before is the end of the one before, or 0."""
    order = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = findings.withColumn("opens", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("part", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    each = rows.groupBy("blob", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    each = each.withColumn("before", F.lag("end", 1, 0).over(Window.partitionBy("blob").orderBy("start")))
    return each.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "end", "before"))).alias("cuts"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every found span of text_col replaced by `mask`; touching and overlapping spans get one.

    A null text stays null; rows without findings stay as they are.
    """
    _, after = update(docs, None, id_col, text_col, rules)
    found = cut(cuts(after.findings))
    text = F.col("row")[text_col]
    between = lambda t, start, end: F.substring(t, (start + 1).cast("int"), (end - start).cast("int"))
    # substring() counts characters from the start, so a text of many spans is cut into parts of some spans first
    first = lambda g: F.get("cuts", g)["before"]
    part = lambda g: between(text, first(g), F.get("cuts", F.least(g + TOGETHER, F.size("cuts")) - 1)["end"])
    pieces = lambda g: F.transform(F.array(part(g)), lambda p: F.transform(F.slice("cuts", g + 1, F.lit(TOGETHER)), lambda x: between(p, x["before"] - first(g), x["start"] - first(g))))[0]
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts") - 1, F.lit(TOGETHER)), pieces))
    last = F.substring(text, (F.element_at("cuts", -1)["end"] + 1).cast("int"), F.length(text))
    done = F.array_join(F.concat(kept, F.array(last)), mask)
    # the columns travel as one, so that none can clash
    joined = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), blob_of(text_col).alias("own")).join(found, F.col("own") == F.col("blob"), "left")
    return joined.select(*(F.when(F.col("cuts").isNull(), text).otherwise(done).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def save(ledger: Ledger, path: str) -> None:
    """Write the ledger as two tables under path, which must not hold one yet."""
    ledger.scanned.write.parquet(f"{path}/scanned")
    ledger.findings.write.parquet(f"{path}/findings")


def load(spark: SparkSession, path: str) -> Ledger:
    """The ledger that save() wrote."""
    return Ledger(spark.read.schema("blob string, rule string").parquet(f"{path}/scanned"), spark.read.schema(FINDINGS).parquet(f"{path}/findings"))
