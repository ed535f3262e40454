"""Queries of the engine by name over the driver's tables, and their SQL twins.

The tables hold no specifications, so each operator runs on an analogue: events of
a user stand for the items of a document, parts for products, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions import predicates as P
from evidentia.functions import text as X
from evidentia.operators import chunks, evidence, export, grounding, index, packaging, regions, sections, vector
from evidentia.plans.lineage import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# How both sides normalise a text that is in NFKC already: dashes, quotes, white space.
_FROM, _TO = X.DASHES + X.SINGLE_QUOTES + X.DOUBLE_QUOTES, "-" * len(X.DASHES) + "'" * len(X.SINGLE_QUOTES) + '"' * len(X.DOUBLE_QUOTES)
_SQL_NORMAL = r"trim(regexp_replace(translate({x}, '" + _FROM + "', '" + _TO.replace("'", "''") + r"'), '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ' ', 'g'))"
_SQL_KEY = r"trim(regexp_replace(regexp_replace(replace(lower(" + _SQL_NORMAL + r"), '-', ' '), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query(f"""
WITH l AS (SELECT doc_id, pos, {_SQL_NORMAL.format(x='line')} AS n FROM ({_LINES})),
h AS (SELECT doc_id, pos, pos // 40 + 1 AS page_number, length(n) AS n_chars, sha256(n) AS text_hash FROM l WHERE n <> '')
SELECT doc_id, pos::INT AS pos, page_number::BIGINT AS page_number, n_chars::INT AS n_chars, text_hash,
  'ev_' || substr(sha256(doc_id::VARCHAR || chr(0) || page_number::VARCHAR || chr(0) || text_hash), 1, 16) AS evidence_id FROM h""")
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as evidence with content ids."""
    rows = _lines(spark, sf_dir).where(X.has_text("line")).withColumn("n", X.normalize("line"))
    rows = rows.select("doc_id", "pos", F.floor(F.col("pos") / 40 + 1).alias("page_number"), F.length("n").alias("n_chars"), F.sha2("n", 256).alias("text_hash"))
    return rows.withColumn("evidence_id", evidence.evidence_id(F.col("doc_id").cast("string"), F.lit(None).cast("string"), F.col("page_number"), F.col("text_hash")))


@query(f"""
WITH l AS (SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS rn FROM ({_LINES}) WHERE trim(line) <> '')
SELECT doc_id, count(*) FILTER (rn = 1) AS n_first, count(*) FILTER (rn > 1) AS n_later, sum(CASE WHEN rn = 1 THEN pos ELSE 0 END)::BIGINT AS first_pos_sum FROM l GROUP BY doc_id""")
def evidence_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal lines of a document, and how many follow."""
    rows = _lines(spark, sf_dir).where(F.trim("line") != "")
    return evidence.first_of(rows, ["doc_id", "line"], ["pos"]).groupBy("doc_id").agg(F.count_if("first").alias("n_first"), F.count_if(~F.col("first")).alias("n_later"), F.sum(F.when(F.col("first"), F.col("pos")).otherwise(0)).alias("first_pos_sum"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of users, numbered in order."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return rows.withColumn("idx", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)


_EVENTS = "SELECT event_id, user_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events"


@query(f"""
WITH e AS ({_EVENTS}),
a AS (SELECT *, CASE WHEN event_type = 'signup' THEN event_id::VARCHAR END AS a, CASE WHEN event_type = 'view' THEN event_id::VARCHAR END AS l,
  CASE WHEN event_type = 'click' THEN event_id::VARCHAR END AS n, CASE WHEN event_type = 'purchase' THEN event_id::VARCHAR END AS s FROM e),
b AS (SELECT *, last_value(a IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx) AS av, count(a) OVER (PARTITION BY user_id ORDER BY idx) AS ag FROM a),
c AS (SELECT *, last_value(CASE WHEN av IS NOT NULL THEN l END IGNORE NULLS) OVER (PARTITION BY user_id, ag ORDER BY idx) AS lv, count(CASE WHEN av IS NOT NULL THEN l END) OVER (PARTITION BY user_id, ag ORDER BY idx) AS lg FROM b),
d AS (SELECT *, last_value(CASE WHEN lv IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY user_id, ag, lg ORDER BY idx) AS nv, count(CASE WHEN lv IS NOT NULL THEN n END) OVER (PARTITION BY user_id, ag, lg ORDER BY idx) AS ng FROM c),
f AS (SELECT *, last_value(CASE WHEN nv IS NOT NULL THEN s END IGNORE NULLS) OVER (PARTITION BY user_id, ag, lg, ng ORDER BY idx) AS sv FROM d)
SELECT event_id, user_id, CASE WHEN av IS NOT NULL THEN concat_ws('.', av, lv, nv, sv) END AS clause FROM f""")
def clause_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause numbers built from four levels of markers."""
    of = lambda kind: F.when(F.col("event_type") == kind, F.col("event_id").cast("string"))
    rows = evidence.clause_cascade(_events(spark, sf_dir), "user_id", "idx", of("signup"), of("view"), of("click"), of("purchase"))
    return rows.select("event_id", "user_id", "clause")


@query(f"""
WITH RECURSIVE h AS (SELECT user_id, idx, CASE event_type WHEN 'signup' THEN 20 WHEN 'view' THEN 10 WHEN 'click' THEN 30 ELSE 40 END AS rank, event_type || ' ' || event_id % 7 AS t, row_number() OVER (PARTITION BY user_id ORDER BY idx) AS n
  FROM ({_EVENTS}) WHERE event_type <> 'error'),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS n, -1::BIGINT AS idx, []::STRUCT(r INT, t VARCHAR)[] AS p FROM h UNION ALL
  SELECT f.user_id, h.n, h.idx, CASE WHEN h.rank <= 15 AND len(list_filter(p, lambda e: e.r >= 30 OR e.t = h.t)) > 0 THEN p ELSE list_append(list_filter(p, lambda e: e.r < h.rank), {{'r': h.rank, 't': h.t}}) END
  FROM f JOIN h ON h.user_id = f.user_id AND h.n = f.n + 1)
SELECT user_id, idx::INT AS idx, array_to_string(list_transform(p, lambda e: e.t), ' > ') AS path FROM f WHERE n > 0""")
def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading paths; the twin runs through the rows of each user one by one."""
    rank = F.create_map(*[F.lit(x) for x in ("signup", 20, "view", 10, "click", 30, "purchase", 40)])
    text = F.concat_ws(" ", "event_type", F.pmod("event_id", F.lit(7)))
    heads = _events(spark, sf_dir).where("event_type <> 'error'").select("user_id", "idx", rank[F.col("event_type")].alias("rank"), text.alias("t"))
    return evidence.heading_paths(heads, "user_id", "idx").select("user_id", "idx", F.array_join("path", " > ").alias("path"))


@query(f"""
WITH e AS ({_EVENTS}), w AS (SELECT *, min(CASE WHEN event_type = 'click' THEN idx END) OVER a AS body, min(CASE WHEN event_type = 'signup' THEN idx END) OVER a AS stop FROM e
  WINDOW a AS (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 49 FOLLOWING))
SELECT event_id, user_id, coalesce(body < coalesce(stop, 1000000000), FALSE) AS confirmed FROM w WHERE event_type = 'signup'""")
def lookahead_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a body follows a heading within 49 rows, before the next heading."""
    kind = F.col("event_type")
    seen = sections.look_ahead(kind == "click", kind == "signup", Window.partitionBy("user_id").orderBy("idx"))
    return _events(spark, sf_dir).withColumn("confirmed", seen).where(kind == "signup").select("event_id", "user_id", "confirmed")


_SPANS = """SELECT o_custkey, o_orderkey, date_diff('day', DATE '1990-01-01', min(l_shipdate)::DATE) AS start_index, date_diff('day', DATE '1990-01-01', max(l_shipdate)::DATE) AS end_index, count(*) AS priority
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"""


def _order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as spans of days, from the first shipment to the last."""
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("long")
    spans = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(day).alias("start_index"), F.max(day).alias("end_index"), F.count("*").alias("priority"))
    return spans.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "o_orderkey", "start_index", "end_index", "priority")


@query(f"""
WITH s AS ({_SPANS})
SELECT a.o_custkey, a.o_orderkey AS "outer", b.o_orderkey AS "inner", a.start_index <= b.start_index AND a.end_index >= b.end_index AS contains
FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND a.start_index <= b.end_index AND b.start_index <= a.end_index""")
def region_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a key that overlap, and which of them contain the other."""
    return regions.overlaps(_order_spans(spark, sf_dir), "o_custkey", "o_orderkey")


@query(f"""
WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY priority DESC, start_index, end_index DESC, o_orderkey) AS n FROM ({_SPANS})),
p AS (SELECT DISTINCT o_custkey, 0::BIGINT AS n, []::STRUCT(k BIGINT, a BIGINT, z BIGINT, p BIGINT)[] AS held FROM s UNION ALL
  SELECT p.o_custkey, s.n, CASE WHEN len(list_filter(held, lambda h: h.a <= s.start_index AND h.z >= s.end_index)) > 0 THEN held
    ELSE list_append(list_filter(held, lambda h: NOT (s.start_index <= h.a AND s.end_index >= h.z)), {{'k': s.o_orderkey, 'a': s.start_index, 'z': s.end_index, 'p': s.priority}}) END
  FROM p JOIN s ON s.o_custkey = p.o_custkey AND s.n = p.n + 1),
h AS (SELECT o_custkey, unnest(arg_max(held, n)) AS x FROM p GROUP BY o_custkey),
o AS (SELECT o_custkey, x, row_number() OVER (PARTITION BY o_custkey ORDER BY x.a) AS n FROM h),
c AS (SELECT o_custkey, n, x, x.z AS far, TRUE AS kept FROM o WHERE n = 1 UNION ALL
  SELECT c.o_custkey, o.n, o.x, greatest(far, CASE WHEN o.x.a > far THEN o.x.z ELSE far END), o.x.a > far FROM c JOIN o ON o.o_custkey = c.o_custkey AND o.n = c.n + 1)
SELECT o_custkey, x.a AS start_index, x.z AS end_index, x.p AS priority FROM c WHERE kept""")
def region_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy choice of spans that do not overlap; the twin takes them one by one in order of priority."""
    return regions.greedy_spans(_order_spans(spark, sf_dir), "o_custkey").select("o_custkey", "start_index", "end_index", "priority")


@query(f"""
WITH d AS (SELECT doc_id, {_SQL_KEY.format(x='text')} AS h FROM documents), b AS (SELECT item_id, {_SQL_KEY.format(x='text')} AS n FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON n <> '' AND contains(h, n)""")
def grounding_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages that documents contain, as match keys."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), X.match_key("text").alias("hay"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("needle_id"), X.match_key("text").alias("needle"))
    return grounding.contained(docs, items).select(F.col("text_id").alias("doc_id"), F.col("needle_id").alias("item_id")).distinct()


_PARTS = f"SELECT DISTINCT {_SQL_KEY.format(x='p_name')} AS n FROM part"


def _part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(X.match_key("p_name", unicode=False).alias("needle")).distinct().select("needle", F.col("needle").alias("needle_id"))


@query(f"""
WITH p AS ({_PARTS}), h AS (SELECT n AS hay_of, array_to_string(list_reverse(string_split(n, ' ')), ' ') AS h FROM p), t AS (SELECT n, list_filter(string_split(n, ' '), lambda w: length(w) > 2) AS ws FROM p)
SELECT h AS hay, n AS needle FROM h JOIN t ON contains(h, n) OR contains(regexp_replace(h, '[^a-z0-9]', '', 'g'), regexp_replace(n, '[^a-z0-9]', '', 'g')) OR (len(ws) >= 2 AND len(list_filter(ws, lambda w: NOT contains(h, w))) = 0)""")
def grounding_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment word by word: names with their words turned round."""
    needles = _part_names(spark, sf_dir)
    texts = needles.select(F.array_join(F.reverse(F.split("needle", " ")), " ").alias("hay")).withColumn("text_id", F.col("hay"))
    return grounding.contained_tiers(texts, needles).select(F.col("text_id").alias("hay"), F.col("needle_id").alias("needle"))


@query(f"""
WITH p AS ({_PARTS}), h AS (SELECT replace(n, ' ', '') AS h FROM p)
SELECT h AS hay, n AS needle FROM (SELECT DISTINCT h FROM h) JOIN p ON contains(h, n) OR contains(regexp_replace(h, '[^a-z0-9]', '', 'g'), regexp_replace(n, '[^a-z0-9]', '', 'g'))
  OR (len(list_filter(string_split(n, ' '), lambda w: length(w) > 2)) >= 2 AND len(list_filter(list_filter(string_split(n, ' '), lambda w: length(w) > 2), lambda w: NOT contains(h, w))) = 0)""")
def grounding_glue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment without spaces: names run together."""
    needles = _part_names(spark, sf_dir)
    texts = needles.select(F.replace("needle", F.lit(" "), F.lit("")).alias("hay")).distinct().withColumn("text_id", F.col("hay"))
    return grounding.contained_tiers(texts, needles).select(F.col("text_id").alias("hay"), F.col("needle_id").alias("needle"))


@query("""
WITH c AS (SELECT DISTINCT p_brand || '.' || replace(p_type, ' ', '.') || '.' || p_size AS clause FROM part),
r AS (SELECT DISTINCT p_brand AS required FROM part UNION SELECT DISTINCT p_brand || '.' || split_part(p_type, ' ', 1) FROM part)
SELECT required, count(*) AS n_clauses FROM c JOIN r ON clause = required OR starts_with(clause, required || '.') GROUP BY required""")
def clause_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses under required ones."""
    part = table(spark, sf_dir, "part")
    clauses = part.select(F.concat_ws(".", "p_brand", F.replace("p_type", F.lit(" "), F.lit(".")), "p_size").alias("clause")).distinct()
    required = part.select(F.col("p_brand").alias("required")).union(part.select(F.concat_ws(".", "p_brand", F.split_part("p_type", F.lit(" "), F.lit(1))))).distinct()
    return grounding.below(clauses, required).groupBy("required").agg(F.count("*").alias("n_clauses"))


_NEAREST = """
WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), v AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM u),
d AS (SELECT q.vec_id AS query_id, b.vec_id, list_distance(q.e, b.e) ** 2 AS distance FROM v q, v b WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(distance, 6) AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id)::INT AS rank FROM d) WHERE rank <= 8"""


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v)
SELECT vec_id, len(e)::INT AS size, round(e[1], 6) AS first, round(e[-1], 6) AS last, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS square, round(list_sum(e), 6) AS total FROM u""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors scaled to length 1."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", X.l2_normalize("embedding").alias("e"))
    total = lambda f: F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + f(x)), 6)
    return rows.select("vec_id", F.size("e").alias("size"), F.round(F.get("e", F.lit(0)), 6).alias("first"), F.round(F.element_at("e", -1), 6).alias("last"), total(lambda x: x * x).alias("square"), total(lambda x: x).alias("total"))


@query(_NEAREST)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest vectors of every fiftieth one."""
    base = table(spark, sf_dir, "embeddings")
    queries = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    hits = vector.top_k(base, queries, 8, "vec_id")
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@query(_NEAREST)
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index of inverted lists that gets its vectors in two batches."""
    base = table(spark, sf_dir, "embeddings")
    queries = base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    made = index.create(base, scratch(spark, "vector-index"), "vec_id")
    for part in (0, 1):
        index.add(made, base.where(F.pmod(F.xxhash64("vec_id"), F.lit(2)) == part), f"part{part}", "vec_id")
    hits, _ = index.search(made, queries)
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"), "rank")


@query("""
WITH c AS (SELECT conv_id, turn, list(text) FILTER (length(text) < 100) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(p[-5:], chr(10)), '') AS context, coalesce(len(p[-5:]), 0)::INT AS n_lines FROM c""")
def chunk_rolling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five short texts before each one."""
    rows = chunks.recent_short(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", "p")
    return rows.select("conv_id", "turn", F.array_join("p", "\n").alias("context"), F.size("p").alias("n_lines"))


@query("""
WITH s AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY l_orderkey),
r AS (SELECT o_orderkey, o_orderpriority, coalesce(ids, []::BIGINT[]) AS ids FROM orders LEFT JOIN s ON l_orderkey = o_orderkey),
one AS (SELECT o_orderkey, o_orderpriority, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS item FROM r)
SELECT o_orderkey, 'combined' AS packaging_mode, 0 AS item, len(ids)::INT AS n_products, o_orderpriority AS title,
  'draft_' || substr(sha1('|' || o_orderkey || '|combined' || coalesce('|' || nullif(array_to_string(list_sort(list_transform(ids, lambda x: x::VARCHAR)), '|'), ''), '')), 1, 12) AS id FROM r
UNION ALL SELECT o_orderkey, 'one_per_product', item::INT, 1, o_orderpriority || ' - ' || id, 'draft_' || substr(sha1('|' || o_orderkey || '|one_per_product|' || id), 1, 12) FROM one""")
def draft_packaging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders packaged as one draft each, and as one per line."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")).alias("ids"))
    none = F.array().cast("array<string>")
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    chosen = rows.select(F.lit("").alias("key"), F.col("o_orderkey").cast("string").alias("requirement_id"), F.lit("").alias("spec_section_id"), F.lit("").alias("source_clause"), F.lit("other").alias("submittal_type"), none.alias("evidence_ids"), F.col("o_orderpriority").alias("title"), F.coalesce("ids", none).alias("ids"), F.coalesce("ids", none).alias("names"))
    return packaging.drafts(chosen, "combined", "one_per_product").select(F.col("requirement_id").cast("long").alias("o_orderkey"), "packaging_mode", "item", F.size("product_ids").alias("n_products"), "title", "id")


@query("""
SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type, p_size::VARCHAR)), 'gear brand#1')""")
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over several fields at once."""
    part = table(spark, sf_dir, "part")
    return part.where(P.search(["p_name", "p_brand", "p_type", F.col("p_size").cast("string")], " Gear Brand#1")).select("p_partkey", "p_name")


@query("""
WITH b AS (SELECT p_partkey, p_size * 10.0 AS l, p_retailprice / 2 AS t, p_size * 10.0 + p_partkey % 40 AS r, p_retailprice / 2 - p_partkey % 300 AS b, CASE p_partkey % 4 WHEN 0 THEN 'TOPLEFT' WHEN 1 THEN 'CENTER' WHEN 2 THEN 'BOTTOMLEFT' END AS o FROM part),
s AS (SELECT p_partkey, o, l * 1.5 AS xa, r * 1.5 AS xb, (CASE WHEN coalesce(o, 'BOTTOMLEFT') = 'TOPLEFT' THEN t ELSE 792 - t END) * 1.5 AS ya, (CASE WHEN coalesce(o, 'BOTTOMLEFT') = 'TOPLEFT' THEN b ELSE 792 - b END) * 1.5 AS yb FROM b),
c AS (SELECT p_partkey, o, greatest(0, least(least(xa, xb), 918)) AS x0, greatest(0, least(greatest(xa, xb), 918)) AS x1, greatest(0, least(least(ya, yb), 1188)) AS y0, greatest(0, least(greatest(ya, yb), 1188)) AS y1 FROM s)
SELECT p_partkey, ok AS shown, CASE WHEN ok THEN round(x0, 3) END AS x0, CASE WHEN ok THEN round(y0, 3) END AS y0, CASE WHEN ok THEN round(x1, 3) END AS x1, CASE WHEN ok THEN round(y1, 3) END AS y1
FROM (SELECT *, coalesce(o, 'BOTTOMLEFT') <> 'CENTER' AND x1 - x0 >= 1 AND y1 - y0 >= 1 AS ok FROM c)""")
def bbox_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on pages of 612 x 792 in images of 918 x 1188."""
    key, size, price = F.col("p_partkey"), F.col("p_size") * 10.0, F.col("p_retailprice")
    origin = F.when(key % 4 == 0, "TOPLEFT").when(key % 4 == 1, "CENTER").when(key % 4 == 2, "BOTTOMLEFT")
    box = F.struct(size.alias("l"), (price / 2).alias("t"), (size + key % 40).alias("r"), (price / 2 - key % 300).alias("b"), origin.alias("coord_origin"))
    rows = table(spark, sf_dir, "part").select("p_partkey", box.alias("box")).withColumn("px", X.pixel_rect("box", F.lit(612.0), F.lit(792.0), F.lit(918), F.lit(1188)))
    return rows.select("p_partkey", F.col("px").isNotNull().alias("shown"), *(F.round(F.col(f"px.{c}"), 3).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("""
SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000) AS resolved FROM customer""")
def scope_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that resolve and those that do not."""
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("evidence_id"), F.col("c_custkey").alias("ord"))
    known = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000").select(F.col("o_custkey").alias("id"))
    resolved, missing = evidence.resolve(ids, known)
    named = resolved.select(F.col("id").alias("c_custkey")).distinct().withColumn("resolved", F.lit(True))
    return named.unionByName(missing.select(F.col("evidence_id").alias("c_custkey"), F.lit(False).alias("resolved")))


@query(f"""
WITH l AS (SELECT doc_id, pos, {_SQL_NORMAL.format(x='line')} AS n FROM ({_LINES})), k AS (SELECT doc_id, n, {_SQL_KEY.format(x='n')} AS k FROM l WHERE n <> '')
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length(regexp_replace(n, '[^\\pL]', '', 'g')) >= 3 AND length(n) <= 120) AS n_title_like, count(*) FILTER (length(n) <= 40 AND upper(n) = n AND contains(n, ' ')) AS n_shouting,
  sum(length(k))::BIGINT AS key_chars, count(*) FILTER (regexp_matches(n, '(?i)^(part|section|division)\\b')) AS n_heads FROM k GROUP BY doc_id""")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates on lines, counted by document."""
    rows = _lines(spark, sf_dir).where(X.has_text("line")).select("doc_id", X.normalize("line").alias("n")).withColumn("k", X.key_of("n"))
    t = F.col("n")
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if((letters >= 3) & (F.length(t) <= 120)).alias("n_title_like"), F.count_if((F.length(t) <= 40) & (F.upper(t) == t) & t.contains(" ")).alias("n_shouting"),
        F.sum(F.length("k")).alias("key_chars"), F.count_if(t.rlike(r"(?i)^(part|section|division)\b")).alias("n_heads"),
    )


def _modes() -> Column:
    qualified = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return P.name_support(qualified, F.concat("p_brand", F.lit(" (indoor use)")), F.col("blob"), unicode=False)["mode"]


@query(f"""
WITH p AS (SELECT p_partkey, {_SQL_KEY.format(x='p_name')} AS core, lower(p_type) AS q, lower(replace(p_brand, '#', ' ')) AS brand, CASE WHEN p_size <= 25 THEN {_SQL_KEY.format(x='p_name')} || ' ' || lower(p_type) WHEN p_size <= 40 THEN {_SQL_KEY.format(x='p_name')} ELSE lower(replace(p_brand, '#', ' ')) END AS blob FROM part),
f AS (SELECT *, list_filter(string_split(core || ' ' || q, ' '), lambda w: length(w) > 2) AS ws FROM p)
SELECT CASE WHEN contains(blob, core || ' ' || q) OR (len(ws) >= 2 AND len(list_filter(ws, lambda w: NOT contains(blob, w))) = 0) THEN 'name'
  WHEN contains(blob, brand) THEN 'core_fallback' ELSE 'unsupported' END AS mode, count(*) AS n, min(p_partkey) AS first_part FROM f GROUP BY 1""")
def name_support_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the name of a product with a qualifier is supported by its evidence."""
    key = X.match_key("p_name", unicode=False)
    blob = F.when(F.col("p_size") <= 25, F.concat_ws(" ", key, F.lower("p_type"))).when(F.col("p_size") <= 40, key).otherwise(F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))))
    part = table(spark, sf_dir, "part")
    spread = part.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # a file of few megabytes is one task
    rows = spread.withColumn("blob", blob).select("p_partkey", _modes().alias("mode"))
    return rows.groupBy("mode").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))
