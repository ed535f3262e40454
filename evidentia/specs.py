"""Queries of the engine's own operators over specifications made up from the driver's tables, and their SQL twins.

Events of a user become the items of a document: signups are SECTION headings,
views PARTs, clicks articles, purchases lettered paragraphs, errors other text.
The twins know what an event became and follow the definitions, not the engine's
expressions; what depends on earlier decisions is run through row by row there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia import schemas
from evidentia.catalog import _EVENTS, _events, query, table
from evidentia.functions import predicates as P
from evidentia.functions import text as X
from evidentia.operators import candidates, evidence, regions, sections, tree
from evidentia.plans.lineage import cut
from evidentia.sources import files


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, items): the events of each user as parsed items; some are repeated, blank or without a page."""
    e, kind = F.col("event_id"), F.col("event_type")
    said = (
        F.when(kind == "signup", F.concat(F.when(e % 2 == 1, "SECTION ").otherwise(""), (15000 + e % 4).cast("string")))
        .when(kind == "view", F.concat(F.lit("PART "), 1 + e % 3, F.when(e % 3 == 1, " PRODUCTS").otherwise(" GENERAL")))
        .when(kind == "click", F.concat(1 + e % 3, F.lit(".0"), 1 + e % 7, F.when(e % 2 == 0, " SUBMITTALS").otherwise(" FANS")))
        .when(kind == "purchase", F.concat(F.element_at(F.array(*map(F.lit, "ABC")), (e % 3 + 1).cast("int")), F.lit(". Product data "), e % 5))
        .otherwise(F.element_at(F.array(*map(F.lit, ("1. detail", "a. small part", "see  the ﬁns – “drawings” ", "Fan notes"))), (e % 4 + 1).cast("int")))
    )
    label = (
        F.when(kind == "signup", F.when(e % 2 == 1, "title").otherwise("section_header")).when(kind.isin("view", "click"), "Section_Header ")
        .when(kind == "purchase", F.when(e % 2 == 0, "page_header").otherwise("list_item")).otherwise(F.when(e % 5 == 0, "page_header").otherwise("text"))
    )
    box = F.lit(None).cast(schemas.BBOX)
    page = lambda n: F.struct(n.cast("int").alias("page_no"), box.alias("bbox"))
    blank = F.lit(" \n")
    item = F.struct(
        F.when(e % 11 != 0, F.concat(F.lit("#/"), e % 400)).alias("self_ref"), label.alias("label"),
        F.when((e % 13 == 0) | (e % 17 == 0), blank).otherwise(said).alias("orig"), F.when(e % 17 == 0, blank).otherwise(said).alias("text"),
        F.when((kind == "error") & (e % 4 == 3), "2.").alias("marker"),
        F.when(e % 19 != 0, F.array(page(F.lit(0)), page(F.floor(F.col("i") / 10) + 1))).alias("prov"),
    )
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    each = rows.select(F.concat(F.lit("u"), "user_id").alias("document_id"), F.posexplode("x").alias("i", "y")).select("document_id", "i", "y.*")
    return each.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", item.alias("item")))), lambda y: y["item"]).alias("items"))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.catalog(documents(spark, sf_dir))


# The rows of the evidence (ev: d, pos, idx, e, k, t, n, heading, page, id, clause, article), as SQL.
_ITEMS = """
i AS (SELECT 'u' || user_id AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_id AS e, event_type AS k FROM events),
j AS (SELECT *, pos // 10 + 1 AS page, CASE WHEN e % 11 <> 0 THEN '#/' || e % 400 END AS ref,
  CASE k WHEN 'signup' THEN CASE WHEN e % 2 = 1 THEN 'SECTION ' ELSE '' END || (15000 + e % 4) WHEN 'view' THEN 'PART ' || (1 + e % 3) || CASE WHEN e % 3 = 1 THEN ' PRODUCTS' ELSE ' GENERAL' END
    WHEN 'click' THEN (1 + e % 3) || '.0' || (1 + e % 7) || CASE WHEN e % 2 = 0 THEN ' SUBMITTALS' ELSE ' FANS' END WHEN 'purchase' THEN chr((65 + e % 3)::INT) || '. Product data ' || e % 5
    ELSE ['1. detail', 'a. small part', 'see  the ﬁns – “drawings” ', 'Fan notes'][e % 4 + 1] END AS t,
  k IN ('signup', 'view', 'click') OR (k = 'purchase' AND e % 2 = 0) OR (k = 'error' AND e % 5 = 0) AS heading FROM i),
q AS (SELECT *, e % 17 <> 0 AND e % 19 <> 0 AS good, min(CASE WHEN e % 17 <> 0 AND e % 19 <> 0 THEN pos END) OVER (PARTITION BY d, ref) AS first_pos FROM j)"""
_EV = f"""{_ITEMS},
r AS (SELECT *, CASE WHEN t LIKE 'see  the%' THEN 'see the fins - "drawings"' ELSE t END AS n, row_number() OVER (PARTITION BY d ORDER BY pos) - 1 AS idx FROM q WHERE good AND (ref IS NULL OR pos <= first_pos)),
c1 AS (SELECT *, last_value(CASE WHEN k = 'click' THEN split_part(t, ' ', 1) END IGNORE NULLS) OVER w AS article, count(CASE WHEN k = 'click' THEN 1 END) OVER w AS g1 FROM r WINDOW w AS (PARTITION BY d ORDER BY pos)),
c2 AS (SELECT *, last_value(CASE WHEN k = 'purchase' THEN t[1] END IGNORE NULLS) OVER w AS letter, count(CASE WHEN k = 'purchase' THEN 1 END) OVER w AS g2 FROM c1 WINDOW w AS (PARTITION BY d, g1 ORDER BY pos)),
c3 AS (SELECT *, CASE WHEN letter IS NOT NULL THEN last_value(CASE WHEN k = 'error' AND letter IS NOT NULL THEN CASE e % 4 WHEN 0 THEN '1' WHEN 3 THEN '2' END END IGNORE NULLS) OVER w END AS number,
  count(CASE WHEN k = 'error' AND letter IS NOT NULL AND e % 4 IN (0, 3) THEN 1 END) OVER w AS g3 FROM c2 WINDOW w AS (PARTITION BY d, g1, g2 ORDER BY pos)),
c4 AS (SELECT *, CASE WHEN number IS NOT NULL THEN last_value(CASE WHEN k = 'error' AND e % 4 = 1 AND number IS NOT NULL THEN 'a' END IGNORE NULLS) OVER w END AS sub FROM c3 WINDOW w AS (PARTITION BY d, g1, g2, g3 ORDER BY pos)),
ev AS (SELECT d, pos, idx, e, k, t, n, heading, page, ref, article, CASE WHEN article IS NOT NULL THEN concat_ws('.', article, letter, number, sub) END AS clause, sha256(n) AS hash,
  'ev_' || substr(sha256(d || chr(0) || coalesce(ref, page::VARCHAR) || chr(0) || sha256(n)), 1, 16) AS id FROM c4)"""
_PATHS = """
h AS (SELECT d, pos, t, CASE k WHEN 'signup' THEN CASE WHEN e % 2 = 1 THEN 10 ELSE 15 END WHEN 'view' THEN 20 WHEN 'click' THEN 30 WHEN 'purchase' THEN 40 ELSE 15 END AS rank, row_number() OVER (PARTITION BY d ORDER BY pos) AS no FROM ev WHERE heading),
p AS (SELECT DISTINCT d, 0::BIGINT AS no, -1::BIGINT AS pos, []::STRUCT(r INT, t VARCHAR)[] AS path FROM ev UNION ALL
  SELECT p.d, h.no, h.pos, CASE WHEN h.rank <= 15 AND len(list_filter(path, lambda x: x.r >= 30 OR x.t = trim(h.t))) > 0 THEN path ELSE list_append(list_filter(path, lambda x: x.r < h.rank), {'r': h.rank, 't': trim(h.t)}) END
  FROM p JOIN h ON h.d = p.d AND h.no = p.no + 1)"""


@query(f"""
WITH RECURSIVE {_EV}, {_PATHS}
SELECT ev.d AS document_id, ev.pos::INT AS pos, id, coalesce(ref, '') AS docling_ref, page::INT AS page_number, ev.t AS raw_text, hash AS text_hash, clause AS source_clause, CASE WHEN heading THEN 'heading' ELSE 'other' END AS evidence_kind,
  array_to_string(list_transform(p.path, lambda x: x.t), ' > ') AS heading_path FROM ev ASOF JOIN p ON p.d = ev.d AND p.pos <= ev.pos""")
def evidence_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their items to evidence: refs, pages, kinds, clauses, heading paths, ids."""
    return _evidence(spark, sf_dir).select("document_id", "pos", "id", "docling_ref", "page_number", "raw_text", "text_hash", "source_clause", "evidence_kind", F.array_join("heading_path", " > ").alias("heading_path"))


@query(f"""
WITH {_ITEMS}
SELECT d AS document_id, pos::INT AS pos, CASE WHEN ref IS NOT NULL AND pos > first_pos THEN 'duplicate_docling_ref' WHEN e % 17 = 0 THEN 'no_meaningful_text' ELSE 'no_page_provenance' END AS reason, ref AS docling_ref,
  CASE WHEN NOT (ref IS NOT NULL AND coalesce(pos > first_pos, FALSE)) AND e % 17 <> 0 THEN t END AS preview FROM q WHERE NOT good OR (ref IS NOT NULL AND pos > first_pos)""")
def evidence_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are no evidence, and why."""
    return evidence.skip_log(evidence.read_items(evidence.explode_items(documents(spark, sf_dir))))


@query(f"""
WITH {_EV} SELECT d AS document_id, page::INT AS page_number, min(pos)::INT AS first_pos FROM ev GROUP BY ALL""")
def evidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages of a document's evidence."""
    return evidence.pages(_evidence(spark, sf_dir))


_SECTIONS = f"""{_EV},
f AS (SELECT *, k = 'signup' AS sec, k = 'view' AS part, k = 'click' AS art, k = 'error' AND e % 4 <> 1 AS titled, 15000 + e % 4 AS num FROM ev),
a AS (SELECT *, lead(titled, 1) OVER w AS t1, lead(sec OR part OR art, 1) OVER w AS s1, lead(n, 1) OVER w AS n1, lead(id, 1) OVER w AS i1, lead(titled AND heading, 2) OVER w AS t2, lead(sec OR part OR art, 2) OVER w AS s2, lead(n, 2) OVER w AS n2, lead(id, 2) OVER w AS i2,
  min(CASE WHEN part OR art THEN idx END) OVER near AS body, min(CASE WHEN sec THEN idx END) OVER near AS stop, count(CASE WHEN part OR art THEN 1 END) OVER back AS bodies, min(CASE WHEN sec THEN num END) OVER back AS lo, max(CASE WHEN sec THEN num END) OVER back AS hi
  FROM f WINDOW w AS (PARTITION BY d ORDER BY idx), near AS (PARTITION BY d ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 49 FOLLOWING), back AS (PARTITION BY d ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT d, idx, id, num, page, CASE WHEN t1 AND NOT s1 THEN n1 WHEN NOT t1 AND NOT s1 AND t2 AND NOT s2 THEN n2 END AS title, CASE WHEN t1 AND NOT s1 THEN i1 WHEN NOT t1 AND NOT s1 AND t2 AND NOT s2 THEN i2 END AS title_id, e % 2 = 1 AS keyword,
  coalesce(body < coalesce(stop, 1000000000), FALSE) AS confirmed, bodies > 0 AND coalesce(lo = hi, TRUE) AS before_ok, (SELECT count(DISTINCT z.num) FROM f z WHERE z.d = a.d AND z.sec AND abs(z.idx - a.idx) <= 25) >= 3 AS toc FROM a WHERE sec),
m AS (SELECT *, CASE WHEN title IS NOT NULL THEN 'heading_plus_title' WHEN keyword THEN 'explicit_section_heading' ELSE 'numbered_heading' END AS method FROM b),
g AS (SELECT *, confirmed OR (NOT toc AND (before_ok OR method <> 'numbered_heading')) AS passes FROM m),
u AS (SELECT *, min(CASE WHEN passes THEN idx END) OVER (PARTITION BY d, num) AS first FROM g),
y AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY idx) AS no FROM u WHERE idx = first),
w AS (SELECT d, string_agg(CASE WHEN toc THEN 'skipped_toc_like_section_number:' ELSE 'skipped_unconfirmed_numbered_heading:' END || num || '@index=' || idx, '|' ORDER BY idx) AS skipped FROM u WHERE NOT passes AND (first IS NULL OR idx < first) GROUP BY d),
x AS (SELECT *, CASE WHEN no = 1 AND before_ok THEN 0 ELSE idx END AS start, no = 1 AND idx > 0 AND before_ok AS extended, coalesce(lead(idx) OVER (PARTITION BY d ORDER BY idx) - 1, 1000000000) AS stop FROM y),
sections AS (SELECT x.d, x.num, any_value('sec_' || substr(sha256(x.d || chr(0) || x.num || chr(0) || x.id), 1, 16)) AS id, any_value(title) AS title, any_value(method) AS method, min(ev.idx) AS start_index, max(ev.idx) AS end_index, min(ev.page) AS start_page, max(ev.page) AS end_page,
  arg_min(ev.id, ev.idx) AS start_id, arg_max(ev.id, ev.idx) AS end_id, string_agg(ev.id, ',' ORDER BY ev.idx) AS ids, any_value(x.id || CASE WHEN title IS NOT NULL THEN ',' || title_id ELSE '' END) AS heading_ids,
  any_value(concat_ws('|', CASE WHEN NOT confirmed AND NOT before_ok THEN 'weak_body_confirmation' END, CASE WHEN extended THEN 'start_extended_before_heading' END, CASE WHEN no = 1 THEN skipped END)) AS warnings
  FROM x JOIN ev ON ev.d = x.d AND ev.idx BETWEEN x.start AND x.stop LEFT JOIN w ON w.d = x.d GROUP BY x.d, x.num)"""


def _sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = cut(_evidence(spark, sf_dir))
    return rows, sections.discover(rows)


@query(f"""
WITH {_SECTIONS}
SELECT id, d AS document_id, num::VARCHAR AS section_number, title, method AS detection_method, start_index::INT AS start_index, end_index::INT AS end_index, start_page::INT AS start_page, end_page::INT AS end_page, start_id AS start_evidence_id, end_id AS end_evidence_id,
  ids AS evidence_ids, heading_ids AS heading_evidence_ids, warnings FROM sections""")
def sections_discover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents: starts, titles, tables of contents, spans, pages, warnings."""
    found = _sections(spark, sf_dir)[1]
    joined = lambda c, by: F.array_join(c, by).alias(c)
    return found.select("id", "document_id", "section_number", "title", "detection_method", "start_index", "end_index", "start_page", "end_page", "start_evidence_id", "end_evidence_id", joined("evidence_ids", ","), joined("heading_evidence_ids", ","), joined("warnings", "|"))


@query("""
WITH r AS (SELECT c_custkey AS n, c_custkey // 30 AS d, c_custkey % 10 AS m FROM customer),
v AS (SELECT d, n, (n % 40 + 1)::VARCHAR AS number, CASE n // 10 % 3 WHEN 1 THEN 'WORK OF ' || n WHEN 2 THEN 'Pipes' END AS title FROM r WHERE n % 20 = 10),
x AS (SELECT r.d, r.n, max(v.n) AS at FROM r LEFT JOIN v ON v.d = r.d AND v.n < r.n WHERE m IN (2, 6) GROUP BY ALL)
SELECT 'd' || x.d AS document_id, (15000 + x.n % 900)::VARCHAR AS section_number, v.number AS division_number, v.title AS division_title FROM x LEFT JOIN v ON v.d = x.d AND v.n = x.at""")
def sections_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The division in force where a section opens; customers stand for lines."""
    n, m = F.col("c_custkey"), F.col("c_custkey") % 10
    tail = F.when(F.floor(n / 10) % 3 == 1, F.concat(F.lit(" - WORK OF "), n)).when(F.floor(n / 10) % 3 == 2, ": Pipes").otherwise("")
    said = F.when(n % 20 == 10, F.concat(F.lit("DIVISION "), n % 40 + 1, tail)).when(m.isin(2, 6), F.concat(F.lit("SECTION "), 15000 + n % 900, F.lit(" - DUCTS"))).when(m.isin(3, 7), "PART 1 GENERAL").otherwise("plain text, of no kind.")
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("d"), F.floor(n / 30)).alias("document_id"), F.concat(F.lit("e"), n).alias("id"), n.alias("pos"), said.alias("raw_text"),
        F.when(said.startswith("plain"), "other").otherwise("heading").alias("evidence_kind"), F.lit(1).alias("page_number"),
    )
    return sections.discover(rows).select("document_id", "section_number", "division_number", "division_title")


@query(f"""
WITH {_SECTIONS},
n AS (SELECT d, id, count(*) AS times FROM (SELECT d, unnest(string_split(ids, ',')) AS id FROM sections) GROUP BY ALL),
s AS (SELECT sections.d, min(ev.pos) AS first_pos FROM (SELECT d, arg_min(start_id, start_index) AS id FROM sections GROUP BY d) sections JOIN ev ON ev.d = sections.d AND ev.id = sections.id GROUP BY ALL),
t AS (SELECT d, string_agg(id, ',' ORDER BY pos) AS ids FROM (SELECT n.d, n.id, min(ev.pos) AS pos FROM n JOIN ev ON ev.d = n.d AND ev.id = n.id WHERE times > 1 GROUP BY ALL) GROUP BY d)
SELECT ev.d AS document_id, count(*) AS total_evidence, count(DISTINCT CASE WHEN times > 0 THEN ev.id END) AS assigned_evidence, count(CASE WHEN ev.pos < first_pos THEN 1 END) AS evidence_before_first_section, count(CASE WHEN times IS NULL THEN 1 END) AS evidence_unassigned,
  coalesce(string_agg(CASE WHEN times IS NULL THEN ev.id END, ',' ORDER BY ev.pos), '') AS unassigned_evidence_ids, coalesce(any_value(t.ids), '') AS duplicate_assignment_ids
FROM ev LEFT JOIN n ON n.d = ev.d AND n.id = ev.id LEFT JOIN s ON s.d = ev.d LEFT JOIN t ON t.d = ev.d GROUP BY ev.d""")
def sections_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document its sections cover, and which evidence none or more than one has."""
    found = sections.coverage(*_sections(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, ",") for c in ("unassigned_evidence_ids", "duplicate_assignment_ids")})


_REGIONS = f"""{_EV},
st AS (SELECT * FROM ev WHERE k = 'click' AND e % 2 = 0),
en AS (SELECT st.d, st.idx, min(z.idx) AS stop FROM st LEFT JOIN ev z ON z.d = st.d AND z.idx > st.idx AND (z.article <> st.article OR z.k = 'view') GROUP BY ALL),
sp AS (SELECT st.d, st.idx AS a, coalesce(stop - 1, (SELECT max(idx) FROM ev z WHERE z.d = st.d)) AS z, st.id, st.t, st.article, stop IS NULL AS eof FROM st JOIN en USING (d, idx)),
regions AS (SELECT * FROM sp WHERE NOT EXISTS (SELECT 1 FROM sp o WHERE o.d = sp.d AND o.a < sp.a AND o.z >= sp.z))"""


@query(f"""
WITH {_REGIONS}
SELECT g.d AS document_id, a::INT AS start_index, z::INT AS end_index, any_value(g.id) AS start_evidence_id, arg_max(ev.id, ev.idx) AS end_evidence_id, any_value(g.t) AS heading, any_value(g.article) AS source_clause, 105 AS priority, 'article_clause' AS detection_method,
  any_value(CASE WHEN eof THEN 'ended_at_catalog_eof' ELSE '' END) AS warnings, string_agg(ev.id, ',' ORDER BY ev.idx) AS evidence_ids FROM regions g JOIN ev ON ev.d = g.d AND ev.idx BETWEEN a AND z GROUP BY ALL""")
def regions_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submittal regions: starts, priorities, ends, and the choice among them."""
    found = regions.locate(_evidence(spark, sf_dir))
    return found.withColumns({"warnings": F.array_join("warnings", "|"), "evidence_ids": F.array_join("evidence_ids", ",")})


@query(f"""
WITH {_REGIONS}
SELECT ev.d AS document_id, ev.id, ev.pos::INT AS pos FROM ev WHERE EXISTS (SELECT 1 FROM regions g JOIN ev x ON x.d = g.d AND x.idx BETWEEN a AND z WHERE x.id = ev.id)""")
def regions_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence that regions name, once and in order."""
    rows = cut(_evidence(spark, sf_dir))
    return regions.region_evidence(regions.locate(rows), rows).select("document_id", "id", "pos")


# Spans of products: rows of the first PART that says so, else of articles numbered 2.
_CANDIDATES = f"""{_EV},
pf AS (SELECT d, min(idx) AS f FROM ev WHERE k = 'view' AND e % 3 = 1 GROUP BY d),
pt AS (SELECT pf.d, f, min(ev.idx) AS z FROM pf LEFT JOIN ev ON ev.d = pf.d AND ev.k = 'view' AND ev.e % 3 <> 1 AND ev.idx > f GROUP BY ALL),
ar AS (SELECT ev.*, split_part(t, ' ', 1) AS art FROM ev JOIN pt ON pt.d = ev.d AND ev.idx > f AND (z IS NULL OR ev.idx < z)),
ab AS (SELECT *, last_value(CASE k WHEN 'view' THEN '' WHEN 'click' THEN art END IGNORE NULLS) OVER (PARTITION BY d ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ar),
ao AS (SELECT *, k = 'click' AND (prev IS NULL OR prev <> art) AS opens FROM ab),
as_ AS (SELECT *, count(CASE WHEN opens THEN 1 END) OVER (PARTITION BY d ORDER BY idx) AS span FROM ao),
ax AS (SELECT *, max(CASE WHEN k = 'view' AND NOT opens THEN 1 ELSE 0 END) OVER (PARTITION BY d, span ORDER BY idx) AS over FROM as_ WHERE span > 0),
ho AS (SELECT *, split_part(t, ' ', 1) AS art, k = 'click' AND t LIKE '2.%' AS opens FROM ev),
hs AS (SELECT *, count(CASE WHEN opens THEN 1 END) OVER w AS span, last_value(CASE WHEN opens THEN art END IGNORE NULLS) OVER w AS own FROM ho WINDOW w AS (PARTITION BY d ORDER BY idx)),
hx AS (SELECT *, max(CASE WHEN NOT opens AND (k = 'view' OR (k = 'click' AND art <> own)) THEN 1 ELSE 0 END) OVER (PARTITION BY d, span ORDER BY idx) AS over FROM hs WHERE span > 0),
un AS (SELECT d, idx, id, t, k, e, article, span, 'part_products' AS method FROM ax WHERE over = 0 UNION ALL SELECT d, idx, id, t, k, e, article, span, 'heading_fallback' FROM hx WHERE over = 0),
ke AS (SELECT *, k <> 'view' AND NOT (k = 'signup' AND e % 2 = 1) AS kept FROM un),
na AS (SELECT *, kept AND row_number() OVER (PARTITION BY method, d, id, kept ORDER BY idx) = 1 AS named FROM ke),
sa AS (SELECT d, method, min(idx) AS a, max(idx) AS z, arg_min(id, idx) AS id, arg_min(t, idx) AS heading, arg_min(article, idx) AS clause, string_agg(CASE WHEN named THEN id END, ',' ORDER BY idx) AS ids, count(CASE WHEN named THEN 1 END) AS n, sum(CASE WHEN named THEN length(t) END) AS chars, count(CASE WHEN kept THEN 1 END) AS k FROM na GROUP BY d, method, span),
products AS (SELECT * FROM sa WHERE k > 0 AND (method = 'part_products' OR d NOT IN (SELECT d FROM sa WHERE method = 'part_products' AND k > 0)))"""


@query(f"""
WITH {_CANDIDATES}
SELECT d AS document_id, a::INT AS start_index, z::INT AS end_index, id AS heading_evidence_id, heading, clause AS source_clause, coalesce(ids, '') AS evidence_ids, chars::BIGINT AS chars, method AS detection_method FROM products""")
def candidates_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product candidates: articles of the PRODUCTS part, else headings that look like products."""
    return candidates.collect(_evidence(spark, sf_dir)).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


@query(f"""
WITH {_CANDIDATES} SELECT d AS document_id, count(*) AS total_regions, sum(n)::BIGINT AS total_evidence, sum(coalesce(chars, 0))::BIGINT AS approx_char_count FROM products GROUP BY d""")
def candidates_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the candidates of each document come to."""
    return candidates.totals(candidates.collect(_evidence(spark, sf_dir)))


@query(f"""
WITH {_CANDIDATES}, u AS (SELECT d, max(CASE WHEN method = 'part_products' THEN 1 ELSE 0 END) AS by_part FROM products GROUP BY d)
SELECT v.d AS document_id, CASE WHEN coalesce(by_part, 0) = 0 THEN 'no_explicit_product_part_detected|used_heading_fallback' WHEN z IS NULL AND f IS NOT NULL THEN 'product_part_ended_at_catalog_eof' ELSE '' END AS warnings
FROM (SELECT DISTINCT d FROM ev) v LEFT JOIN u ON u.d = v.d LEFT JOIN pt ON pt.d = v.d""")
def candidates_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the candidates of each document came about."""
    rows = cut(_evidence(spark, sf_dir))
    return candidates.warnings(rows, candidates.collect(rows)).withColumn("warnings", F.array_join("warnings", "|"))


@query(f"""
WITH {_SECTIONS}
SELECT d AS document_id, id, pos::INT AS pos FROM ev WHERE EXISTS (SELECT 1 FROM sections s WHERE s.d = ev.d AND contains(s.heading_ids, ev.id))""")
def evidence_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence that the headings of sections name, once and in catalog order."""
    rows, found = _sections(spark, sf_dir)
    return evidence.flatten_ids(found, rows, "heading_evidence_ids").select("document_id", "id", "pos")


_TREE = f"""
n0 AS (SELECT user_id AS d, idx AS i, CASE WHEN idx % 7 = 3 THEN 'groups' WHEN idx % 11 = 5 THEN 'pictures' WHEN idx % 13 = 6 THEN 'tables' ELSE 'texts' END AS kind,
  CASE WHEN idx < 3 THEN -1 WHEN idx % 60 = 41 THEN idx + 1 WHEN idx % 60 = 42 THEN idx - 1 WHEN idx % 5 = 4 THEN idx - 1 ELSE idx // 3 END AS p, event_type FROM ({_EVENTS})),
n1 AS (SELECT d, i, kind, '#/' || kind || '/' || i AS ref, p FROM n0),
e AS (SELECT c.d, c.p, c.i * 37 % 101 AS a, c.i, c.ref FROM n1 c JOIN n1 q ON q.d = c.d AND q.i = c.p UNION ALL SELECT d, p, i * 37 % 101, i, ref FROM n1 WHERE p = -1),
k AS (SELECT d, p, i, row_number() OVER (PARTITION BY d, p ORDER BY a, i) - 1 AS place FROM e),
w AS (SELECT d, i, [place] AS way, FALSE AS hidden FROM k WHERE p = -1 UNION ALL
  SELECT k.d, k.i, list_append(w.way, k.place), w.hidden OR n1.kind = 'pictures' FROM w JOIN n1 ON n1.d = w.d AND n1.i = w.i JOIN k ON k.d = w.d AND k.p = w.i)"""


@query(f"""
WITH RECURSIVE {_TREE},
s AS (SELECT 'u' || w.d AS document_id, 'item' AS what, ref, row_number() OVER (PARTITION BY w.d ORDER BY way) - 1 AS pos, len(way) AS level FROM w JOIN n1 ON n1.d = w.d AND n1.i = w.i WHERE NOT hidden AND kind <> 'groups' AND w.i % 17 <> 9)
SELECT document_id, what, ref, pos::INT AS pos, level::INT AS level FROM s
UNION ALL SELECT 'u' || d, 'dangling_reference', '#/texts/none', -1, -1 FROM n1 WHERE i % 31 = 8
UNION ALL SELECT 'u' || d, 'second_reference', ref, -1, -1 FROM n1 WHERE i % 29 = 17
UNION ALL SELECT 'u' || n1.d, 'cycle', ref, -1, -1 FROM n1 LEFT JOIN w ON w.d = n1.d AND w.i = n1.i WHERE w.i IS NULL AND EXISTS (SELECT 1 FROM n1 q WHERE q.d = n1.d AND q.i = n1.p)""")
def document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading order of parsed documents with nested groups, and what leads nowhere; events stand for parts, cached as JSON."""
    i = F.col("idx")
    kind = F.when(i % 7 == 3, "groups").when(i % 11 == 5, "pictures").when(i % 13 == 6, "tables").otherwise("texts")
    parent = F.when(i < 3, -1).when(i % 60 == 41, i + 1).when(i % 60 == 42, i - 1).when(i % 5 == 4, i - 1).otherwise(F.floor(i / 3))
    rows = _events(spark, sf_dir).select(F.concat(F.lit("u"), "user_id").alias("document_id"), i.cast("long").alias("i"), kind.alias("kind"), parent.cast("long").alias("p"), "event_type")
    rows = rows.withColumn("ref", F.concat(F.lit("#/"), "kind", F.lit("/"), "i"))
    none = F.lit(None).cast("string")
    held = rows.select("document_id", F.col("p").alias("i"), (F.col("i") * 37 % 101).alias("a"), F.col("i").alias("b"), "ref")
    held = held.unionByName(rows.where("i % 29 = 17").select("document_id", F.lit(-1).cast("long").alias("i"), F.lit(200).cast("long").alias("a"), F.col("i").alias("b"), "ref"))
    held = held.unionByName(rows.where("i % 31 = 8").select("document_id", "i", F.lit(300).cast("long").alias("a"), F.col("i").alias("b"), F.lit("#/texts/none").alias("ref")))
    children = held.groupBy("document_id", "i").agg(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "ref"))), lambda x: F.struct(x["ref"].alias("$ref"))).alias("children"))
    bodies = children.where("i = -1").select("document_id", F.struct(F.lit("#/body").alias("self_ref"), "children").alias("body"))
    own = rows.select("document_id", "i", F.col("ref").alias("parent_ref"))
    full = rows.join(children, ["document_id", "i"], "left").join(own.withColumnRenamed("i", "p"), ["document_id", "p"], "left")
    node = F.struct(
        F.col("ref").alias("self_ref"), F.struct(F.coalesce("parent_ref", F.lit("#/body")).alias("$ref")).alias("parent"), F.coalesce("children", F.array()).alias("children"), F.when(i % 17 == 9, "furniture").alias("content_layer"),
        F.lit("text").alias("label"), F.col("event_type").alias("text"), none.alias("orig"), F.array(F.struct(F.lit(1).alias("page_no"))).alias("prov"),
    )
    full = full.withColumn("idx", F.col("i"))
    arrays = [F.collect_list(F.when(F.col("kind") == k, node)).alias(k) for k in ("groups", "pictures", "tables", "texts")]
    cached = full.groupBy("document_id").agg(*arrays).join(bodies, "document_id").select("document_id", F.to_json(F.struct("body", "groups", "pictures", "tables", "texts")).alias("json"))
    read, _ = files.parsed(cached)
    items, rejects = tree.reading_order(read)
    lost = rejects.select("document_id", F.col("reason").alias("what"), "ref", F.lit(-1).alias("pos"), F.lit(-1).alias("level"))
    return items.select("document_id", F.lit("item").alias("what"), F.col("self_ref").alias("ref"), "pos", "level").unionByName(lost)
