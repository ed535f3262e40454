"""Queries of validation, views, exports and projects over an extraction made up from parts, and their SQL twins.

Forty parts are a section.  Each part is a piece of evidence, and every few of them
are requirements, groups, products or links that cite it: some well, some with
unknown ids, names, phrases and conditions that their evidence does not have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia import schemas
from evidentia.catalog import query, table
from evidentia.functions import predicates as P
from evidentia.operators import evidence as E
from evidentia.operators import export, packaging, present, project, validate
from evidentia.plans.lineage import cut, scratch
from evidentia.sources import store


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.col("p_name").alias("nm"), F.col("p_brand").alias("brand"), F.lower("p_type").alias("ty"))
    root = F.concat((1 + n % 3).cast("string"), F.lit(".0"), 1 + n % 8)
    return rows.withColumns({"project_section_key": F.concat(F.lit("k"), F.floor(n / 40)), "ord": n.cast("int"), "m": (n % 40).cast("int"), "root": root, "e": F.concat(F.lit("e"), "n")})


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence."""
    n = F.col("n")
    said = F.concat_ws(" ", "nm", F.lit("of"), "ty", F.lit("per"), (10000 + n).cast("string"))
    return _parts(spark, sf_dir).select("project_section_key", F.col("e").alias("id"), F.col("project_section_key").alias("document_id"), said.alias("raw_text"), F.array("brand").alias("heading_path"), F.concat("root", F.when(n % 2 == 0, ".A").otherwise("")).alias("source_clause"), F.col("m").alias("pos"), (F.col("m") % 4 + 1).alias("page_number"), F.lit(None).cast(schemas.BBOX).alias("bbox"))


def extraction(spark: SparkSession, sf_dir: str) -> validate.Extraction:
    n = F.col("n")
    rows = _parts(spark, sf_dir)
    pick = lambda by, *values: F.element_at(F.array(*values), (by + 1).cast("int"))
    other = F.concat(F.lit("e"), F.floor(n / 40) * 40 + n * 7 % 40)
    unknown = F.concat(F.lit("gone"), "n")
    cited = F.when(n % 5 == 0, F.array(unknown)).when(n % 3 == 0, F.array(F.col("e"), unknown, other, F.col("e"))).otherwise(F.array("e"))

    def of(df: DataFrame, schema, **columns) -> DataFrame:
        made = {"spec_section_id": F.lit("s"), "review_status": F.lit("pending"), "project_section_key": F.col("project_section_key"), "ord": F.col("ord")} | columns
        return df.select(*(made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))

    return validate.Extraction(
        of(
            rows.where(n % 4 == 0), schemas.REQUIREMENT, id=F.concat(F.lit("r"), F.col("m") % 36), evidence_ids=cited, title=F.concat(F.lit("Data of "), "nm"), requirement_text=F.concat(F.lit("Submit "), "nm"), submittal_type=pick(n % 3, *map(F.lit, ("product_data", "shop_drawings", "other"))),
            source_category=F.when(n % 7 == 0, F.col("nm")).when(n % 7 == 1, "nothing of the kind"), condition=F.when(n % 6 == 0, F.concat(F.lit("of "), "ty")).when(n % 6 == 2, "only on mondays").when(n % 6 == 4, ""),
            cross_references=F.when(n % 8 == 0, F.array(F.concat(F.lit("Section "), 10000 + n), F.lit("Section 99"), F.lit("Section 77777"))).otherwise(F.array().cast("array<string>")),
            source_clause=F.when(n % 5 == 1, F.col("root")).when(n % 5 == 2, "9.99"),
        ),
        of(rows.where(n % 10 == 0), schemas.PRODUCT_GROUP, id=F.concat(F.lit("g"), F.floor(F.col("m") / 10)), name=F.when(n % 20 == 0, F.col("brand")).when(n % 30 == 10, "Unknown maker").otherwise(F.col("nm")), code=F.col("root"), evidence_ids=F.array("e")),
        of(
            rows.where(n % 4 != 0), schemas.PRODUCT, id=F.concat(F.lit("p"), "m"), evidence_ids=F.array("e"),
            name=F.when(n % 9 == 0, F.concat("nm", F.lit(" (indoor use)"))).when(n % 9 == 3, F.concat("nm", F.lit(" (nuclear grade)"))).when(n % 9 < 3, "zzz gadget").otherwise(F.col("nm")),
            normalized_name=F.when(n % 9 == 1, "yyy").when((n % 9 == 3) | (n % 9 == 0), "zzz gadget").otherwise(F.upper("nm")),
            product_group_id=F.when(n % 5 == 0, F.concat(F.lit("g"), F.floor(F.col("m") / 10))).when(n % 5 == 1, "g9").when(n % 5 == 2, ""),
        ),
        of(
            rows, schemas.LINK, id=F.concat(F.lit("l"), "m"), requirement_id=F.when(n % 13 == 0, "r99").otherwise(F.concat(F.lit("r"), n * 4 % 40)), product_id=F.concat(F.lit("p"), n * 3 % 40), mapping_method=pick(n % 3, *map(F.lit, schemas.MAPPING_METHODS)), evidence_ids=F.array("e"),
            source_phrase=F.when(n % 4 == 1, "of").when(n % 4 == 2, "no such phrase").when(n % 4 == 3, ""), confidence=F.when(n % 7 != 3, 0.75), review_required=F.when(n % 7 != 0, n % 2 == 0),
        ),
    )


# --- the twin of validation


def _key(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(lower({x}), '-', ' '), '[^\pL\pN_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _holds(hay: str, needle: str) -> str:
    """Containment of match keys, as SQL."""
    glue = lambda x: f"regexp_replace({x}, '[^a-z0-9]', '', 'g')"
    words = f"list_filter(string_split({needle}, ' '), lambda w: length(w) > 2)"
    return f"coalesce({hay} <> '' AND {needle} <> '' AND (contains({hay}, {needle}) OR ({glue(needle)} <> '' AND contains({glue(hay)}, {glue(needle)})) OR (len({words}) >= 2 AND len(list_filter({words}, lambda w: NOT contains({hay}, w))) = 0)), FALSE)"


def _listed(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _cited(name: str, raw: str) -> str:
    """CTEs: the first of equal ids, what it cites, and what is left; {name}_dup, {name}_bad and {name}_none are the issues."""
    return f"""
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY k, id ORDER BY n) AS rn FROM {raw}),
{name}_dup AS (SELECT * FROM {name}_n WHERE rn > 1), {name}_u AS (SELECT * FROM {name}_n WHERE rn = 1),
{name}_c AS (SELECT u.k, u.n, u.id, i, x.eid, src.eid AS hit, bk, clause FROM (SELECT k, n, id, unnest(ids) AS eid, generate_subscripts(ids, 1) AS i FROM {name}_u) x JOIN {name}_u u USING (k, n, id) LEFT JOIN src ON src.k = x.k AND src.eid = x.eid),
{name}_bad AS (SELECT * FROM {name}_c WHERE hit IS NULL),
{name}_f AS (SELECT k, n, eid, min(i) AS i, any_value(bk) AS bk, any_value(clause) AS clause FROM {name}_c WHERE hit IS NOT NULL GROUP BY ALL),
{name}_h AS (SELECT k, n, string_agg(eid, ',' ORDER BY i) AS kept, string_agg(bk, ' ' ORDER BY i) AS blob, list(clause ORDER BY i) AS clauses FROM {name}_f GROUP BY ALL),
{name}_j AS (SELECT u.* EXCLUDE (rn), kept, blob, clauses FROM {name}_u u LEFT JOIN {name}_h h USING (k, n)),
{name}_none AS (SELECT * FROM {name}_j WHERE kept IS NULL), {name}_k AS (SELECT * FROM {name}_j WHERE kept IS NOT NULL)"""


_BENIGN = _listed(P.BENIGN_WORDS)
_CORE, _QUAL = _key("regexp_extract(x, '^(.*?)\\s*\\(([^()]+)\\)\\s*$', 1)"), _key("regexp_extract(x, '^(.*?)\\s*\\(([^()]+)\\)\\s*$', 2)")


def _falls(x: str) -> str:
    core, qual = _CORE.replace("(x,", f"({x},"), _QUAL.replace("(x,", f"({x},")
    return f"({x} LIKE '%(%)' AND {_holds('blob', core)} AND ({_holds('blob', qual)} OR len(list_filter(string_split({qual}, ' '), lambda v: NOT list_contains({_BENIGN}, v) AND NOT contains(blob, v))) = 0))"


_VALID = f"""
pt AS (SELECT p_partkey AS n, p_name AS nm, p_brand AS b, lower(p_type) AS ty, 'k' || p_partkey // 40 AS k, p_partkey % 40 AS m, (1 + p_partkey % 3) || '.0' || (1 + p_partkey % 8) AS root FROM part),
src AS (SELECT k, n, 'e' || n AS eid, m AS pos, root || CASE WHEN n % 2 = 0 THEN '.A' ELSE '' END AS clause, nm || ' of ' || ty || ' per ' || (10000 + n) AS raw_text, {_key("nm || ' of ' || ty || ' per ' || (10000 + n) || ' ' || b || ' ' || root || CASE WHEN n % 2 = 0 THEN '.A' ELSE '' END")} AS bk FROM pt),
r0 AS (SELECT k, n, 'r' || m % 36 AS id, CASE WHEN n % 5 = 0 THEN ['gone' || n] WHEN n % 3 = 0 THEN ['e' || n, 'gone' || n, 'e' || (n // 40 * 40 + n * 7 % 40), 'e' || n] ELSE ['e' || n] END AS ids, 'Data of ' || nm AS title, 'Submit ' || nm AS requirement_text, ['product_data', 'shop_drawings', 'other'][n % 3 + 1] AS submittal_type,
  CASE n % 7 WHEN 0 THEN nm WHEN 1 THEN 'nothing of the kind' END AS category, CASE n % 6 WHEN 0 THEN 'of ' || ty WHEN 2 THEN 'only on mondays' WHEN 4 THEN '' END AS condition, CASE WHEN n % 8 = 0 THEN ['Section ' || (10000 + n), 'Section 99', 'Section 77777'] ELSE []::VARCHAR[] END AS refs,
  CASE n % 5 WHEN 1 THEN root WHEN 2 THEN '9.99' END AS source_clause FROM pt WHERE n % 4 = 0),
g0 AS (SELECT k, n, 'g' || m // 10 AS id, ['e' || n] AS ids, CASE WHEN n % 20 = 0 THEN b WHEN n % 30 = 10 THEN 'Unknown maker' ELSE nm END AS name, root AS code FROM pt WHERE n % 10 = 0),
p0 AS (SELECT k, n, 'p' || m AS id, ['e' || n] AS ids, CASE WHEN n % 9 = 0 THEN nm || ' (indoor use)' WHEN n % 9 = 3 THEN nm || ' (nuclear grade)' WHEN n % 9 < 3 THEN 'zzz gadget' ELSE nm END AS name, CASE n % 9 WHEN 1 THEN 'yyy' WHEN 3 THEN 'zzz gadget' WHEN 0 THEN 'zzz gadget' ELSE upper(nm) END AS normal,
  CASE n % 5 WHEN 0 THEN 'g' || m // 10 WHEN 1 THEN 'g9' WHEN 2 THEN '' END AS gid FROM pt WHERE n % 4 <> 0),
l0 AS (SELECT k, n, 'l' || m AS id, ['e' || n] AS ids, CASE WHEN n % 13 = 0 THEN 'r99' ELSE 'r' || n * 4 % 40 END AS rid, 'p' || n * 3 % 40 AS pid, ['explicit', 'normalized', 'inferred'][n % 3 + 1] AS method, CASE n % 4 WHEN 1 THEN 'of' WHEN 2 THEN 'no such phrase' WHEN 3 THEN '' END AS phrase,
  CASE WHEN n % 7 <> 3 THEN 0.75 END::DOUBLE AS conf, CASE WHEN n % 7 <> 0 THEN n % 2 = 0 END AS rev FROM pt),
{_cited("r", "r0")}, {_cited("g", "g0")}, {_cited("p", "p0")}, {_cited("l", "l0")},
gk AS (SELECT *, {_holds("blob", _key("name"))} AS ok FROM g_k), gs AS (SELECT * FROM gk WHERE ok),
pk AS (SELECT *, CASE WHEN {_holds("blob", _key("name"))} THEN 'name' WHEN {_holds("blob", _key("normal"))} THEN 'normalized_name' WHEN {_falls("name")} OR {_falls("normal")} THEN 'core_fallback' ELSE 'unsupported' END AS mode FROM p_k),
ps AS (SELECT pk.*, coalesce(gid, '') <> '' AND gs.id IS NULL AS dangling, CASE WHEN gs.id IS NOT NULL THEN gid END AS group_id FROM pk LEFT JOIN gs ON gs.k = pk.k AND gs.id = gid WHERE mode <> 'unsupported'),
rs AS (SELECT *, coalesce(source_clause, '') <> '' AND len(list_filter(clauses, lambda c: c = source_clause OR starts_with(c, source_clause || '.'))) = 0 AS bad_clause, coalesce(category, '') <> '' AND NOT {_holds("blob", _key("category"))} AS bad_category, coalesce(condition, '') <> '' AND NOT {_holds("blob", _key("condition"))} AS bad_condition,
  list_filter(refs, lambda f: contains(blob, {_key("f")}) OR len(list_filter(regexp_extract_all(f, '\\b[0-9]{{3,5}}\\b'), lambda d: contains(blob, d))) > 0) AS good_refs FROM r_k),
lm AS (SELECT l.*, rs.id AS r, ps.id AS p, rs.blob AS rb, ps.blob AS pb, {_key("coalesce(phrase, '')")} AS ph, coalesce(phrase, '') <> '' AS has, {_key("ps.name")} AS nn, {_key("ps.normal")} AS nl FROM l_k l LEFT JOIN rs ON rs.k = l.k AND rs.id = rid LEFT JOIN ps ON ps.k = l.k AND ps.id = pid),
la AS (SELECT *, has AND {_holds("rb", "ph")} AS p_req, has AND {_holds("blob", "ph")} AS p_link, (has AND {_holds("rb", "ph")}) OR {_holds("rb", "nn")} OR {_holds("rb", "nl")} AS a_req, (has AND {_holds("pb", "ph")}) OR {_holds("pb", "nn")} OR {_holds("pb", "nl")} AS a_prod, (has AND {_holds("blob", "ph")}) OR {_holds("blob", "nn")} OR {_holds("blob", "nl")} AS a_link
  FROM lm WHERE r IS NOT NULL AND p IS NOT NULL),
lf AS (SELECT *, CASE WHEN method = 'explicit' AND NOT CASE WHEN has THEN p_req ELSE a_req END THEN CASE WHEN a_req OR a_link THEN 'down' ELSE 'reject' END WHEN method = 'normalized' AND NOT a_req THEN 'down' ELSE 'keep' END AS fate FROM la),
li AS (SELECT *, CASE WHEN fate = 'down' THEN 'inferred' ELSE method END AS mm, CASE WHEN fate = 'down' THEN coalesce(conf, 0.5) ELSE conf END AS cc, CASE WHEN fate = 'down' THEN TRUE ELSE coalesce(rev, FALSE) END AS rr FROM lf WHERE fate <> 'reject'),
ls AS (SELECT *, rr OR mm = 'inferred' AS review FROM li WHERE mm <> 'inferred' OR (cc IS NOT NULL AND (a_req OR a_prod OR a_link)))"""


def _unknown(name: str, shown: str) -> str:
    return f"""SELECT k, 'error' AS severity, '{shown}' AS entity_type, id AS entity_id, 'duplicate_entity_id' AS code, 'Duplicate {shown} ID ''' || id || ''' rejected.' AS message FROM {name}_dup
UNION ALL SELECT k, 'error', '{shown}', id, 'unknown_evidence_id', 'Unknown evidence ID ''' || eid || ''' stripped.' FROM {name}_bad
UNION ALL SELECT k, 'error', '{shown}', id, 'no_valid_evidence', '{dict(requirement="Requirement", product_group="ProductGroup", product="Product", link="Link")[shown]} rejected: no valid evidence IDs remain.' FROM {name}_none"""


def _issue(severity: str, entity: str, code: str, message: str, rows: str) -> str:
    return f"SELECT k, '{severity}', '{entity}', id, '{code}', {message}, FROM {rows}".replace(", FROM", " FROM")


_ISSUES = " UNION ALL ".join([
    _unknown("r", "requirement"), _unknown("g", "product_group"), _unknown("p", "product"), _unknown("l", "link"),
    _issue("error", "product_group", "unsupported_group_name", "'ProductGroup name ''' || name || ''' not supported by cited evidence.'", "gk WHERE NOT ok"),
    _issue("error", "product", "unsupported_product_name", "'Product name/normalized_name not supported by cited evidence (name=''' || name || ''').'", "pk WHERE mode = 'unsupported'"),
    _issue("warning", "product", "product_name_qualifier_not_source_literal", "'Core product name ''' || regexp_extract(name, '^(.*?)\\s*\\(', 1) || ''' is supported; qualifier ''' || regexp_extract(name, '\\(([^()]+)\\)', 1) || ''' was treated as a display qualifier.'", "ps WHERE mode = 'core_fallback'"),
    _issue("warning", "product", "dangling_product_group_id", "'product_group_id ''' || gid || ''' is dangling; cleared to None.'", "ps WHERE dangling"),
    _issue("warning", "requirement", "unsupported_source_clause", "'source_clause ''' || source_clause || ''' not supported by cited evidence clauses.'", "rs WHERE bad_clause"),
    _issue("warning", "requirement", "unsupported_source_category", "'source_category ''' || category || ''' not clearly supported by cited evidence text/headings.'", "rs WHERE bad_category"),
    _issue("warning", "requirement", "unsupported_condition", "'condition ''' || condition || ''' not supported by cited evidence; cleared to None.'", "rs WHERE bad_condition"),
    _issue("warning", "requirement", "unsupported_cross_reference", "'cross_reference ''' || ref || ''' not found in cited evidence; stripped.'", "(SELECT *, unnest(list_filter(refs, lambda f: NOT list_contains(good_refs, f))) AS ref FROM rs)"),
    _issue("error", "link", "dangling_requirement_id", "'Link rejected: requirement_id ''' || rid || ''' does not exist in surviving requirements.'", "lm WHERE r IS NULL"),
    _issue("error", "link", "dangling_product_id", "'Link rejected: product_id ''' || pid || ''' does not exist in surviving products.'", "lm WHERE r IS NOT NULL AND p IS NULL"),
    _issue("warning", "link", "unsupported_source_phrase", "'source_phrase ''' || phrase || ''' not found in cited link/requirement evidence.'", "la WHERE has AND NOT p_link AND NOT p_req"),
    _issue("warning", "link", "mapping_downgraded", "CASE method WHEN 'explicit' THEN 'explicit unsupported' ELSE 'normalized incomplete' END || '; downgraded to inferred with review_required=True.'", "lf WHERE fate = 'down'"),
    _issue("error", "link", "unsupported_explicit_mapping", "'Link rejected: explicit mapping not source-supported.'", "lf WHERE fate = 'reject'"),
    _issue("warning", "link", "inferred_missing_review_required", "'inferred link missing review_required; set True.'", "li WHERE mm = 'inferred' AND NOT rr"),
    _issue("error", "link", "inferred_missing_confidence", "'Link rejected: inferred mapping requires confidence.'", "li WHERE mm = 'inferred' AND cc IS NULL"),
    _issue("error", "link", "unsupported_inferred_mapping", "'Link rejected: inferred mapping has no plausible evidence.'", "li WHERE mm = 'inferred' AND cc IS NOT NULL AND NOT (a_req OR a_prod OR a_link)"),
])


def _checked(spark: SparkSession, sf_dir: str) -> tuple[validate.Validated, DataFrame]:
    rows = cut(source(spark, sf_dir))
    return validate.validate(extraction(spark, sf_dir), rows), rows


@query(f"WITH {_VALID} SELECT k AS project_section_key, severity, entity_type, entity_id, code, message FROM ({_ISSUES})")
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What validation finds, rule by rule."""
    return _checked(spark, sf_dir)[0].issues.select("project_section_key", "severity", "entity_type", "entity_id", "code", "message")


@query(f"""
WITH {_VALID}
SELECT k AS project_section_key, 'requirement' AS entity_type, id, kept AS evidence_ids, concat_ws('|', title, coalesce(CASE WHEN NOT bad_condition THEN condition END, '-'), array_to_string(good_refs, ',')) AS said FROM rs
UNION ALL SELECT k, 'product_group', id, kept, name FROM gs UNION ALL SELECT k, 'product', id, kept, concat_ws('|', name, coalesce(CASE WHEN NOT dangling THEN gid END, '-')) FROM ps
UNION ALL SELECT k, 'link', id, kept, concat_ws('|', rid, pid, mm, coalesce((cc * 100)::INT::VARCHAR, '-'), review::VARCHAR) FROM ls""")
def validation_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that stand, as validation leaves them."""
    x = _checked(spark, sf_dir)[0].extraction
    one = lambda df, kind, *said: df.select("project_section_key", F.lit(kind).alias("entity_type"), "id", F.array_join("evidence_ids", ",").alias("evidence_ids"), F.concat_ws("|", *said).alias("said"))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    parts = [
        one(x.requirements, "requirement", "title", dash(F.col("condition")), F.array_join("cross_references", ",")), one(x.product_groups, "product_group", "name"), one(x.products, "product", "name", dash(F.col("product_group_id"))),
        one(x.links, "link", "requirement_id", "product_id", "mapping_method", dash((F.col("confidence") * 100).cast("int").cast("string")), F.col("review_required").cast("string")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""
WITH {_VALID}, i AS ({_ISSUES}), t AS (SELECT k, severity || ':' || code AS c, count(*) AS n FROM i GROUP BY ALL), w AS (SELECT k, string_agg(c || '=' || n, ',' ORDER BY c) AS counts, bool_or(c LIKE 'error%') AS bad FROM t GROUP BY k),
a AS (SELECT k, 'accepted' AS what, 0 AS e FROM rs UNION ALL SELECT k, 'accepted', 1 FROM gs UNION ALL SELECT k, 'accepted', 2 FROM ps UNION ALL SELECT k, 'accepted', 3 FROM ls
  UNION ALL SELECT k, 'rejected', CASE entity_type WHEN 'requirement' THEN 0 WHEN 'product_group' THEN 1 WHEN 'product' THEN 2 ELSE 3 END FROM i WHERE severity = 'error' AND code <> 'unknown_evidence_id'),
c AS (SELECT k, string_agg(x, ',' ORDER BY what, e) AS entities FROM (SELECT k, what, e, what || e || '=' || count(*) AS x FROM a GROUP BY k, what, e) GROUP BY k)
SELECT k AS project_section_key, NOT coalesce(bad, FALSE) AS valid, coalesce(counts, '') AS warning_counts, coalesce(entities, '') AS entities FROM (SELECT DISTINCT k FROM pt) LEFT JOIN w USING (k) LEFT JOIN c USING (k)""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each section: whether it is valid, entities accepted and rejected, issues by code."""
    v, rows = _checked(spark, sf_dir)
    told = validate.report(v, rows)
    pairs = lambda c: F.array_sort(F.map_entries(c))
    kinds = F.array(*(F.lit(x) for x in ("requirements", "product_groups", "products", "links")))
    entity = lambda c, what: F.filter(F.transform(kinds, lambda x, i: F.when(F.try_element_at(c, x) > 0, F.concat(F.lit(what), i, F.lit("="), F.try_element_at(c, x)))), lambda y: y.isNotNull())
    return told.select("project_section_key", "valid", F.array_join(F.transform(pairs("warning_counts"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("warning_counts"), F.array_join(F.concat(entity(F.col("accepted_counts"), "accepted"), entity(F.col("rejected_counts"), "rejected")), ",").alias("entities"))


@query(f"WITH {_VALID}, i AS ({_ISSUES}) SELECT k AS project_section_key, count(*) FILTER (severity = 'warning') AS validation_warning_count, count(*) FILTER (severity = 'error') AS validation_error_count FROM i GROUP BY k")
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings and errors of each section."""
    return present.issue_counts(_checked(spark, sf_dir)[0].issues)


@query(f"""
WITH {_VALID} SELECT k AS project_section_key, id AS link_id, method AS "from", 'inferred' AS "to", CASE method WHEN 'explicit' THEN 'explicit_not_supported' ELSE 'normalized_incomplete' END AS reason FROM lf WHERE fate = 'down'""")
def mapping_downgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose claimed mapping their evidence does not bear."""
    return _checked(spark, sf_dir)[0].downgrades.drop("ord")


@query(f"""
WITH {_VALID}, i AS ({_ISSUES}) SELECT i.k AS project_section_key, entity_type, entity_id, code AS reason, rid AS requirement_id, pid AS product_id FROM i LEFT JOIN l0 ON entity_type = 'link' AND l0.k = i.k AND l0.id = entity_id WHERE severity = 'error' AND code <> 'unknown_evidence_id'""")
def validation_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities that go, and why; links with their ends."""
    return _checked(spark, sf_dir)[0].rejected.drop("phase", "ord")


# --- views

_VIEW = f"""{_VALID},
go AS (SELECT gs.k, gs.id AS group_id, gs.name, row_number() OVER (PARTITION BY gs.k ORDER BY coalesce((SELECT min(pos) FROM src WHERE src.k = gs.k AND list_contains(string_split(kept, ','), eid)), 1000000000), gs.n) AS place FROM gs),
ca AS (SELECT rs.k, rs.id AS rid, ps.id AS pid, ps.n, ps.name, coalesce(go.group_id, '__ungrouped__') AS gid, coalesce(go.name, 'Other / Ungrouped') AS group_name, coalesce(place, 1000000000) AS place FROM rs JOIN ps ON ps.k = rs.k LEFT JOIN go ON go.k = ps.k AND go.group_id = CASE WHEN NOT ps.dangling THEN ps.gid END),
fl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, rid, pid ORDER BY n) AS rn FROM ls) WHERE rn = 1),
pairs AS (SELECT ca.*, fl.n AS link_n, fl.mm FROM ca LEFT JOIN fl ON fl.k = ca.k AND fl.rid = ca.rid AND fl.pid = ca.pid)"""


@query(f"""
WITH {_VIEW} SELECT k AS project_section_key, rid AS requirement_id, pid AS product_id, gid AS group_id, group_name, place::INT AS place, link_n IS NOT NULL AS suggested_for_requirement, mm AS mapping_method FROM pairs""")
def view_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every requirement with every product of its section, the linked ones marked."""
    v, rows = _checked(spark, sf_dir)
    return present.catalogue(v.extraction, rows).select("project_section_key", "requirement_id", "product_id", "group_id", "group_name", "place", "suggested_for_requirement", "mapping_method")


@query(f"""
WITH {_VIEW}, sh AS (SELECT rs.k, rs.id AS rid, g.* EXCLUDE (k) FROM rs JOIN (SELECT k, group_id, place FROM go UNION ALL SELECT DISTINCT k, '__ungrouped__', 1000000000 FROM rs) g ON g.k = rs.k),
me AS (SELECT k, rid, gid, string_agg(pid, '+' ORDER BY n) AS members, count(*) AS total, count(link_n) AS hits FROM pairs GROUP BY ALL),
ne AS (SELECT sh.k, sh.rid, string_agg(group_id || ':' || coalesce(total, 0) || ':' || coalesce(hits, 0) || ':' || coalesce(members, ''), ',' ORDER BY place) AS groups FROM sh LEFT JOIN me ON me.k = sh.k AND me.rid = sh.rid AND me.gid = sh.group_id GROUP BY ALL),
hi AS (SELECT k, rid, string_agg(pid, ',' ORDER BY link_n) AS ids, count(*) AS n FROM pairs WHERE link_n IS NOT NULL GROUP BY ALL), av AS (SELECT k, count(*) AS n FROM ps GROUP BY k)
SELECT rs.k AS project_section_key, rs.id AS requirement_id, coalesce(hi.ids, '') AS suggested_product_ids, coalesce(hi.n, 0)::INT AS suggested_product_count, coalesce(av.n, 0) AS available_product_count, groups FROM rs LEFT JOIN hi ON hi.k = rs.k AND hi.rid = rs.id LEFT JOIN av ON av.k = rs.k LEFT JOIN ne ON ne.k = rs.k AND ne.rid = rs.id""")
def view_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements with the groups and products of their section nested in order."""
    v, rows = _checked(spark, sf_dir)
    view = present.section_view(v.extraction, rows)
    group = lambda g: F.concat_ws(":", g["group_id"], g["total_products"], g["suggested_products"], F.array_join(F.transform(g["products"], lambda p: p["product_id"]), "+"))
    return view.select("project_section_key", "requirement_id", F.array_join("suggested_product_ids", ",").alias("suggested_product_ids"), "suggested_product_count", "available_product_count", F.array_join(F.transform("product_groups", group), ",").alias("groups"))


@query(f"""
WITH {_VIEW}, c AS (SELECT rs.k, rs.n, rs.id, (SELECT count(*) FROM pairs p WHERE p.k = rs.k AND p.rid = rs.id AND link_n IS NOT NULL) AS hits FROM rs)
SELECT k AS project_section_key, id AS requirement_id, 'suggested_product_count mismatch' AS failure FROM c WHERE n % 3 = 0 UNION ALL SELECT k, id, 'available_product_count mismatch' FROM c WHERE n % 5 = 1
UNION ALL SELECT k, id, 'suggested flags != suggested_product_ids' FROM c WHERE n % 7 = 2 AND hits > 0 UNION ALL SELECT ls.k, rid, 'link ' || ls.id || ': not in suggested_product_ids' FROM ls JOIN rs ON rs.k = ls.k AND rs.id = rid WHERE rs.n % 7 = 2""")
def view_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not add up in views of which some were tampered with."""
    v, rows = _checked(spark, sf_dir)
    view, n = present.section_view(v.extraction, rows), F.col("ord")
    none = F.array().cast("array<string>")
    ids = F.when(n % 7 == 2, none).otherwise(F.col("suggested_product_ids"))
    bad = view.withColumns({"available_product_count": F.col("available_product_count") + (n % 5 == 1).cast("int"), "suggested_product_ids": ids, "suggested_product_count": F.size(ids) + (n % 3 == 0).cast("int")})
    return present.consistency(v.extraction, bad)


@query(f"""
WITH {_VALID}, x AS (SELECT k, 'requirement' AS entity_type, n, id, title AS title, kept FROM rs UNION ALL SELECT k, 'product', n, id, name, kept FROM ps UNION ALL SELECT k, 'product_group', n, id, name, kept FROM gs),
c AS (SELECT k, entity_type, id, unnest(string_split(kept, ',')) AS eid, generate_subscripts(string_split(kept, ','), 1) AS i FROM x), f AS (SELECT c.k, entity_type, id, clause, min(i) AS i FROM c JOIN src ON src.k = c.k AND src.eid = c.eid GROUP BY ALL),
a AS (SELECT k, entity_type, id, string_agg(clause, '|' ORDER BY i) AS clauses FROM f GROUP BY ALL)
SELECT x.k AS project_section_key, entity_type, x.id AS entity_id, title, kept AS evidence_ids, clauses FROM x JOIN a USING (k, entity_type, id)""")
def view_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a review opens for each entity."""
    v, rows = _checked(spark, sf_dir)
    return present.review_targets(v.extraction, rows).withColumns({"evidence_ids": F.array_join("evidence_ids", ","), "clauses": F.array_join("clauses", "|")})


@query(f"""
WITH {_VALID} SELECT k AS project_section_key, coalesce(nullif(source_clause, ''), '(none)') AS clause, count(*) AS n FROM rs GROUP BY ALL""")
def view_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of each clause."""
    return present.per_clause(_checked(spark, sf_dir)[0].extraction.requirements)


@query(f"""
WITH {_VIEW} SELECT k AS project_section_key, 'r' AS kind, id FROM rs WHERE contains(lower(concat_ws(' ', title, coalesce(source_clause, ''), replace(submittal_type, '_', ' '), requirement_text, coalesce(category, ''))), 'shop drawings')
UNION ALL SELECT k, 'p', rid || '/' || pid FROM pairs WHERE contains(lower(group_name), 'brand#1') OR contains(lower(name), 'brand#1')""")
def view_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches among requirements, and among products with their groups."""
    v, rows = _checked(spark, sf_dir)
    asked = present.search_requirements(v.extraction.requirements, "Shop Drawings").select("project_section_key", F.lit("r").alias("kind"), "id")
    found = present.search_products(present.catalogue(v.extraction, rows), " Brand#1 ").select("project_section_key", F.lit("p").alias("kind"), F.concat_ws("/", "requirement_id", "product_id").alias("id"))
    return asked.unionByName(found)


@query("""
WITH s AS (SELECT c_custkey AS n, ['p' || c_custkey % 5] AS confirmed, CASE WHEN c_custkey % 3 = 0 THEN ['p1', 'p2'] END AS stored, ['p2', 'p7'] AS proposed, c_custkey % 4 > 1 AS has, c_custkey % 2 = 0 AS "on" FROM customer),
t AS (SELECT n, CASE WHEN has THEN confirmed WHEN stored IS NOT NULL THEN stored ELSE proposed END AS chosen, proposed, "on" FROM s)
SELECT n AS c_custkey, array_to_string(chosen, ',') AS seeded, array_to_string(list_sort(CASE WHEN "on" THEN list_distinct(chosen || ['p2', 'p9']) ELSE list_filter(chosen, lambda x: x NOT IN ('p2', 'p9')) END), ',') AS toggled,
  CASE WHEN list_contains(proposed, 'p' || n % 8) THEN 'AI Suggested' WHEN list_contains(chosen, 'p' || n % 8) THEN 'Selected manually' ELSE 'Available' END AS status FROM t""")
def view_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is ticked at first, after a click on a group, and how a product is labelled."""
    n = F.col("c_custkey")
    names = lambda *x: F.array(*(F.lit(y) for y in x))
    own = F.concat(F.lit("p"), n % 5)
    confirmed = F.when(n % 4 > 1, F.array(own)).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", present.seed_selection(confirmed, F.when(n % 3 == 0, names("p1", "p2")), names("p2", "p7")).alias("chosen"))
    this = F.concat(F.lit("p"), n % 8)
    status = present.status_label(F.array_contains(names("p2", "p7"), this), F.array_contains("chosen", this))
    return rows.select("c_custkey", F.array_join("chosen", ",").alias("seeded"), F.array_join(F.array_sort(present.toggle_group(F.col("chosen"), names("p2", "p9"), n % 2 == 0)), ",").alias("toggled"), status.alias("status"))


@query(f"""
WITH {_VALID}, c AS (SELECT k, n, id, unnest(ids) AS eid, generate_subscripts(ids, 1) AS i FROM r0), d AS (SELECT eid, min(n * 10 + i) AS ord FROM c GROUP BY eid)
SELECT eid AS evidence_id, s.raw_text, s.clause AS source_clause, s.eid IS NULL AS missing FROM (SELECT d.eid, src.eid AS hit FROM d LEFT JOIN src ON src.eid = d.eid) x LEFT JOIN src s ON s.eid = hit""".replace("SELECT eid AS evidence_id, s.raw_text", "SELECT x.eid AS evidence_id, coalesce(s.raw_text, '') AS raw_text"))
def review_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence that the requirements of all sections cite, and the ids without any."""
    asked = extraction(spark, sf_dir).requirements
    ids = asked.select(F.posexplode("evidence_ids").alias("i", "evidence_id"), (F.col("ord") * 10).alias("o")).select("evidence_id", (F.col("o") + F.col("i")).alias("ord"))
    return E.highlights(ids, source(spark, sf_dir)).select("evidence_id", "raw_text", "source_clause", "missing")


@query(f"""
WITH {_VALID}, c AS (SELECT DISTINCT unnest(ids) AS eid FROM r0 WHERE n % 8 = 0) SELECT src.eid AS id, k AS project_section_key, pos::INT AS pos, raw_text FROM src JOIN c ON c.eid = src.eid""")
def evidence_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence that a scope names: what every other requirement cites and is there."""
    rows = cut(source(spark, sf_dir))
    asked = extraction(spark, sf_dir).requirements.where("ord % 8 = 0").select(F.explode("evidence_ids").alias("evidence_id"), "ord")
    there = asked.join(rows.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi")
    return E.scope(rows, there).select("id", "project_section_key", "pos", "raw_text")


# --- projects and exports


def _sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sections, statuses): a section per forty parts, in documents of seven."""
    n = F.col("n")
    rows = _parts(spark, sf_dir).where(F.col("m") == 0).select(F.floor(F.col("n") / 40).cast("int").alias("n"))
    doc = F.concat(F.lit("d"), n % 7)
    sections = rows.select(
        F.concat(F.lit("k"), n).alias("key"), doc.alias("document_id"), F.concat(doc, F.lit("|.pdf")).alias("filename"), F.concat(F.lit("s"), n).alias("section_id"), (15000 + n * 37 % 91).cast("string").alias("section_number"),
        F.when(n % 4 != 0, F.concat(F.lit("TITLE "), n)).alias("section_title"), (n % 11 + 1).alias("start_page"), (n % 11 + 3).alias("end_page"), F.lit(40).cast("long").alias("evidence_count"), n.alias("ord"),
    )
    status = F.element_at(F.array(*(F.lit(s) for s in ("completed", "no_submittals", "failed", "completed", "processing"))), n % 5 + 1)
    return sections, rows.where(n % 6 != 5).select(F.concat(F.lit("k"), n).alias("key"), status.alias("status"))


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requirements, products, confirmed) without validation; ids are unique within a section."""
    n = F.col("n")
    rows = _parts(spark, sf_dir).withColumn("key", F.col("project_section_key"))
    clause = F.when(n % 8 != 0, F.col("root")).otherwise("")
    kind = F.element_at(F.array(*map(F.lit, ("product_data", "shop_drawings", "other"))), (n % 3 + 1).cast("int"))
    views = rows.where(n % 4 == 0).select("key", F.concat(F.lit("r"), "m").alias("requirement_id"), F.lit("s").alias("spec_section_id"), clause.alias("source_clause"), kind.alias("submittal_type"), F.concat(F.lit("Data | "), "nm").alias("title"), F.array("e").alias("evidence_ids"), "ord", (n % 9).alias("available_product_count"), (n % 5).cast("int").alias("suggested_product_count"))
    products = rows.select("key", F.concat(F.lit("p"), "m").alias("product_id"), F.when(F.col("m") % 10 != 7, F.col("nm")).otherwise("").alias("name"))
    ids = F.array(F.concat(F.lit("p"), (n + 3) % 40), F.concat(F.lit("p"), (n + 7) % 40), F.lit("p99"), F.concat(F.lit("p"), n * 3 % 40))
    return views, products, rows.where(n % 8 == 0).select("key", F.concat(F.lit("r"), "m").alias("requirement_id"), ids.alias("product_ids"))


_PROJECT = """
pt AS (SELECT p_partkey AS n, p_name AS nm, p_partkey // 40 AS s, p_partkey % 40 AS m, (1 + p_partkey % 3) || '.0' || (1 + p_partkey % 8) AS root FROM part),
sec AS (SELECT DISTINCT s, 'k' || s AS k, 'd' || s % 7 AS d, 'd' || s % 7 || '|.pdf' AS filename, (15000 + s * 37 % 91)::VARCHAR AS number, CASE WHEN s % 4 <> 0 THEN 'TITLE ' || s END AS title, (s % 11 + 1)::INT AS page, CASE WHEN s % 6 = 5 THEN 'not_processed' ELSE ['completed', 'no_submittals', 'failed', 'completed', 'processing'][s % 5 + 1] END AS status FROM pt),
rk AS (SELECT *, min(s) OVER (PARTITION BY d)::INT AS doc_rank FROM sec),
rq AS (SELECT 'k' || s AS k, n, 'r' || m AS id, CASE WHEN n % 8 <> 0 THEN root ELSE '' END AS clause, ['Product Data', 'Shop Drawings', 'Other'][n % 3 + 1] AS kind, ['product_data', 'shop_drawings', 'other'][n % 3 + 1] AS type, 'Data | ' || nm AS title, CASE WHEN n % 8 = 0 THEN ['p' || (n + 3) % 40, 'p' || (n + 7) % 40, 'p99', 'p' || n * 3 % 40] END AS chosen FROM pt WHERE n % 4 = 0),
pr AS (SELECT 'k' || s AS k, 'p' || m AS id, CASE WHEN m % 10 <> 7 THEN nm ELSE '' END AS name FROM pt),
pc AS (SELECT rq.k, rq.n, rq.id, i, pid, pr.id AS hit, name FROM (SELECT k, n, id, unnest(chosen) AS pid, generate_subscripts(chosen, 1) AS i FROM rq) rq LEFT JOIN pr ON pr.k = rq.k AND pr.id = pid),
nm AS (SELECT k, id, list(name ORDER BY i) FILTER (coalesce(name, '') <> '') AS names FROM pc GROUP BY ALL),
ch AS (SELECT rq.*, list(pid ORDER BY i) FILTER (hit IS NOT NULL) AS ids, list(name ORDER BY i) FILTER (hit IS NOT NULL) AS product_names FROM rq LEFT JOIN pc USING (k, n, id) GROUP BY ALL),
dr AS (SELECT k, n, id, clause, kind, title, 'combined' AS mode, 0 AS item, coalesce(ids, []::VARCHAR[]) AS ids, coalesce(product_names, []::VARCHAR[]) AS names FROM ch WHERE n % 16 = 0 UNION ALL
  SELECT k, n, id, clause, kind, title || ' - ' || product_names[i], 'one_per_product', i - 1, [ids[i]], [product_names[i]] FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM ch WHERE n % 16 = 8)),
df AS (SELECT *, 'draft_' || substr(sha1(concat_ws('|', k, id, mode, CASE WHEN len(ids) > 0 THEN array_to_string(list_sort(ids), '|') END)), 1, 12) AS draft_id FROM dr),
rows AS (SELECT doc_rank, page AS start_page, filename AS source_file, rk.k, number AS spec_section, rk.title AS spec_title, clause AS source_clause, kind AS submittal_type, rq.title AS submittal_title, coalesce(names, []::VARCHAR[]) AS products, CASE WHEN names IS NULL THEN 'Available / Not Reviewed' ELSE 'Included' END AS products_status,
    'Extracted Requirement' AS row_kind, rq.id AS requirement_id, NULL AS draft_id, 0 AS kind, n, 0 AS item FROM rk JOIN rq ON rq.k = rk.k LEFT JOIN nm ON nm.k = rq.k AND nm.id = rq.id WHERE status = 'completed'
  UNION ALL SELECT doc_rank, page, filename, rk.k, number, rk.title, clause, df.kind, df.title, names, 'Included', 'Created Submittal', df.id, draft_id, 1, n, item FROM rk JOIN df ON df.k = rk.k WHERE status = 'completed')"""


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    views, products, confirmed = _asked(spark, sf_dir)
    chosen = packaging.choose(views, confirmed, products)
    both = packaging.drafts(chosen.where("ord % 16 = 0"), "combined").unionByName(packaging.drafts(chosen.where("ord % 16 = 8"), "one_per_product"))
    return both.join(views.select("key", "requirement_id", "ord"), ["key", "requirement_id"])


def _bundle(spark: SparkSession, sf_dir: str) -> export.Bundle:
    views, products, confirmed = _asked(spark, sf_dir)
    return export.build(*(lambda s: (s[0], views, products, s[1]))(_sections(spark, sf_dir)), confirmed, _drafts(spark, sf_dir))


@query(f"""
WITH {_PROJECT} SELECT doc_rank, start_page, source_file, k AS project_section_key, spec_section, spec_title, source_clause, submittal_type, submittal_title, array_to_string(products, ';') AS products, len(products)::INT AS product_count, products_status, row_kind, requirement_id, draft_id, item::INT AS item FROM rows""")
def register_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a register: requirements of completed sections with their confirmed products, then drafts."""
    rows = _bundle(spark, sf_dir).rows
    return rows.withColumn("products", F.array_join("products", ";")).drop("kind", "ord")


@query(f"""
WITH {_PROJECT}, c AS (SELECT *, array_to_string(products, '; ') AS said FROM rows), e AS (SELECT *, [source_file, spec_section, submittal_type, submittal_title, CASE WHEN said = '' THEN '—' ELSE said END, CASE WHEN source_clause = '' THEN '—' ELSE source_clause END, products_status, row_kind] AS cells FROM c)
SELECT k AS project_section_key, requirement_id, coalesce(draft_id, '') AS draft_id, '| ' || array_to_string(list_transform(cells, lambda x: replace(x, '|', '\\|')), ' | ') || ' |' AS line FROM e""")
def register_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register's lines as Markdown."""
    rows = _bundle(spark, sf_dir).rows
    lines = export.markdown_rows(rows).select("project_section_key", F.col("kind").alias("_k"), F.col("ord").alias("_o"), F.col("item").alias("_i"), "line")
    named = rows.select("project_section_key", F.col("kind").alias("_k"), F.col("ord").alias("_o"), F.col("item").alias("_i"), "requirement_id", F.coalesce("draft_id", F.lit("")).alias("draft_id"))
    return named.join(lines, ["project_section_key", "_k", "_o", "_i"]).select("project_section_key", "requirement_id", "draft_id", "line")


@query(f"""
WITH {_PROJECT} SELECT count(DISTINCT d) AS uploaded_file_count, count(*) AS detected_section_count, count(*) FILTER (status IN ('completed', 'no_submittals', 'failed')) AS processed_section_count, count(*) FILTER (status = 'completed') AS completed_count, count(*) FILTER (status = 'no_submittals') AS no_submittals_count,
  count(*) FILTER (status = 'failed') AS failed_count, count(*) FILTER (status IN ('not_processed', 'processing')) AS not_processed_count, (SELECT count(*) FROM rows) AS exported_register_row_count FROM sec""")
def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of a project: sections by status and rows exported."""
    return _bundle(spark, sf_dir).summary


@query(f"""
WITH {_PROJECT} SELECT doc_rank, page AS start_page, number AS spec_section, k AS project_section_key, number || ' — ' || coalesce(title, 'Untitled') || ' — ' || replace(status, '_', ' ') AS line FROM rk""")
def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line on the processing of each section."""
    return _bundle(spark, sf_dir).status_lines


@query(f"""
WITH {_PROJECT} SELECT k AS project_section_key, id AS requirement_id, mode AS packaging_mode, item::INT AS item, title, array_to_string(ids, ',') AS product_ids, array_to_string(names, ',') AS product_names, draft_id AS id FROM df""")
def draft_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts of the products chosen for requirements, all in one or one for each."""
    return _drafts(spark, sf_dir).select("project_section_key", "requirement_id", "packaging_mode", "item", "title", F.array_join("product_ids", ",").alias("product_ids"), F.array_join("product_names", ",").alias("product_names"), "id")


@query(f"""
WITH {_PROJECT}, old AS (SELECT DISTINCT draft_id FROM df WHERE n % 3 = 0) SELECT (SELECT count(*) FROM df WHERE n % 3 = 0) + (SELECT count(DISTINCT draft_id) FROM df WHERE draft_id NOT IN (SELECT draft_id FROM old)) AS n_all, (SELECT count(DISTINCT draft_id) FROM df WHERE draft_id NOT IN (SELECT draft_id FROM old)) AS n_added""")
def draft_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts added to those that are there, each id once."""
    drafts = cut(_drafts(spark, sf_dir))
    every, added = packaging.merge(drafts.where("ord % 3 = 0"), drafts)
    return every.agg(F.count("*").alias("n_all")).crossJoin(added.agg(F.count("*").alias("n_added")))


@query(f"""
WITH {_PROJECT} SELECT rk.k AS project_section_key, d AS document_id, number AS section_number, rq.id AS requirement_id, type AS submittal_type, rq.title, (n % 9) AS available_product_count, (n % 5)::INT AS suggested_product_count, coalesce(len(chosen), 0)::INT AS confirmed_product_count
FROM rk JOIN rq ON rq.k = rk.k WHERE status IN ('completed', 'no_submittals')""")
def project_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requirements of processed sections over a project."""
    views, _, confirmed = _asked(spark, sf_dir)
    sections, statuses = _sections(spark, sf_dir)
    return project.register(sections, views, statuses, confirmed).drop("filename", "section_title", "source_clause")


@query(f"""
WITH {_PROJECT}, x AS (SELECT * FROM sec WHERE s % 6 <> 5 AND status IN ('completed', 'no_submittals')) SELECT (SELECT count(*) FROM x) AS processed_section_count, (SELECT count(*) FROM x JOIN rq USING (k)) AS requirement_count, (SELECT count(*) FROM x JOIN rq USING (k) WHERE number = '15037') AS of_one_number""")
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections and requirements of a project, and those of one section number."""
    views, _, confirmed = _asked(spark, sf_dir)
    sections, statuses = _sections(spark, sf_dir)
    rows = project.register(sections, views, statuses, confirmed)
    one = project.filter_register(rows, "15037").agg(F.count("*").alias("of_one_number"))
    return project.register_counts(sections, rows, statuses).crossJoin(one)


@query("""
WITH o AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_name || CASE WHEN c_custkey % 3 = 0 THEN '.PDF' ELSE '.docx' END END AS f, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment || c_custkey % 50 END AS content, c_custkey % 5 <> 0 AS parsed FROM customer),
u AS (SELECT n, coalesce(nullif(f, ''), 'document.pdf') AS f, content, parsed FROM o), g AS (SELECT *, 'doc_' || substr(sha256(coalesce(content, f)), 1, 16) AS d FROM u WHERE parsed AND (content IS NOT NULL OR lower(f) LIKE '%.pdf')),
l AS (SELECT d, arg_max(f, n) AS said FROM g GROUP BY d),
w AS (SELECT f || ': ' || CASE WHEN NOT parsed THEN 'missing DoclingDocument' WHEN lower(f) NOT LIKE '%.pdf' THEN 'skipped (not a PDF)' ELSE 'missing pdf_bytes; skipped for Specs Review PDF' END AS said FROM u WHERE NOT parsed OR content IS NULL)
SELECT d AS id, said FROM l UNION ALL SELECT 'warning', said FROM w""")
def project_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads as documents, the last of each content, and the warnings about the others."""
    n = F.col("c_custkey")
    name = F.when(n % 11 == 0, "").otherwise(F.concat("c_name", F.when(n % 3 == 0, ".PDF").otherwise(".docx")))
    content = F.when(n % 4 != 0, F.concat("c_mktsegment", n % 50).cast("binary"))
    rows = table(spark, sf_dir, "customer").select(n.alias("ord"), name.alias("filename"), content.alias("content"), F.when(n % 5 != 0, F.array(F.lit(1))).alias("items"))
    documents, warnings = project.split_uploads(rows)
    return documents.select(F.col("document_id").alias("id"), F.col("filename").alias("said")).unionByName(warnings.select(F.lit("warning").alias("id"), F.col("warning").alias("said")))


@query("SELECT s_suppkey, 'd' || s_suppkey || '::a::' || s_nationkey AS key, 'd' || s_suppkey AS document_id, 'a::' || s_nationkey AS section_id FROM supplier")
def project_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of sections, made and taken apart."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", project.section_key(F.concat(F.lit("d"), "s_suppkey"), F.concat(F.lit("a::"), "s_nationkey")).alias("key"))
    return rows.select("s_suppkey", "key", project.parse_key(F.col("key")).alias("p")).select("s_suppkey", "key", "p.*")


@query("""
WITH i AS (SELECT l_partkey || '/' || l_suppkey AS item, list_sort(list(DISTINCT l_returnflag)) AS runs FROM lineitem GROUP BY ALL), t AS (SELECT count(DISTINCT l_returnflag) AS total FROM lineitem)
SELECT item, array_to_string(runs, ',') AS runs, len(runs)::INT AS n_runs, len(runs) = total AS always FROM i, t""")
def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which of several runs the items were found."""
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), F.concat_ws("/", "l_partkey", "l_suppkey").alias("item"))
    return project.stability(runs).withColumn("runs", F.array_join("runs", ","))


@query("""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders),
u AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT f.o_custkey AS id, coalesce(u.o_orderkey, f.o_orderkey) AS o_orderkey, coalesce(u.o_orderpriority, f.o_orderpriority) AS o_orderpriority FROM f LEFT JOIN u ON u.o_custkey = f.o_custkey AND u.rn = 1 WHERE f.rn = 1""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed store after four upserts: first orders of customers in two parts, one of them again, and their last urgent orders in place of those."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderpriority", "o_orderdate", (-F.col("o_orderkey")).alias("last"))
    path, early = scratch(spark, "store"), F.col("o_orderdate") < "1995-01-01"
    store.create(spark, path, rows.select("id", "o_orderkey", "o_orderpriority").schema, buckets=8)
    for number, part in enumerate((rows.where(early), rows, rows.where(early))):
        store.upsert(part, path, ["o_orderdate", "o_orderkey"], writer="orders", batch=min(number, 1))
    store.upsert(rows.where("o_orderpriority = '1-URGENT'"), path, ["last"], replace=True)
    return store.read(spark, path)
