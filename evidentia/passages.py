"""Queries of chunks, searches, structure, prompts and text functions, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia import schemas
from evidentia.catalog import query, table
from evidentia.functions import predicates as P
from evidentia.functions import search
from evidentia.functions import text as X
from evidentia.operators import chunker, chunks, evidence, vector
from evidentia.sources import files, plugins


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as chunks: some numbered headings, some plain ones, some none; short texts in between."""
    t, c = F.col("turn"), F.col("conv_id")
    head = (
        F.when((t + c) % 5 == 0, F.array(F.concat(F.lit("1.0"), t % 9, F.lit(" FANS")), F.lit("Deep")))
        .when((t + c) % 5 == 1, F.array(F.lit("Plain "), F.lit(" ")))
        .when((t + c) % 5 == 2, F.array(F.when(c % 3 == 0, "Manufacturers").otherwise("Parts of it")))
    )
    said = F.when((t + c) % 3 == 0, F.col("text")).when((t + c) % 7 == 1, " ").otherwise(F.concat(F.lit(" line "), t))
    rows = table(spark, sf_dir, "conversations").select(c.alias("document_id"), t.alias("pos"), said.alias("raw_text"), head.alias("headings"))
    given = F.when(F.col("pos") % 2 == 0, F.concat_ws("\n", X.headings_list("headings"), F.col("raw_text"))).otherwise("")
    return rows.withColumn("contextualized", given).withColumns({"filename": F.concat(F.lit("f"), "document_id"), "file_type": F.lit(None).cast("string"), "labels": F.array(F.lit("text"), F.lit(None), F.lit("list"), F.lit("text")), "pages": F.array(F.lit(None).cast("int"), F.col("pos").cast("int"))})


# The same, run through turn by turn: the last path, the short lines, the headings that they belong to.
_STRIP = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
_JOIN = "array_to_string(list_filter({l}, lambda x, i: i = 1 OR x <> {l}[i - 1]), chr(10))"


def _joined(parts: str) -> str:
    """Parts stripped, blanks and repeats of the one before dropped."""
    stripped = f"list_filter(list_transform({parts}, lambda y: {_STRIP.format(x='y')}), lambda y: y <> '')"
    return _JOIN.replace("{l}", stripped)


_NUM = "list_filter({x}, lambda h: regexp_matches(h, '^[0-9]+[.][0-9]+'))"
_ENRICHED = f"""
c0 AS (SELECT conv_id AS d, turn AS pos, given, {_STRIP.format(x="given")} AS raw,
  CASE (turn + conv_id) % 5 WHEN 0 THEN ['1.0' || turn % 9 || ' FANS', 'Deep'] WHEN 1 THEN ['Plain'] WHEN 2 THEN [CASE WHEN conv_id % 3 = 0 THEN 'Manufacturers' ELSE 'Parts of it' END] ELSE []::VARCHAR[] END AS h FROM (SELECT *, CASE WHEN (turn + conv_id) % 3 = 0 THEN text WHEN (turn + conv_id) % 7 = 1 THEN ' ' ELSE ' line ' || turn END AS given FROM conversations)),
c1 AS (SELECT *, CASE WHEN pos % 2 = 0 AND len(h) > 0 THEN array_to_string(h, chr(10)) || chr(10) || given ELSE raw END AS said, row_number() OVER (PARTITION BY d ORDER BY pos) AS no FROM c0 WHERE raw <> ''),
f AS (SELECT DISTINCT d, 0::BIGINT AS no, -1::BIGINT AS pos, '' AS raw, '' AS said, []::VARCHAR[] AS path, []::VARCHAR[] AS known, []::VARCHAR[] AS held, []::VARCHAR[] AS lines FROM c1 UNION ALL
  SELECT d, no, pos, raw, said, path, known, CASE WHEN {_NUM.format(x="path")} <> {_NUM.format(x="known")} THEN []::VARCHAR[] ELSE lines END,
    CASE WHEN length(raw) < 100 THEN (CASE WHEN {_NUM.format(x="path")} <> {_NUM.format(x="known")} THEN [raw] ELSE list_append(lines, raw) END)[-5:] ELSE CASE WHEN {_NUM.format(x="path")} <> {_NUM.format(x="known")} THEN []::VARCHAR[] ELSE lines END END
  FROM (SELECT c1.d, c1.no, c1.pos, c1.raw, c1.said, f.path AS known, f.lines, CASE WHEN len(h) = 0 THEN f.path WHEN len({_NUM.format(x="h")}) > 0 OR len({_NUM.format(x="f.path")}) = 0 THEN h
    ELSE list_filter(f.path, lambda x, i: i <= list_position(f.path, {_NUM.format(x="f.path")}[-1])) || list_filter(h, lambda x: NOT list_contains(list_filter(f.path, lambda y, i: i <= list_position(f.path, {_NUM.format(x="f.path")}[-1])), x)) END AS path
    FROM f JOIN c1 ON c1.d = f.d AND c1.no = f.no + 1)),
e0 AS (SELECT *, array_to_string(path, chr(10)) AS block, len(list_filter(path, lambda x: NOT contains(said, x))) > 0 AS lacks FROM f WHERE no > 0),
s1 AS (SELECT *, CASE WHEN path[1] IS NOT NULL AND starts_with(said, path[1]) THEN ltrim(substr(said, length(path[1]) + 1), chr(10)) ELSE said END AS b1 FROM e0),
s2 AS (SELECT *, CASE WHEN path[2] IS NOT NULL AND starts_with(b1, path[2]) THEN ltrim(substr(b1, length(path[2]) + 1), chr(10)) ELSE b1 END AS b2 FROM s1),
s3 AS (SELECT *, CASE WHEN path[3] IS NOT NULL AND starts_with(b2, path[3]) THEN ltrim(substr(b2, length(path[3]) + 1), chr(10)) ELSE b2 END AS b3 FROM s2),
e1 AS (SELECT *, CASE WHEN lacks THEN {_joined("[block, b3]")} ELSE said END AS body FROM s3),
e2 AS (SELECT *, CASE WHEN length(raw) < 100 AND NOT list_contains(path, 'Manufacturers') THEN list_filter(held, lambda x: NOT contains(body, x))[-2:] ELSE []::VARCHAR[] END AS added FROM e1),
e3 AS (SELECT *, {_joined("added")} AS support FROM e2),
enriched AS (SELECT d, pos, raw, path, support, CASE WHEN len(added) = 0 THEN body WHEN contains(body, raw) THEN {_joined("[substr(body, 1, length(body) - strpos(reverse(body), reverse(raw)) - length(raw) + 1), support, raw]")} ELSE {_joined("[block, support, body]")} END AS content, lacks OR len(added) > 0 AS enriched FROM e3)"""


@query(f"""
WITH RECURSIVE {_ENRICHED} SELECT d AS conv_id, pos AS turn, array_to_string(path, ' > ') AS path, enriched AS was_enriched, content AS page_content, support AS supporting_context FROM enriched""")
def chunk_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with headings carried and repaired, and context put into their text; the twin goes turn by turn."""
    out = chunks.enrich(_chunks(spark, sf_dir))
    return out.select(F.col("document_id").alias("conv_id"), F.col("pos").alias("turn"), F.array_join("effective", " > ").alias("path"), "was_enriched", "page_content", "supporting_context")


@query(f"""
WITH RECURSIVE {_ENRICHED} SELECT (row_number() OVER (ORDER BY d, pos) - 1)::INT AS chunk_id, 'f' || d AS filename, 'f' || d AS source, '' AS file_type, array_to_string(path, ' > ') AS headings, 'text | list' AS labels, substr(content, 1, 500) AS contextualized_preview, pos::INT AS page FROM enriched""")
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks as they go to the index, numbered over all documents."""
    return chunks.build_chunks(_chunks(spark, sf_dir)).drop("page_content", "raw_text", "supporting_context", "was_enriched")


@query(f"""
WITH RECURSIVE {_ENRICHED} SELECT d AS document_id, pos FROM enriched WHERE enriched AND (contains(lower(raw), 'line 1') OR contains(lower(content), 'line 1'))""")
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enriched chunks that hold a query."""
    from evidentia.operators.present import search_chunks

    return search_chunks(chunks.enrich(_chunks(spark, sf_dir)), "LINE 1", enriched_only=True).select("document_id", "pos")


@query("""
WITH t AS (SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER w AS heading FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, coalesce(sha256(heading), '') AS heading FROM t""")
def heading_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known heading, carried on, as a digest of its whole text."""
    turns = table(spark, sf_dir, "conversations").withColumn("headings", F.when(F.col("role") == "user", F.array("text")).otherwise(F.array().cast("array<string>")))
    return chunks.carry_headings(turns, "conv_id", "turn").select("conv_id", "turn", F.coalesce(F.sha2(F.get("effective", 0), 256), F.lit("")).alias("heading"))


_HITS = """
u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), v AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM u),
d AS (SELECT q.vec_id AS query_id, b.vec_id AS id, round(list_distance(q.e, b.e) ** 2, 9) AS distance FROM v q, v b WHERE q.vec_id % 50 = 0),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM d) WHERE rank <= 3 AND query_id % 200 <> 50)"""


_RESULTS = f"""
WITH {_HITS}, t AS (SELECT query_id, rank, '[Source ' || rank || ': file' || id % 7 || '; chunk ' || id || CASE WHEN id % 3 <> 0 THEN '; page ' || id % 9 ELSE '' END || ']' || CASE WHEN id % 2 = 0 THEN chr(10) || 'Headings: H' || id ELSE '' END || chr(10)
  || CASE WHEN id % 4 = 0 THEN 'Supporting context:' || chr(10) || 'near' || chr(10) || chr(10) || 'Passage:' || chr(10) || 'raw ' || id ELSE 'raw ' || id END AS s FROM hits)
SELECT q.vec_id AS query_id, coalesce(string_agg(s, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), 'No relevant information was found in the uploaded documents.') AS text FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) q LEFT JOIN t ON t.query_id = q.vec_id GROUP BY q.vec_id"""


def _asked(base: DataFrame) -> DataFrame:
    """Every fiftieth vector as a query; every fourth of them is a vector of another length, and so has no results."""
    asked = F.when(F.col("vec_id") % 200 == 50, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    return base.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), asked.alias("query"))


def _shown(base: DataFrame) -> DataFrame:
    """Vectors as chunks."""
    i = F.col("vec_id")
    return base.select(
        i.alias("chunk_id"), F.concat(F.lit("file"), i % 7).alias("filename"), F.lit("s").alias("source"), F.when(i % 3 != 0, i % 9).alias("page"), F.when(i % 2 == 0, F.concat(F.lit("H"), i)).alias("headings"),
        F.concat(F.lit(" raw "), i).alias("raw_text"), F.when(i % 4 == 0, "near ").otherwise(" ").alias("supporting_context"), F.lit("x").alias("page_content"),
    )


@query(_RESULTS)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunks of queries as the search shows them; distances left out, as they differ in their last digits."""
    base = table(spark, sf_dir, "embeddings")
    queries = _asked(base)
    said = vector.answers(queries, vector.format_results(vector.top_k(base, queries, 3, "vec_id"), _shown(base)))
    return said.withColumn("text", F.regexp_replace("text", "; distance [0-9.]+\\]", "]"))


@query(_RESULTS)
def search_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the table function, called from SQL over more hits than it shows."""
    base = table(spark, sf_dir, "embeddings")
    queries = _asked(base)
    search.register(spark)
    return spark.sql(
        """
        SELECT q.query_id, coalesce(regexp_replace(r.text, '; distance [0-9.]+[]]', ']'), {none}) AS text
        FROM {queries} q LEFT JOIN search_results(TABLE(SELECT * FROM {hits} h JOIN {chunks} c ON h.id = c.chunk_id), 3) r ON r.query_id = q.query_id""",
        queries=queries, hits=vector.top_k(base, queries, 5, "vec_id").drop("rank"), chunks=_shown(base), none=vector.NO_RESULTS,
    )


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as parsed documents with texts, tables and pictures."""
    n = F.col("p_partkey")
    words = F.split("p_name", " ")
    prov = lambda p: F.array(F.struct(p.cast("int").alias("page_no"), F.struct((p * 1.5).alias("l")).alias("bbox")))
    grid = F.when(n % 5 == 0, F.lit(None).cast("array<array<string>>")).when(n % 5 == 1, F.array(words, F.array(F.lit("x")))).when(n % 5 == 2, F.array().cast("array<array<string>>")).otherwise(F.array(words, words, words))
    item = lambda label, text: F.struct(label.alias("label"), text.alias("text"), prov(n % 7 + 1).alias("prov"))
    items = F.array(item(F.when(n % 2 == 0, "Title").otherwise("section_header "), F.col("p_name")), item(F.lit("text"), F.col("p_type")), item(F.lit("sub_header"), F.when(n % 3 != 0, F.col("p_brand"))), item(F.lit("list_item"), F.lit(" ")))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("d"), n).alias("document_id"), F.concat(F.lit("f"), n).alias("filename"), F.sequence(F.lit(1), (n % 3 + 1).cast("int")).alias("pages"), items.alias("items"), items.alias("texts"),
        F.array(F.struct((n % 4).cast("int").alias("page"), F.when(n % 2 == 0, F.col("p_name")).alias("caption"), grid.alias("cells"))).alias("tables"),
        F.when(n % 4 != 0, F.array(F.struct(prov(n % 9).alias("prov"), F.col("p_brand").alias("caption")))).alias("pictures"),
    )


@query("""
WITH p AS (SELECT p_partkey AS n, * FROM part)
SELECT 'd' || n AS document_id, 0 AS pos, CASE WHEN n % 2 = 0 THEN 'title' ELSE 'section_header' END AS type, p_name AS text, (n % 7 + 1)::INT AS page, CASE WHEN n % 2 = 0 THEN 1 ELSE 2 END AS level FROM p
UNION ALL SELECT 'd' || n, 2, 'sub_header', CASE WHEN n % 3 <> 0 THEN p_brand ELSE '' END, (n % 7 + 1)::INT, 4 FROM p""")
def structure_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headings of parsed documents with their levels."""
    return files.hierarchy(evidence.explode_items(_parsed(spark, sf_dir)))


@query("""
SELECT 'd' || p_partkey AS document_id, 1 AS table_number, CASE WHEN p_partkey % 5 > 1 THEN (p_partkey % 4)::INT END AS page, CASE WHEN p_partkey % 5 > 1 AND p_partkey % 2 = 0 THEN p_name END AS caption, CASE WHEN p_partkey % 5 > 2 THEN 3 WHEN p_partkey % 5 = 2 THEN 0 END AS n_rows,
  CASE WHEN p_partkey % 5 > 2 THEN len(string_split(p_name, ' '))::INT WHEN p_partkey % 5 = 2 THEN 0 END AS n_columns, p_partkey % 5 <= 2 AS is_empty, CASE p_partkey % 5 WHEN 0 THEN 'no cells' WHEN 1 THEN 'rows of different length' END AS error FROM part""")
def structure_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of parsed documents; broken ones are told apart."""
    return files.tables(_parsed(spark, sf_dir))


@query("""
WITH s AS (SELECT 'd' || p_partkey AS document_id, p_partkey AS n, p_brand FROM part)
SELECT document_id, 'picture 1 on ' || n % 9 || ': ' || p_brand || ' at ' || (n % 9 * 1.5)::DOUBLE AS said FROM s WHERE n % 4 <> 0
UNION ALL SELECT 'f' || n, concat_ws(',', n % 3 + 1, 4, 1, CASE WHEN n % 4 <> 0 THEN 1 ELSE 0 END) FROM s""")
def structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pictures of parsed documents, and counts of what they have."""
    docs = _parsed(spark, sf_dir)
    shown = F.concat(F.lit("picture "), "picture_number", F.lit(" on "), "page", F.lit(": "), "caption", F.lit(" at "), F.col("bounding_box.l"))
    counts = files.summary(docs).select(F.col("filename").alias("document_id"), F.concat_ws(",", "pages", "text_items", "tables", "pictures").alias("said"))
    return files.pictures(docs).select("document_id", shown.alias("said")).unionByName(counts)


@query("""
SELECT 'd' || p_partkey AS document_id, CASE WHEN p_partkey % 2 = 0 THEN '# ' ELSE '## ' END || p_name || chr(10) || chr(10) || p_type || CASE WHEN p_partkey % 3 <> 0 THEN chr(10) || chr(10) || '#### ' || p_brand ELSE '' END AS markdown FROM part""")
def structure_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed documents as Markdown."""
    docs = _parsed(spark, sf_dir).withColumn("items", F.transform("items", lambda x: x.withField("orig", F.lit(None).cast("string"))))
    return files.downloads(docs).select("document_id", "markdown")


@query("""
WITH p AS (SELECT p_partkey AS n, 'k' || p_partkey // 20 AS k, * FROM part),
b AS (SELECT k, n, '[EVIDENCE ID: e' || n || ']' || chr(10) || 'Clause: ' || CASE WHEN n % 3 = 0 THEN '(none)' ELSE '1.0' || n % 9 END || chr(10) || 'Page: ' || CASE WHEN n % 4 = 0 THEN '(unknown)' ELSE (n % 4)::VARCHAR END || chr(10) || 'Heading Path:' || chr(10) || CASE WHEN n % 5 = 0 THEN '(none)' ELSE p_brand || ' > ' || p_type END || chr(10) || chr(10) || 'Text:' || chr(10) || p_name AS b FROM p),
j AS (SELECT k, string_agg(CASE WHEN n % 20 < 10 THEN b END, chr(10) || chr(10) || '----' || chr(10) || chr(10) ORDER BY n) AS x, string_agg(CASE WHEN n % 20 >= 10 AND n // 20 % 3 <> 0 THEN b END, chr(10) || chr(10) || '----' || chr(10) || chr(10) ORDER BY n) AS y, any_value(n // 20) AS s FROM b GROUP BY k),
t AS (SELECT k, 'SECTION METADATA' || chr(10) || chr(10) || 'section_number: ' || (15000 + s) || chr(10) || 'section_title: ' || CASE WHEN s % 2 = 0 THEN '(unknown)' ELSE 'T' || s END || chr(10) || chr(10) || 'SUBMITTAL EVIDENCE' || chr(10) || chr(10) || coalesce(x, '(none)') || chr(10) || chr(10) || 'PRODUCT EVIDENCE' || chr(10) || chr(10) || coalesce(y, '(none)') || chr(10) AS prompt FROM j)
SELECT k AS project_section_key, prompt, (length(prompt) + 7)::INT AS n_chars FROM t""")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an extractor is asked for each section."""
    n = F.col("p_partkey")
    s = F.floor(n / 20)
    rows = table(spark, sf_dir, "part").select(
        F.concat(F.lit("k"), s).alias("project_section_key"), n.alias("pos"), s.alias("s"), F.concat(F.lit("e"), n).alias("id"), F.when(n % 4 != 0, n % 4).alias("page_number"), F.when(n % 3 != 0, F.concat(F.lit("1.0"), n % 9)).alias("source_clause"),
        F.when(n % 5 != 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>")).alias("heading_path"), F.col("p_name").alias("raw_text"),
    )
    sections = rows.select("project_section_key", (15000 + F.col("s")).cast("string").alias("section_number"), F.when(F.col("s") % 2 == 1, F.concat(F.lit("T"), "s")).otherwise("").alias("section_title")).distinct()
    return plugins.prompts(sections, rows.where("pos % 20 < 10"), rows.where("pos % 20 >= 10 and s % 3 <> 0"), system="7 chars")


@query("""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, (len(w) + 99) // 100)) AS i FROM w WHERE len(w) > 0)
SELECT doc_id AS document_id, i::INT AS pos, sha256(array_to_string(w[i * 100 + 1 : i * 100 + 100], ' ')) AS digest FROM s""")
def chunk_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into runs of a hundred words."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return chunks.split_tokens(docs, 100).select("document_id", "pos", F.sha2("raw_text", 256).alias("digest"))


_TOKENS = f"regexp_extract_all(t, '{chunker.TOKEN}')"
_PARTS = f"regexp_extract_all(t, '(?:{chunker.TOKEN})[{chunker.WHITE}]*')"


@query(f"""
WITH RECURSIVE l AS (SELECT doc_id AS d, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS t FROM documents),
i AS (SELECT d, pos, t, CASE WHEN d % 3 = 0 THEN '' ELSE 'H' || pos // 12 END AS h, CASE WHEN d % 3 = 0 THEN 700 ELSE 699 END AS room, len({_TOKENS}) AS n FROM l),
p AS (SELECT d, pos, h, room, n, part, CASE WHEN n > room THEN rtrim(array_to_string({_PARTS}[part * room + 1 : part * room + room], ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE t END AS t, CASE WHEN n > room THEN least(room, n - part * room) ELSE n END AS m
  FROM (SELECT *, unnest(range(0, (n - 1) // room + 1)) AS part FROM i WHERE n > 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY pos, part) AS no FROM p),
f AS (SELECT d, no, pos, h, t, 0 AS number, m AS total, m FROM o WHERE no = 1 UNION ALL
  SELECT o.d, o.no, o.pos, o.h, o.t, CASE WHEN o.h = f.h AND f.total + o.m <= o.room THEN f.number ELSE f.number + 1 END, CASE WHEN o.h = f.h AND f.total + o.m <= o.room THEN f.total + o.m ELSE o.m END, o.m FROM f JOIN o ON o.d = f.d AND o.no = f.no + 1)
SELECT d AS document_id, number::INT AS pos, sha256(string_agg(t, chr(10) ORDER BY no)) AS digest, any_value(h) AS headings, (sum(m) + CASE WHEN any_value(h) = '' THEN 0 ELSE 1 END)::BIGINT AS n_tokens, array_to_string(list_sort(list(DISTINCT pos // 40 + 1)), ',') AS pages FROM f GROUP BY d, number""")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in chunks of 700 tokens under their headings; the twin goes piece by piece."""
    each = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    heads = F.when(F.col("document_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("H"), F.floor(F.col("pos") / 12))))
    items = each.select("document_id", "pos", "text", heads.alias("headings"), F.array(F.lit("text")).alias("labels"), (F.floor(F.col("pos") / 40) + 1).cast("int").alias("page"))
    out = chunker.chunk(items)
    return out.select("document_id", "pos", F.sha2("raw_text", 256).alias("digest"), F.array_join("headings", ">").alias("headings"), "n_tokens", F.array_join("pages", ",").alias("pages"))


_LINE = """
l AS (SELECT p_partkey AS n, p_name AS nm, CASE p_partkey % 10 WHEN 0 THEN 'SECTION ' || (15000 + p_partkey % 900) || ' - METAL DUCTS' WHEN 1 THEN '23 31 1' || p_partkey % 9 || ' FANS' WHEN 2 THEN 'PART ' || p_partkey % 4 || ' PRODUCTS' WHEN 3 THEN '2.0' || p_partkey % 9 || ' Sealants and submittals' WHEN 4 THEN 'A. ' || p_name
  WHEN 5 THEN 'ACTION SUBMITTALS' WHEN 6 THEN 'list of submittals' WHEN 7 THEN 'see Section 15' || p_partkey % 90 WHEN 8 THEN 'DIVISION 23 - HVAC' ELSE '1' || (5000 + p_partkey % 900) END AS t, p_partkey % 3 <> 0 AS heading FROM part)"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey")
    made = [F.concat(F.lit("SECTION "), 15000 + n % 900, F.lit(" - METAL DUCTS")), F.concat(F.lit("23 31 1"), n % 9, F.lit(" FANS")), F.concat(F.lit("PART "), n % 4, F.lit(" PRODUCTS")), F.concat(F.lit("2.0"), n % 9, F.lit(" Sealants and submittals")), F.concat(F.lit("A. "), "p_name")]
    made += [F.lit("ACTION SUBMITTALS"), F.lit("list of submittals"), F.concat(F.lit("see Section 15"), n % 90), F.lit("DIVISION 23 - HVAC"), F.concat(F.lit("1"), 5000 + n % 900)]
    return table(spark, sf_dir, "part").select(n.alias("n"), F.col("p_name").alias("nm"), F.element_at(F.array(*made), (n % 10 + 1).cast("int")).alias("t"), (n % 3 != 0).alias("heading"))


@query(f"""
WITH {_LINE} SELECT n AS p_partkey, n % 10 IN (3, 5) AS opens, heading AND n % 10 = 2 AS part, heading AND n % 10 = 0 AND n % 4 = 0 AS boundary, heading AND n % 10 = 3 AND n % 4 IN (0, 1) AS article, n % 10 = 0 OR (heading AND n % 10 IN (1, 5, 8)) AS chrome, NOT heading AND n % 10 IN (0, 7) AS cross_reference,
  n % 10 IN (5, 6, 7) AS title, n % 10 = 3 AND n % 4 IN (1, 2) AS supported FROM l""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines may be: openings, parts, boundaries, articles, page headers, references, titles."""
    t, heading, n = F.col("t"), F.col("heading"), F.col("n")
    clause = F.element_at(F.array(F.lit(""), F.concat(F.lit("2.0"), n % 9), F.concat(F.lit("2.0"), n % 9, F.lit(".A")), F.lit("x")), (n % 4 + 1).cast("int"))
    rows = _said(spark, sf_dir).withColumn("clause", clause)
    return rows.select(
        n.alias("p_partkey"), P.submittal_text(X.fold("t"), t).alias("opens"), P.part_heading(heading, t).alias("part"), P.section_boundary(heading, t, "clause").alias("boundary"), P.article_heading(heading, t, "clause").alias("article"), P.page_chrome(heading, t).alias("chrome"),
        P.body_cross_reference(heading, t).alias("cross_reference"), P.title_line(X.normalize("t"), X.parse_section(X.normalize("t"))).alias("title"), (P.clause_supports(F.concat(F.lit("2.0"), n % 9), "clause") & (n % 10 == 3)).alias("supported"),
    )


@query(f"""
WITH {_LINE} SELECT n AS p_partkey, CASE WHEN n % 10 = 0 THEN (15000 + n % 900) || '|METAL DUCTS|explicit_section_heading' WHEN n % 10 = 1 THEN '23 31 1' || n % 9 || '|FANS|numbered_heading' WHEN n % 10 = 9 THEN '1' || (5000 + n % 900) || '|-|numbered_heading' ELSE '' END AS parsed,
  CASE n % 10 WHEN 0 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 30 WHEN 4 THEN 40 ELSE CASE WHEN n % 2 = 0 THEN 15 ELSE 50 END END AS rank, coalesce(CASE WHEN n % 10 = 4 THEN 'A.' END, '-') AS marker, coalesce(CASE WHEN n % 10 = 3 THEN '2.0' || n % 9 END, '-') AS article, CASE WHEN n % 10 = 2 THEN (n % 4)::INT END AS part_number,
  lower(t) || ' "x" - y' AS folded, replace((n % 90 + 10) || ' ' || (n % 80 + 10), '-', ' ') AS number, CASE WHEN n % 2 = 0 THEN nm END AS title FROM l""")
def line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines say: section numbers and titles, ranks, markers, articles, parts."""
    n, p = F.col("n"), F.col("p")
    rows = _said(spark, sf_dir).withColumn("p", X.parse_section(X.normalize("t")))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return rows.select(
        n.alias("p_partkey"), F.when(p.isNotNull(), F.concat_ws("|", p["number"], dash(p["title"]), p["method"])).otherwise("").alias("parsed"), X.heading_rank("t", F.when(n % 2 == 0, "page_header").otherwise("text")).alias("rank"), dash(X.marker_token(F.lit(" "), "t")).alias("marker"),
        dash(X.article_of(F.lit(None).cast("string"), "t")).alias("article"), X.part_number("t").alias("part_number"), X.fold(F.concat(F.lit(" "), "t", F.lit("\t“x” – y "))).alias("folded"), X.section_number(F.concat_ws("–", n % 90 + 10, n % 80 + 10)).alias("number"), X.clean_title(F.when(n % 2 == 0, F.concat("nm", F.lit("  "))).otherwise(" ")).alias("title"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_type || ' ' END AS raw, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 7 END AS page, p_name || ' > ' || p_brand AS heading, p_name || chr(10) || p_brand || chr(10) || p_name AS context, 'Shop Drawings' AS type, p_name || '; ' || p_brand AS cell, replace(replace(p_name, ' ', '_'), '#', '_') || '_submittal_register' AS base,
  replace(p_brand || '\\|x', '#', '#') || ' y' AS escaped, p_partkey % 3 || CASE WHEN p_partkey % 3 = 1 THEN ' product' ELSE ' products' END AS counted, p_name || p_brand AS message, p_partkey % 2 = 0 AS has_term, substr(p_name, 1, 4) AS shown, p_name || ' — ' || 'Untitled' AS label FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text functions of chunks, exports and messages."""
    n = F.col("p_partkey")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    prov = F.array(F.struct(F.lit(None).cast("int").alias("page_no")), F.struct(F.when(n % 2 == 0, 0).otherwise(7).alias("page_no")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", X.raw_text(F.when(n % 3 == 0, F.col("p_name")).otherwise(" "), F.concat("p_type", F.lit(" "))).alias("raw"), X.first_page(prov).alias("page"), X.heading_line(F.array(F.concat(F.lit(" "), "p_name"), F.lit(" "), "p_brand")).alias("heading"),
        X.context_lines(F.array("p_name", F.concat("p_name", F.lit(" ")), F.lit(""), "p_brand", "p_name")).alias("context"), X.type_title(F.lit("shop_drawings")).alias("type"), X.product_cell(F.array("p_name", "p_brand"), True).alias("cell"), X.export_basename(F.concat(F.lit("#"), "p_name", F.lit(".."))).alias("base"),
        X.markdown_cell(F.concat("p_brand", F.lit("|x\ny"))).alias("escaped"), X.count_label(n % 3).alias("counted"), X.message_text(F.array(part("text", F.col("p_name")), part("image", F.lit("z")), part("text", F.col("p_brand")))).alias("message"),
        X.term_present(F.when(n % 2 == 0, "Rated 0.75 IN").otherwise("Rated 1.75 in"), F.when(n % 4 == 0, ".75 in").when(n % 4 == 2, "0.75").otherwise("0.7500")).alias("has_term"), X.preview("p_name", 4).alias("shown"), X.section_label("p_name", F.lit("")).alias("label"),
    )
