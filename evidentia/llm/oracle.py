"""DuckDB twins of the queries that SQL can express.

The others need a tokenizer, XXH64 or a fitted model; they are tested against
brute force.
"""

from __future__ import annotations

from evidentia.llm import decontaminate, divergence, secrets

ORACLES: dict[str, str] = {}

ORACLES["op1_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a), c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS kind_no, {_quoted(r.kind)} AS kind, unnest(list_transform(string_split_regex(t, {_quoted(r.pattern)}), lambda x: length(x))[:len(regexp_extract_all(t, {_quoted(r.pattern)}))]) AS gap, "
    f"unnest(list_transform(regexp_extract_all(t, {_quoted(r.pattern)}), lambda x: length(x))) AS size, unnest(list_transform(regexp_extract_all(t, {_quoted(r.pattern)}, {r.group}), lambda x: length(x))) AS own, "
    f"generate_subscripts(regexp_extract_all(t, {_quoted(r.pattern)}), 1) AS i, {r.least} AS least FROM d"
    for i, r in enumerate(secrets.RULES)
)
ORACLES["op5_secret_scans"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_MATCHES}),
p AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, kind_no ORDER BY i) AS e FROM m),
f AS (SELECT doc_id, kind_no, kind, (e - size)::BIGINT AS s, e::BIGINT AS e FROM p WHERE own >= least),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) FILTER (kind_no < {len(secrets.BASE)}), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, kind_no) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN g USING (doc_id)"""

ORACLES["op7_suffix_array_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
r AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE first < doc_id),
b AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM b),
sp AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY ALL),
g AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM sp),
q AS (SELECT doc_id, any_value(h) AS h, max(z) AS z, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS head FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(q.h, 2 * z + 1), d.h))) AS kept_sha256 FROM d LEFT JOIN q USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op12_benchmark_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, {_quoted(decontaminate.WORD)}) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({_LOWER}, {_quoted(decontaminate.WORD)}) AS w FROM benchmark),
x AS (SELECT item, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0),
n AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i + 1:i + 10], ' ') AS t FROM x),
s AS (SELECT DISTINCT size FROM n),
g AS (SELECT k, size, unnest(range(0, len(w) - size + 1)) AS i, w FROM d, s WHERE len(w) >= size),
m AS (SELECT k, i, size, array_to_string(w[i + 1:i + size], ' ') AS t FROM g),
h AS (SELECT DISTINCT k, item, i, size FROM m JOIN n USING (size, t)),
c AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT k, i, size FROM h)) GROUP BY k),
e AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (k) LEFT JOIN e USING (k)"""

ORACLES["op13_source_divergence"] = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, {_quoted(divergence.TERM)}) AS w FROM documents),
t AS (SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
v AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= {divergence.audit.__defaults__[0]}),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM t JOIN v USING (lang, term) GROUP BY ALL),
a AS (SELECT lang, source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS kept FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 5)::HUGEINT // (total + 5 * kept)::HUGEINT AS p FROM a),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 5)::HUGEINT // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM l),
s AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
o AS (SELECT lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y USING (lang) LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source WHERE x.source <> y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {divergence.audit.__defaults__[1]}"""
