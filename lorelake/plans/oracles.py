"""DuckDB SQL giving the same rows as the registered queries.

The SQL works on the driver tables only.  For the Markdown corpus made from
``part`` it derives the expected result by arithmetic on the part key, without
parsing any text.
"""

from __future__ import annotations

A, P = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
AS_OF = "2024-01-31"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
MARK = "<!-- workspace-review:v1"


def fold(x: str) -> str:
    return f"translate(lower({x}), '{A}', '{P}')"


def tok(x: str) -> str:
    return f"regexp_extract_all({fold(x)}, '\\p{{L}}+|\\p{{N}}+')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def qterms(x: str) -> str:
    return (f"list_transform(list_filter(list_transform(string_split({collapse(x)}, ' '), lambda t: trim(t, '{PUNCT}')),"
            f" lambda t: strlen(t) >= 2), lambda t: {fold('t')})")


DOCS = """docs AS (SELECT doc_id, lang AS location_id, 1::BIGINT AS generation,
 concat(source, '/', lpad(doc_id::VARCHAR, 8, '0'), '.md') AS relative_path,
 CASE WHEN doc_id % 50 = 7 THEN 'log' WHEN doc_id % 50 = 8 THEN 'index' ELSE 'concept' END AS kind,
 substr(text, 1, 24) AS title,
 CASE WHEN doc_id % 4 <> 0 THEN substr(text, 25, 60) END AS description,
 CASE WHEN doc_id % 10 <> 1 THEN concat('Type ', source) END AS type,
 CASE WHEN doc_id % 9 = 0 THEN []::VARCHAR[] ELSE [lang, concat('t', (doc_id % 7)::VARCHAR)] END AS tags,
 CASE WHEN doc_id % 9 = 0 THEN '' ELSE concat(lang, ' t', (doc_id % 7)::VARCHAR) END AS tags_text,
 CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 40) ELSE '' END AS headings_text,
 text AS body, concat(source, ' ', lang, ' owner team', (doc_id % 5)::VARCHAR) AS metadata_text,
 CASE doc_id % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'stable' WHEN 2 THEN 'deprecated' END AS status,
 CASE doc_id % 5 WHEN 0 THEN 'humanReviewed' WHEN 1 THEN 'machineConfirmed' WHEN 2 THEN 'unverified' END AS trust_tier,
 CASE doc_id % 6 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '2024-01-31' WHEN 2 THEN '2099-01-01' END AS stale_after,
 doc_id % 3 AS finding_count, n_chars AS size, 1700000000000 + doc_id * 1000 AS modified_at_ms FROM documents)"""

FRESH = f"CASE WHEN stale_after IS NULL THEN 'unspecified' WHEN stale_after <= '{AS_OF}' THEN 'stale' ELSE 'current' END"

FIELDS = f"""fields AS (SELECT location_id, relative_path,
 unnest(['title','description','type','tags','headings','path','body','metadata']) AS field,
 unnest([8.0,5.0,4.0,4.0,3.0,2.0,1.0,1.0]::DOUBLE[]) AS weight, unnest([0,1,2,3,4,5,6,7]) AS ord,
 unnest(['Title match','Description match','Type match','Tag match','Heading match','Path match','Body match','Frontmatter match']) AS label,
 unnest([title, coalesce(description, ''), coalesce(type, ''), tags_text, headings_text, relative_path, body, metadata_text]) AS txt FROM docs),
toks AS (SELECT location_id, relative_path, field, {tok('txt')} AS t FROM fields),
stats AS (SELECT location_id, field, count(*) AS n_docs, sum(len(t)) / count(*) AS avg_dl FROM toks GROUP BY ALL)"""

QUERY = "q AS (SELECT item_id AS query_id, concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2)) AS query FROM benchmark)"

POST = f"""qt AS (SELECT query_id, len(list_distinct({tok('query')})) AS n_terms, unnest(list_distinct({tok('query')})) AS term FROM q),
post AS (SELECT location_id, relative_path, field, dl, term, count(*) AS tf FROM
  (SELECT location_id, relative_path, field, len(t) AS dl, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM qt) GROUP BY ALL)"""

SCORED = """df AS (SELECT location_id, field, term, count(*) AS df FROM post GROUP BY ALL),
hit AS (SELECT qt.query_id, qt.n_terms, p.location_id, p.relative_path, p.field,
   sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score, count(*) AS n
  FROM post p JOIN df USING (location_id, field, term) JOIN stats USING (location_id, field) JOIN qt USING (term) GROUP BY ALL)"""


def candidates(mode: str = "and", limit: str = "60", extra: str = "TRUE") -> str:
    keep = "n >= n_terms" if mode == "and" else "TRUE"
    return f"""fs AS (SELECT * FROM hit WHERE {keep}),
tot AS (SELECT query_id, location_id, relative_path, round(sum(score * weight), 9) AS weighted_score,
   coalesce(max(score) FILTER (field = 'title'), 0) AS s_title, coalesce(max(score) FILTER (field = 'body'), 0) AS s_body,
   coalesce(max(score) FILTER (field = 'headings'), 0) AS s_headings
  FROM fs JOIN (SELECT DISTINCT field, weight FROM fields) USING (field) GROUP BY ALL),
cand AS (SELECT * FROM (SELECT tot.*, row_number() OVER (PARTITION BY query_id, location_id ORDER BY weighted_score DESC, relative_path) AS candidate_rank
   FROM tot JOIN q USING (query_id) JOIN docs USING (location_id, relative_path) WHERE {extra}) JOIN q USING (query_id)
  WHERE candidate_rank <= {limit})"""


SNIP = f"""CASE WHEN coll = '' THEN '' ELSE concat(CASE WHEN st > 0 THEN '…' ELSE '' END, trim(substr(coll, st + 1, en - st)),
 CASE WHEN en < length(coll) THEN '…' ELSE '' END) END"""


def snippet_cte(source: str, body: str, terms: str, keys: str) -> str:
    return f"""s1 AS (SELECT {keys}, {collapse(body)} AS coll, {terms} AS terms FROM {source}),
s2 AS (SELECT *, coalesce(list_min(list_filter(list_transform(terms, lambda t: instr({fold('coll')}, t)), lambda p: p > 0)) - 1, 0) AS pos FROM s1),
s3 AS (SELECT *, greatest(pos - 90, 0) AS st, least(pos + 190, length(coll)) AS en FROM s2)"""


def signals(phrase: bool, score_source: str = "fs") -> str:
    test = (f"contains({fold('f.txt')}, {fold('split_q')})" if phrase
            else f"list_bool_or(list_transform(terms, lambda t: contains({fold('f.txt')}, t)))")
    return f"""cq AS (SELECT c.query_id, c.location_id, c.relative_path, q.query, substr(q.query, 2, length(q.query) - 2) AS split_q, {qterms('q.query')} AS terms
  FROM cand c JOIN q USING (query_id)),
sg0 AS (SELECT cq.query_id, cq.location_id, cq.relative_path, cq.query, f.field, f.weight, f.ord, f.label,
   coalesce({test}, FALSE) AS found, coalesce(s.score, 0.0) AS base
  FROM cq JOIN fields f USING (location_id, relative_path) LEFT JOIN {score_source} s USING (query_id, location_id, relative_path, field)),
sg AS (SELECT *, CASE WHEN found THEN greatest(base, 1.0) ELSE base END AS signal FROM sg0),
res AS (SELECT query_id, location_id, relative_path, query, round(sum(signal * weight), 9) AS score, bool_or(found) AS any_found,
   string_agg(field, '|' ORDER BY ord) FILTER (signal > 0) AS matched_fields,
   first(label ORDER BY signal * weight DESC, ord DESC) FILTER (signal > 0) AS reason FROM sg GROUP BY ALL
   {'HAVING bool_or(found)' if phrase else ''}),
pos AS (SELECT res.*, title, kind AS role, {FRESH} AS freshness,
   CASE WHEN lower(title) = lower(trim(query, '"')) THEN 'Exact title match' ELSE coalesce(reason, 'Knowledge match') END AS match_reason,
   row_number() OVER (PARTITION BY query_id, location_id ORDER BY score DESC, res.relative_path) AS position
  FROM res JOIN docs USING (location_id, relative_path)),
fed AS (SELECT *, 1.0::DOUBLE / (60.0::DOUBLE + position) AS rank_score,
   row_number() OVER (PARTITION BY query_id ORDER BY position, score DESC, location_id, relative_path) AS rank FROM pos)"""


def search(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


BASE = [DOCS, FIELDS, QUERY, POST, SCORED]

PARTS = """parts AS (SELECT p_partkey AS k, 'b' || (p_partkey % 4)::VARCHAR AS location_id, p_partkey % 10 AS r,
 'concepts/p' || lpad(p_partkey::VARCHAR, 6, '0') || '.md' AS relative_path, p_name AS name, p_brand AS brand, p_type AS ptype, p_size AS size,
 './p' || lpad(((p_partkey * 5 % 48) * 4 + p_partkey % 4)::VARCHAR, 6, '0') || CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE '' END || '.md' AS target,
 CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE 4 + (p_partkey % 10 <> 1)::INT + (p_partkey % 10 IN (4,5,6,7,8,9))::INT
   + CASE p_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END
   + (p_partkey % 10 <> 2)::INT + 1 END AS front_lines,
 CASE WHEN p_partkey % 17 = 0 AND p_partkey % 10 <> 2 THEN 3 ELSE 0 END AS review_lines, p_partkey % 10 IN (0, 2) AS bare FROM part)"""

PDOCS = PARTS + """,
pdocs AS (SELECT *, CASE WHEN bare THEN name ELSE name || ' ' || k::VARCHAR END AS title,
 CASE WHEN bare OR r = 1 THEN NULL ELSE ptype END AS type,
 CASE WHEN bare THEN []::VARCHAR[] WHEN r = 3 THEN [brand] ELSE [brand, 'size' || size::VARCHAR] END AS tags,
 CASE r WHEN 4 THEN 'retired' WHEN 8 THEN 'draft' ELSE 'stable' END AS status,
 CASE WHEN bare OR k % 3 = 2 THEN 'unverified' WHEN k % 3 = 0 THEN 'humanReviewed' ELSE 'machineConfirmed' END AS trust_tier,
 CASE r WHEN 6 THEN '2020-01-01' WHEN 7 THEN '2099-01-01' END AS stale_after,
 CASE WHEN bare THEN NULL WHEN k % 7 = 0 THEN '2024-01-05T00:00:00Z' ELSE '2024-01-02' END AS timestamp,
 CASE WHEN r = 2 THEN 2 WHEN r IN (0, 1, 3, 4, 5, 9) THEN 1 ELSE 0 END AS finding_count FROM parts)"""

ROOTS = "roots AS (SELECT location_id, count(*) AS n FROM parts WHERE k % 4 IN (0, 2) GROUP BY 1)"

PLINKS = PDOCS + ",\n" + ROOTS + """,
plinks AS (SELECT location_id, relative_path AS source_relative_path, 0 AS position, target, 'concepts/' || substr(target, 3) AS target_relative_path,
  NULL::VARCHAR AS fragment, 'markdown' AS origin, NULL::VARCHAR AS field, CASE WHEN k % 11 = 0 THEN 'unresolved' ELSE 'resolved' END AS status,
  front_lines + review_lines + 3 AS start_line, 5 AS start_column, front_lines + review_lines + 3 AS end_line, 5 + length('[next]()') + length(target) AS end_column FROM parts
 UNION ALL SELECT location_id, relative_path, 1, '../../outside.md', NULL, NULL, 'metadata', 'resource', 'outsideBundle', NULL, NULL, NULL, NULL FROM parts WHERE r = 9
 UNION ALL SELECT location_id, 'index.md', 0, 'concepts/p000000.md', 'concepts/p000000.md', NULL, 'markdown', NULL,
  CASE WHEN location_id = 'b0' THEN 'resolved' ELSE 'unresolved' END, CASE WHEN location_id = 'b0' THEN 6 ELSE 3 END, 3,
  CASE WHEN location_id = 'b0' THEN 6 ELSE 3 END, 3 + length('[First](concepts/p000000.md)') FROM roots),
alld AS (SELECT location_id, relative_path, title, 'concept' AS role FROM pdocs
 UNION ALL SELECT location_id, 'index.md', 'Bundle of ' || n::VARCHAR, 'index' FROM roots)"""

FINDINGS = PDOCS + """,
fnd AS (SELECT location_id, relative_path, r, k, unnest(CASE r
   WHEN 0 THEN ['OKF_FRONTMATTER_REQUIRED|error|Concept documents need YAML frontmatter.|conformance']
   WHEN 1 THEN ['OKF_TYPE_REQUIRED|error|The required type field is missing.|conformance']
   WHEN 2 THEN ['OKF_FRONTMATTER_UNCLOSED|error|The YAML frontmatter block is not closed.|conformance', 'OKF_TYPE_REQUIRED|error|The required type field is missing.|conformance']
   WHEN 3 THEN ['OKF_TAGS_SCALAR|info|A scalar tags value was accepted as a one-item list for compatibility.|compatibility']
   WHEN 4 THEN ['OKF_STATUS_UNKNOWN|info|The lifecycle status ''retired'' is not defined by OKF v0.2.|compatibility']
   WHEN 5 THEN ['OKF_VERSION_UNSUPPORTED|info|OKF version 0.9 is newer or unknown; Workspace is reading it in compatibility mode.|compatibility']
   WHEN 9 THEN ['OKF_LINK_OUTSIDE_BUNDLE|warning|The link ''../../outside.md'' escapes the bundle root.|conformance']
   ELSE []::VARCHAR[] END) AS f FROM pdocs),
fndx AS (SELECT location_id, relative_path, split_part(f, '|', 1) AS code, split_part(f, '|', 2) AS severity,
   split_part(f, '|', 3) AS message, split_part(f, '|', 4) AS tier FROM fnd)"""

EDGES = PLINKS + """,
edges AS (SELECT location_id, source_relative_path AS source, target_relative_path AS target FROM plinks
 WHERE status = 'resolved' AND source_relative_path <> 'index.md'),
deg AS (SELECT p.location_id, p.relative_path, (SELECT count(*) FROM edges e WHERE e.location_id = p.location_id AND e.source = p.relative_path)
  + (SELECT count(*) FROM edges e WHERE e.location_id = p.location_id AND e.target = p.relative_path) AS degree FROM pdocs p)"""

REL = PLINKS + """,
lk AS (SELECT location_id, source_relative_path AS s, target_relative_path AS t FROM plinks WHERE status = 'resolved' AND source_relative_path <> target_relative_path),
rel AS (SELECT location_id, relative_path, other, bool_or(o) AS o, bool_or(NOT o) AS i FROM
  (SELECT location_id, s AS relative_path, t AS other, TRUE AS o FROM lk UNION ALL SELECT location_id, t, s, FALSE FROM lk) GROUP BY ALL),
relx AS (SELECT rel.*, title, CASE WHEN o AND i THEN 'mutual' WHEN o THEN 'outgoing' ELSE 'incoming' END AS direction,
  row_number() OVER (PARTITION BY rel.location_id, rel.relative_path ORDER BY CASE WHEN o AND i THEN 0 WHEN o THEN 1 ELSE 2 END, lower(title), other) AS rank
  FROM rel JOIN (SELECT location_id, relative_path AS other, title FROM alld) USING (location_id, other))"""

LOGS = """logs AS (SELECT 'c' || (o_custkey % 4)::VARCHAR AS location_id,
  CASE WHEN o_custkey % 5 = 0 THEN 'log' || o_custkey::VARCHAR || '-' || (o_orderkey // 5000)::VARCHAR || '.md'
   ELSE 'c' || o_custkey::VARCHAR || '/' || (o_orderkey // 5000)::VARCHAR || '/log.md' END AS relative_path,
  CASE WHEN o_custkey % 5 = 0 THEN 'root' ELSE 'c' || o_custkey::VARCHAR || '/' || (o_orderkey // 5000)::VARCHAR END AS scope, o_custkey, o_orderkey,
  strftime(o_orderdate, '%Y-%m-%d') AS date, 'order ' || o_orderkey::VARCHAR || ' status ' || o_orderstatus || ' second line' AS summary FROM orders),
entries AS (SELECT location_id, relative_path, scope, date, summary, o_orderkey + 2 AS ord FROM logs
  UNION ALL SELECT DISTINCT location_id, relative_path, scope, NULL, unnest(['# Log', 'opening note']), unnest([0, 1]) FROM logs)"""

FIN = """fin AS (SELECT 'f' || (doc_id % 3)::VARCHAR AS location_id, (CASE WHEN doc_id % 4 = 0 THEN 'Docs' ELSE 'docs' END) || '\\' || doc_id::VARCHAR || '.md' AS relative_path,
 CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE 'info' END AS severity,
 CASE WHEN toxic = 1 THEN 'OKF_TYPE_REQUIRED' WHEN quality = 0 THEN 'OKF_LINK_BROKEN' WHEN doc_id % 2 = 0 THEN 'OKF_TAGS_SCALAR' ELSE 'OKF_STATUS_UNKNOWN' END AS code,
 'Check | document, 100%: ' || doc_id::VARCHAR AS message,
 CASE WHEN doc_id % 5 <> 0 THEN doc_id % 90 + 1 END AS l, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 7 + 1 END AS c,
 CASE WHEN doc_id % 5 <> 0 THEN doc_id % 7 + 5 END AS ec, doc_id FROM labels),
finr AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END,
   lower(relative_path), relative_path, l NULLS LAST, c NULLS LAST, code, message) AS position FROM fin),
sums AS (SELECT location_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
   count(*) FILTER (severity = 'info') AS info, count(*) AS documents FROM fin GROUP BY 1)"""
PLACE = "relative_path || CASE WHEN l IS NULL THEN '' ELSE ':' || l::VARCHAR || ':' || c::VARCHAR END"

ACT = """act AS (SELECT 'u' || (user_id % 8)::VARCHAR AS location_id, 'doc-' || user_id::VARCHAR || '.md' AS relative_path,
 CASE event_type WHEN 'view' THEN 'served' WHEN 'click' THEN 'context' WHEN 'purchase' THEN 'changed' WHEN 'signup' THEN 'created' ELSE 'removed' END AS kind, ts AS happened FROM events),
daily AS (SELECT location_id, strftime(happened, '%Y-%m-%d') AS day, relative_path,
 count(*) FILTER (kind = 'changed') AS changed_count, count(*) FILTER (kind = 'served') AS served_count, count(*) FILTER (kind = 'context') AS context_count,
 count(*) FILTER (kind = 'created') AS created_count, count(*) FILTER (kind = 'removed') AS removed_count,
 max(happened) FILTER (kind IN ('changed', 'created', 'removed')) AS last_changed, max(happened) FILTER (kind IN ('served', 'context')) AS last_served FROM act GROUP BY ALL)"""

SNAP = """snap AS (SELECT o_orderkey AS ok, 's' || (o_custkey % 4)::VARCHAR AS location_id, 'o' || o_orderkey::VARCHAR || '.md' AS relative_path,
 floor(o_totalprice)::BIGINT AS size, 1700000000000 + o_orderkey AS modified_at_ms FROM orders),
bef AS (SELECT location_id, relative_path, size, modified_at_ms FROM snap WHERE ok % 10 <> 1),
aft AS (SELECT location_id, relative_path, size + CASE WHEN ok % 10 = 3 THEN 1 ELSE 0 END AS size, modified_at_ms FROM snap WHERE ok % 10 <> 2),
dif AS (SELECT coalesce(a.location_id, b.location_id) AS location_id, coalesce(a.relative_path, b.relative_path) AS relative_path,
  CASE WHEN b.size IS NULL THEN 'added' WHEN a.size IS NULL THEN 'removed' WHEN a.size <> b.size OR a.modified_at_ms <> b.modified_at_ms THEN 'changed' ELSE 'unchanged' END AS change,
  coalesce(a.size, b.size) AS size, coalesce(a.modified_at_ms, b.modified_at_ms) AS modified_at_ms
 FROM bef b FULL OUTER JOIN aft a ON a.location_id = b.location_id AND a.relative_path = b.relative_path)"""
SIG = """md5(concat_ws(':', relative_path, modified_at_ms::VARCHAR, size::VARCHAR))"""

HIST = """hist AS (SELECT event_id, 'u' || (user_id % 8)::VARCHAR AS location_id, user_id, 'doc-' || user_id::VARCHAR || '.md' AS path,
 CASE WHEN event_id % 50 = 0 AND user_id >= 8 THEN user_id - 8 END AS prev,
 CASE event_type WHEN 'view' THEN 'modified' WHEN 'click' THEN 'modified' WHEN 'purchase' THEN 'renamed' WHEN 'signup' THEN 'created' ELSE 'removed' END AS kind,
 epoch_us(ts) // 1000 AS observed_at FROM events)"""
IDENT = HIST + """,
links AS (SELECT DISTINCT user_id AS a, prev AS b FROM hist WHERE prev IS NOT NULL),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
nodes AS (SELECT DISTINCT user_id AS n FROM hist UNION SELECT b FROM links),
reach AS (SELECT n AS root, n AS node FROM nodes UNION SELECT r.root, e.b FROM reach r JOIN both_ways e ON e.a = r.node),
ident AS (SELECT node, min('u' || (root % 8)::VARCHAR || '/doc-' || root::VARCHAR || '.md') AS identity FROM reach GROUP BY 1)"""

MOVED = """moved AS (SELECT 's' || (o_custkey % 4)::VARCHAR AS location_id, 'o' || lpad(o_orderkey::VARCHAR, 9, '0') || '.md' AS relative_path,
 (['removed', 'added', 'changed'])[o_orderkey % 3 + 1] AS change, o_custkey % 50 AS size, o_orderkey // 1000 AS chain FROM orders),
numbered AS (SELECT *, row_number() OVER (PARTITION BY location_id, size, chain, change ORDER BY relative_path) AS no FROM moved),
ren AS (SELECT r.location_id, r.relative_path AS previous_path, a.relative_path FROM numbered r JOIN numbered a USING (location_id, size, chain, no)
 WHERE r.change = 'removed' AND a.change = 'added')"""

PACK = """ref AS (SELECT 'p' || conv_id::VARCHAR AS pack_id, conv_id, turn AS pos, role AS location_id,
  't/' || conv_id::VARCHAR || '-' || turn::VARCHAR || '.md' AS relative_path,
  CASE WHEN turn % 3 = 0 THEN 'Selected manually' ELSE role || ' said' END AS reason, substr(text, 1, 16) AS title,
  length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS body_length, (conv_id + turn) % 5 <> 0 AS ok,
  least(greatest(conv_id % 5 * 400 + 500, 1000), 200000) AS max_characters, conv_id % 4 + 1 AS max_documents,
  CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'topic ' || conv_id::VARCHAR END AS query FROM conversations),
sel AS (SELECT *, coalesce(sum(ok::INT) OVER (PARTITION BY pack_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM ref),
sel2 AS (SELECT *, CASE WHEN earlier >= max_documents THEN 'Document limit reached' WHEN NOT ok THEN 'Document is not available in the active index' END AS om,
  CASE WHEN ok THEN length('## ' || title || '

- Location: `' || location_id || '`
- Path: `' || relative_path || '`
- Role: concept
- Included because: ' || reason || '

---

') END AS prefix_length,
  max_characters - 200 - length('# Workspace context pack

' || CASE WHEN query = '' THEN 'No query supplied.' ELSE 'Query: ' || query END || '

Budget: ' || max_characters::VARCHAR || ' characters

') AS available FROM sel),
sel3 AS (SELECT *, sum(CASE WHEN om IS NULL THEN prefix_length + least(body_length, 80) + CASE WHEN body_length > 80 THEN 48 ELSE 1 END ELSE 0 END)
   OVER (PARTITION BY pack_id ORDER BY pos) AS running FROM sel2),
cut AS (SELECT *, CASE WHEN om IS NULL AND running > available THEN 'Character budget reached' ELSE om END AS omission FROM sel3)"""

LEN = """len0 AS (SELECT 'p' || conv_id::VARCHAR AS pack_id, turn AS pos, length(text) AS n, conv_id % 9 * 60 + 17 AS budget FROM conversations)"""

ANCHORS = f"""txt AS (SELECT doc_id, text AS body, {collapse('text')} AS coll, string_split({collapse('text')}, ' ')[doc_id * 31 % len(string_split({collapse('text')}, ' ')) + 1] AS quote, doc_id * 7919 % (length(text) + 1) AS approx FROM documents),
ap AS (SELECT doc_id, unnest(string_split(coll, quote)) AS piece, generate_subscripts(string_split(coll, quote), 1) AS i FROM txt WHERE quote <> ''),
aps AS (SELECT doc_id, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS before, count(*) OVER (PARTITION BY doc_id) AS pieces FROM ap),
aoc AS (SELECT txt.*, length(quote) AS n, (before + (i - 1) * length(quote))::BIGINT AS p FROM aps JOIN txt USING (doc_id) WHERE i < pieces),
made AS (SELECT doc_id, body, coll, quote, n, first(p ORDER BY abs(p - approx), p) AS start FROM aoc GROUP BY ALL)"""

LISTREQ = DOCS + """,
req AS (SELECT DISTINCT lang || '/' || source AS request_id, lang AS location_id, source FROM documents),
listed AS (SELECT request_id, location_id, relative_path, row_number() OVER (PARTITION BY request_id ORDER BY relative_path) AS position
 FROM docs JOIN req USING (location_id) WHERE kind = 'concept' AND starts_with(relative_path, source || '/') AND list_has_any(tags, ['t1', 't2', 't4']))"""

PAGE = """hrefs AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target,
  generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS position FROM pages)"""


def foldup(path: str) -> str:
    """Lexical dot folding by list reduction."""
    return (f"list_reduce(list_transform(string_split({path}, '/'), lambda p: [p]), lambda acc, p: CASE WHEN p[1] IN ('', '.') THEN acc"
            f" WHEN p[1] = '..' THEN acc[:len(acc) - 1] ELSE list_concat(acc, p) END, []::VARCHAR[])")


ORACLES: dict[str, str] = {
    "search_federated": search(*BASE, candidates(), signals(False),
                               snippet_cte("(SELECT fed.*, body, description FROM fed JOIN docs USING (location_id, relative_path) WHERE rank <= 20)",
                                           "CASE WHEN trim(regexp_replace(body, '\\s+', ' ', 'g')) = '' THEN coalesce(description, '') ELSE body END",
                                           qterms("query"), "*"))
    + f""" SELECT query_id, location_id, relative_path, rank, position, round(rank_score, 6) AS rank_score, round(score, 4) AS score, title, role, freshness,
      {SNIP} AS snippet, matched_fields, match_reason FROM s3""",
    "search_candidates": search(*BASE, candidates()) + """ SELECT query_id, location_id, relative_path, candidate_rank, round(weighted_score, 4) AS weighted_score,
      round(s_title, 4) AS s_title, round(s_body, 4) AS s_body, round(s_headings, 4) AS s_headings FROM cand""",
    "search_candidates_any_term": search(*BASE, candidates("or")) + """ SELECT query_id, location_id, relative_path, candidate_rank,
      round(weighted_score, 4) AS weighted_score FROM cand""",
    "search_filtered": search(*BASE, candidates("and", "least(greatest((query_id % 30 + 1) * 3, 30), 200)", f"""
      (query_id % 4 <> 0 OR coalesce(type IN ('Type src1', 'Type src2', 'Type src3', 'Type src4'), FALSE))
      AND (query_id % 4 <> 1 OR list_has_any(tags, ['t1', 't2', 't3'])) AND (query_id % 3 <> 0 OR kind IN ('concept', 'log'))
      AND (query_id % 4 <> 2 OR coalesce(status IN ('stable', 'draft'), FALSE))
      AND (query_id % 5 <> 0 OR coalesce(trust_tier IN ('humanReviewed', 'unverified'), FALSE))
      AND (query_id % 4 <> 3 OR {FRESH} IN ('stale', 'unspecified')) AND (query_id % 6 <> 5 OR starts_with(relative_path, 'src1'))
      AND CASE query_id % 3 WHEN 1 THEN finding_count > 0 WHEN 2 THEN finding_count = 0 ELSE TRUE END"""))
    + " SELECT query_id, location_id, relative_path, candidate_rank, round(weighted_score, 4) AS weighted_score FROM cand",
    "search_phrase": search(DOCS, FIELDS, QUERY.replace("concat(split_part(text, ' ', 1), ' ', split_part(text, ' ', 2))",
                                                        "concat('\"', split_part(text, ' ', 1), ' ', split_part(text, ' ', 2), '\"')"),
                            POST, SCORED, candidates(), signals(True))
    + " SELECT query_id, location_id, relative_path, rank, round(score, 4) AS score, matched_fields, match_reason FROM fed WHERE rank <= 20",
    "search_simple": search(DOCS, f"""fields AS (SELECT location_id, relative_path, 'search_text' AS field, concat_ws(chr(10), nullif(title, ''), nullif(description, ''),
        nullif(type, ''), nullif(tags_text, ''), relative_path, nullif(headings_text, ''), nullif(body, ''), metadata_text) AS txt FROM docs),
      toks AS (SELECT location_id, relative_path, field, {tok('txt')} AS t FROM fields),
      stats AS (SELECT location_id, field, count(*) AS n_docs, sum(len(t)) / count(*) AS avg_dl FROM toks GROUP BY ALL)""", QUERY, POST, SCORED)
    + """ SELECT query_id, location_id, relative_path, rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, location_id
      ORDER BY round(score, 9) DESC, relative_path) AS rank FROM hit WHERE n >= n_terms) WHERE rank <= 20""",
    "search_lexical": search(DOCS, FIELDS, QUERY, "cand AS (SELECT query_id, location_id, relative_path FROM q, docs)",
                             "none AS (SELECT 0 AS query_id, '' AS location_id, '' AS relative_path, '' AS field, 0.0 AS score WHERE FALSE)",
                             signals(False, "none"))
    + """ SELECT query_id, location_id, relative_path, position AS rank, round(score, 4) AS score, matched_fields, match_reason FROM pos
      WHERE any_found QUALIFY row_number() OVER (PARTITION BY query_id, location_id ORDER BY score DESC, relative_path) <= 60""",
    "search_field_coverage": search(DOCS, FIELDS, QUERY, POST) + """ SELECT query_id, location_id, field, count(*) FILTER (n >= n_terms) AS documents,
      count(*) FILTER (n >= n_terms) > 0 AS matches FROM (SELECT query_id, location_id, relative_path, field, n_terms, count(*) AS n
      FROM post JOIN qt USING (term) GROUP BY ALL) GROUP BY ALL""",
    "search_unavailable": "SELECT n_nationkey % 5 AS query_id, 'n' || n_nationkey::VARCHAR AS location_id FROM nation WHERE n_nationkey % 2 <> 0",
    "postings_by_term": search(DOCS, FIELDS) + """ SELECT location_id, field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT location_id, relative_path, field, term, count(*) AS tf
      FROM (SELECT location_id, relative_path, field, unnest(t) AS term FROM toks) GROUP BY ALL) GROUP BY ALL""",
    "field_statistics": search(DOCS, FIELDS) + " SELECT location_id, field, n_docs, round(avg_dl, 4) AS avg_dl FROM stats",
    "analyze_tokens": f"""SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_hash, len(list_distinct(t))::INT AS n_distinct
      FROM (SELECT doc_id, {tok('text')} AS t FROM documents)""",
    "query_terms": f"SELECT item_id, array_to_string({qterms('text')}, ' ') AS terms FROM benchmark",
    "snippets": "WITH " + snippet_cte("documents", "text", qterms("string_split(text, ' ')[-1]"), "doc_id") + f" SELECT doc_id, {SNIP} AS snippet FROM s3",
    "highlights": "SELECT doc_id, regexp_replace(text, '(the|un|de|\\(x)', '<mark>\\1</mark>', 'gi') AS marked FROM documents",
    "filter_documents": f"WITH {DOCS} SELECT location_id, relative_path, type, status FROM docs WHERE type IN ('Type src1', 'Type src2', 'Type src3') AND list_has_any(tags, ['t1', 't2', 't5']) AND kind = 'concept' AND status IS NOT NULL AND finding_count > 0",
    "filter_freshness": f"WITH {DOCS} SELECT location_id, relative_path, stale_after, {FRESH} AS freshness FROM docs WHERE {FRESH} = 'stale' AND finding_count = 0",
    "path_prefix_search": f"WITH {DOCS} SELECT location_id, count(*) AS n FROM docs WHERE starts_with(relative_path, 'src1') GROUP BY 1",
    "path_prefix_listing": f"WITH {DOCS} SELECT location_id, count(*) AS n FROM docs WHERE starts_with(relative_path, 'src1/') GROUP BY 1",
    "quick_open": f"WITH {DOCS} SELECT location_id, relative_path FROM docs WHERE contains(lower(split_part(relative_path, '/', 2) || ' ' || relative_path), '42.md') ORDER BY 1, 2 LIMIT 100",
    "filter_concepts": f"WITH {PDOCS} SELECT location_id, left(relative_path, length(relative_path) - 3) AS id, type FROM pdocs WHERE type IN ('ECONOMY', 'PROMO') AND list_contains(tags, 'size7')",
    "findings_scope_policy": f"WITH {FIN} SELECT location_id, relative_path, code FROM fin WHERE doc_id % 10 <> 7",
    "filter_findings": f"WITH {FIN} SELECT location_id, relative_path, code, severity FROM fin WHERE severity = 'error' AND contains(lower(relative_path), 'docs\\1')",
    "filter_history": f"WITH {HIST} SELECT event_id, location_id, path FROM hist WHERE kind = 'renamed'",
    "ignored_paths": f"""WITH {DOCS} SELECT location_id, relative_path FROM docs WHERE CASE
      WHEN starts_with(relative_path, 'src3/') AND right(relative_path, 4)[1] NOT IN ('0','1','2','3','4') THEN FALSE
      WHEN starts_with(relative_path, 'src3/') OR starts_with(relative_path, 'src4/') THEN TRUE
      WHEN regexp_full_match(relative_path, 'src2/0000000[^/]\\.md') THEN TRUE WHEN relative_path LIKE '%7.md' THEN TRUE
      WHEN regexp_full_match(relative_path, 'src1/[^/]*0\\.md') THEN FALSE WHEN starts_with(relative_path, 'src1/') THEN TRUE ELSE FALSE END""",
    "pruned_directories": f"""WITH {PAGE}, f AS (SELECT page_id, position, (['a', 'Build', 'x/pods', 'out.d'])[position % 4 + 1] || '/' || regexp_replace(target, '^/+', '') || '.md' AS relative_path FROM hrefs)
      SELECT page_id, position::INT AS position, relative_path FROM f WHERE position % 4 IN (0, 3) AND NOT list_has_any(string_split(lower(relative_path), '/')[:-2],
        ['.git','.hg','.svn','node_modules','vendor','.venv','venv','__pycache__','target','dist','build','out','.next','pods','bin','obj','coverage'])""",
    "allowed_locations": "SELECT lang AS location_id, CASE WHEN lang NOT IN ('en', 'fr') THEN 'location_not_allowed' END AS error, count(*) AS n FROM documents GROUP BY ALL",
    "validated_requests": """SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'Choose at least one Location to search.' WHEN turn = 2 THEN 'The Location identifier is invalid.'
      WHEN strlen(text) > 1000 THEN 'The search query is too long.' WHEN conv_id % 7 = 0 THEN 'The findings filter is invalid.' END AS error,
      least(greatest(conv_id % 130, 1), 100)::INT AS search_limit, least(greatest(conv_id % 130, 1), 50)::INT AS related_limit, least(greatest(turn * 6, 1), 15)::INT AS activity_days FROM conversations""",
    "read_documents": f"WITH {PACK} SELECT location_id, relative_path, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN 1::BIGINT END AS generation, CASE WHEN NOT ok THEN 'document_not_found' END AS error FROM ref",
    "active_generation": f"WITH {DOCS} SELECT location_id, relative_path, (length(title) % 3)::INT AS generation FROM docs WHERE location_id <> 'es' AND length(title) % 3 = length(location_id) % 3 - 2",
    "active_filter_count": "SELECT doc_id, ((doc_id % 2 = 0)::INT + 2 + (doc_id % 3 <> 0)::INT + (doc_id % 5 = 0)::INT) AS n FROM documents",
    "split_front_matter": f"""WITH {PARTS}, b AS (SELECT *, '# ' || name || chr(10) || chr(10) || 'See [next](' || target || ') for more.' || chr(10) || chr(10)
       || CASE WHEN k % 6 = 0 THEN '```' || chr(10) || '# no heading [no](./none.md)' || chr(10) || '```' || chr(10) || chr(10) ELSE '' END
       || '## Details' || chr(10) || chr(10) || 'Size ' || size::VARCHAR || chr(10) AS tail,
      concat_ws(chr(10), CASE WHEN r <> 1 THEN 'type: ' || ptype END, 'title: ' || name || ' ' || k::VARCHAR, 'description: ' || brand || ' part',
       CASE WHEN r = 3 THEN 'tags: ' || brand ELSE 'tags: [' || brand || ', size' || size::VARCHAR || ']' END, 'timestamp: 2024-01-02',
       CASE r WHEN 4 THEN 'status: retired' WHEN 5 THEN 'okf_version: 0.9' WHEN 6 THEN 'stale_after: 2020-01-01' WHEN 7 THEN 'stale_after: 2099-01-01' WHEN 8 THEN 'status: draft' WHEN 9 THEN 'resource: ../../outside.md' END,
       CASE k % 3 WHEN 0 THEN 'verified:' || chr(10) || '  - by: human:a' || chr(10) || '    at: 2024-01-03' WHEN 1 THEN 'verified: {{ by: process:n, at: 2024-01-03 }}' END,
       CASE WHEN k % 7 = 0 THEN 'generated:' || chr(10) || '  at: 2024-01-05T00:00:00Z' END) AS yaml,
      CASE WHEN review_lines > 0 THEN length('{MARK}') + 1 + length('{{"comments":[{{"id":"c' || k::VARCHAR || '","quote":"' || name || '","comment":"check <it>","createdAt":"2024-01-01"}}]}}') + 1 + 4 ELSE 0 END AS review_size FROM parts)
      SELECT location_id, relative_path, CASE r WHEN 0 THEN 'none' WHEN 2 THEN 'unclosed' ELSE 'closed' END AS front_state,
       CASE WHEN NOT bare THEN md5(yaml) END AS yaml_hash, md5(CASE WHEN r = 2 THEN '---' || chr(10) || yaml || chr(10) || tail ELSE tail END) AS body_hash,
       (CASE WHEN bare THEN 0 ELSE length(yaml) + 9 END + review_size)::INT AS body_offset FROM b""".replace("{{ by", "{ by").replace("03 }}'", "03 }'"),
    "inspected_documents": f"""WITH {PDOCS}, {ROOTS} SELECT location_id, relative_path, 'concept' AS kind, title, CASE WHEN NOT bare THEN brand || ' part' END AS description, type,
      array_to_string(tags, '|') AS tags, name || ' Details' AS headings_text,
      CASE WHEN bare THEN '' ELSE concat_ws(' ', CASE WHEN r <> 1 THEN 'type ' || ptype END, 'title ' || title, 'description ' || brand || ' part', 'tags ' || array_to_string(tags, ' '),
        'timestamp 2024-01-02', CASE r WHEN 4 THEN 'status retired' WHEN 5 THEN 'okf_version 0.9' WHEN 6 THEN 'stale_after 2020-01-01' WHEN 7 THEN 'stale_after 2099-01-01'
        WHEN 8 THEN 'status draft' WHEN 9 THEN 'resource ../../outside.md' END, CASE k % 3 WHEN 0 THEN 'verified by human:a at 2024-01-03' WHEN 1 THEN 'verified by process:n at 2024-01-03' END,
        CASE WHEN k % 7 = 0 THEN 'generated at 2024-01-05T00:00:00Z' END) END AS metadata_text,
      status, trust_tier, stale_after, timestamp, finding_count::BIGINT AS finding_count, r NOT IN (0, 1, 2) AS is_conformant FROM pdocs
      UNION ALL SELECT location_id, 'index.md' AS relative_path, 'index' AS kind, 'Bundle of ' || n::VARCHAR AS title, NULL::VARCHAR AS description,
      NULL::VARCHAR AS type, '' AS tags, 'Bundle of ' || n::VARCHAR AS headings_text, CASE WHEN location_id = 'b0' THEN 'okf_version 0.2' ELSE '' END AS metadata_text, NULL::VARCHAR AS status,
      NULL::VARCHAR AS trust_tier, NULL::VARCHAR AS stale_after, NULL::VARCHAR AS timestamp, 0::BIGINT AS finding_count, TRUE AS is_conformant FROM roots""",
    "inspected_links": f"WITH {PLINKS} SELECT * FROM plinks",
    "document_findings": f"""WITH {FINDINGS} SELECT *, NULL::INT AS start_line FROM fndx""",
    "bundle_findings": f"""WITH {FINDINGS}, x AS (SELECT location_id, code, severity, tier FROM fndx UNION ALL SELECT location_id, 'OKF_LINK_BROKEN', 'warning', 'hygiene' FROM parts WHERE k % 11 = 0
      UNION ALL SELECT 'b2', 'OKF_LINK_BROKEN', 'warning', 'hygiene') SELECT location_id, code, severity, tier, count(*) AS n FROM x GROUP BY ALL""",
    "concepts": f"""WITH {PDOCS} SELECT location_id, left(relative_path, length(relative_path) - 3) AS id, coalesce(type, 'Unclassified') AS type,
      CASE WHEN bare THEN substr(relative_path, 10, 7) ELSE title END AS title, array_to_string(tags, '|') AS tags, timestamp FROM pdocs""",
    "document_kinds": f"WITH {PAGE} SELECT page_id, position::INT AS position, CASE position % 4 WHEN 0 THEN 'index' WHEN 2 THEN 'concept' ELSE 'log' END AS kind FROM hrefs",
    "search_text_projection": f"""WITH {DOCS} SELECT location_id, relative_path, md5(concat_ws(chr(10), nullif(title, ''), nullif(description, ''), nullif(type, ''), nullif(tags_text, ''),
      relative_path, nullif(headings_text, ''), nullif(body, ''), metadata_text)) AS search_text_hash FROM docs""",
    "content_hashes": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "source_positions": """SELECT doc_id, (length(p) - length(replace(p, chr(10), '')) + 1)::INT AS line, (length(string_split(p, chr(10))[-1]) + 1)::INT AS column
      FROM (SELECT doc_id, left(text, doc_id * 7919 % (length(text) + 1)) AS p FROM documents)""",
    "log_entries": f"WITH {LOGS} SELECT location_id, relative_path, scope, date, summary FROM entries",
    "recent_logs": f"""WITH {LOGS} SELECT location_id, rank::INT AS rank, relative_path, date, summary FROM (SELECT *, row_number() OVER (PARTITION BY location_id
      ORDER BY date DESC NULLS LAST, relative_path, ord) AS rank FROM entries) WHERE rank <= 20""",
    "review_comments": f"""WITH {PARTS} SELECT location_id, relative_path, 0 AS position, 'c' || k::VARCHAR AS id, name AS quote, 'check <it>' AS comment, '2024-01-01' AS created_at,
      NULL::VARCHAR AS error FROM parts WHERE review_lines > 0""",
    "review_handoff": f"""WITH {PARTS} SELECT location_id, relative_path, 'Review the following Markdown document and address every open Workspace review comment.

File: ' || relative_path || '

<review-comments>
<comment id="c' || k::VARCHAR || '">
<quote>' || name || '</quote>
<feedback>check &lt;it&gt;</feedback>
</comment>
</review-comments>

The comments are also embedded in the document''s workspace-review:v1 block.
Update the document itself. Remove comments you addressed from that block and preserve unresolved comments.' AS text FROM parts WHERE review_lines > 0""",
    "create_anchors": f"WITH {ANCHORS} SELECT doc_id, quote, start::INT AS start, (start + n)::INT AS end, substr(coll, greatest(start - 80, 0) + 1, start - greatest(start - 80, 0)) AS prefix, substr(coll, start + n + 1, 80) AS suffix FROM made",
    "resolve_anchors": f"""WITH {ANCHORS}, mk AS (SELECT doc_id, quote, n, start AS a_start, substr(coll, greatest(start - 80, 0) + 1, start - greatest(start - 80, 0)) AS prefix, substr(coll, start + n + 1, 80) AS suffix,
       {collapse("CASE doc_id % 3 WHEN 0 THEN body WHEN 1 THEN 'Preface text. ' || body ELSE 'Preface text. ' || substr(body, 60) END")} AS txt FROM made),
      pc AS (SELECT doc_id, unnest(string_split(txt, quote)) AS piece, generate_subscripts(string_split(txt, quote), 1) AS i FROM mk),
      ps AS (SELECT doc_id, i, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS before, count(*) OVER (PARTITION BY doc_id) AS pieces FROM pc),
      oc AS (SELECT mk.*, (before + (i - 1) * n)::BIGINT AS p FROM ps JOIN mk USING (doc_id) WHERE i < pieces),
      ok AS (SELECT *, prefix = '' OR substr(txt, greatest(p - length(prefix), 0) + 1, p - greatest(p - length(prefix), 0)) = prefix AS b, suffix = '' OR substr(txt, p + n + 1, length(suffix)) = suffix AS a FROM oc),
      ag AS (SELECT doc_id, count(*) AS total, min(p) AS one, count(*) FILTER (a AND b) AS nc, min(p) FILTER (a AND b) AS pc, count(*) FILTER (b) AS nb, min(p) FILTER (b) AS pb, count(*) FILTER (a) AS na, min(p) FILTER (a) AS pa FROM ok GROUP BY 1),
      rl AS (SELECT mk.doc_id, mk.n, CASE WHEN a_start >= 0 AND substr(txt, a_start + 1, n) = quote THEN 'exact' WHEN total = 1 THEN 'unique' WHEN nc = 1 THEN 'context' WHEN prefix <> '' AND nb = 1 THEN 'prefix'
         WHEN suffix <> '' AND na = 1 THEN 'suffix' ELSE 'detached' END AS rule, a_start, one, pc, pb, pa FROM mk LEFT JOIN ag USING (doc_id))
      SELECT doc_id, s::INT AS start, (s + n)::INT AS end, rule FROM (SELECT *, CASE rule WHEN 'exact' THEN a_start WHEN 'unique' THEN one WHEN 'context' THEN pc WHEN 'prefix' THEN pb WHEN 'suffix' THEN pa END AS s FROM rl)""",
    "search_facets": f"""WITH {DOCS}, v AS (SELECT 'type' AS dimension, type AS value FROM docs UNION ALL SELECT 'role', kind FROM docs UNION ALL SELECT 'status', status FROM docs
      UNION ALL SELECT 'trust', trust_tier FROM docs UNION ALL SELECT 'freshness', {FRESH} FROM docs UNION ALL SELECT 'tag', unnest(tags) FROM docs)
      SELECT dimension, value, count(*) AS count FROM v WHERE value <> '' GROUP BY ALL""",
    "concept_facets": f"""WITH {PDOCS}, v AS (SELECT location_id, 'type' AS dimension, coalesce(type, 'Unclassified') AS value FROM pdocs UNION ALL SELECT location_id, 'tag', unnest(tags) FROM pdocs)
      SELECT location_id, dimension, value, count(*) AS count FROM v GROUP BY ALL""",
    "visible_tags": f"""WITH {PDOCS}, v AS (SELECT location_id, value, count(*) AS count FROM (SELECT location_id, unnest(tags) AS value FROM pdocs) GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY count DESC, value) AS rank FROM v)
      SELECT location_id, value, count, least(rank, 21)::INT AS rank FROM r WHERE rank <= 20 OR value = 'size50'""",
    "link_health": f"WITH {PLINKS} SELECT location_id, count(*) FILTER (status = 'resolved') AS resolved_links, count(*) FILTER (status = 'unresolved') AS unresolved_links FROM plinks GROUP BY 1",
    "lint_summary": f"WITH {FIN} SELECT location_id, errors, warnings, info, errors + warnings > 0 AS failed FROM sums",
    "grouped_findings": f"""WITH {FIN} SELECT location_id, code, first(severity ORDER BY relative_path, l, c, message) AS severity, count(*) AS size FROM fin GROUP BY ALL""",
    "detected_bundles": f"""WITH {PARTS}, {ROOTS} SELECT location_id, CASE WHEN location_id = 'b0' THEN '0.2' END AS declared_version, count(*) + (location_id IN ('b0', 'b2'))::INT AS document_count,
      location_id IN ('b0', 'b2') AS detected, location_id IN ('b0', 'b1') AS enabled FROM parts GROUP BY location_id""",
    "finding_count_per_document": f"""WITH {FIN} SELECT 'f' || (d.doc_id % 3)::VARCHAR AS location_id, (CASE WHEN d.doc_id % 4 = 0 THEN 'Docs' ELSE 'docs' END) || '\\' || d.doc_id::VARCHAR || '.md' AS relative_path,
      (SELECT count(*) FROM fin WHERE fin.doc_id = d.doc_id) AS finding_count FROM documents d""",
    "storage_sizes": "SELECT lang AS location_id, sum(n_chars)::BIGINT AS bytes, count(*) AS documents FROM documents GROUP BY 1",
    "location_list": """SELECT 'n' || n_nationkey::VARCHAR AS location_id, n_name AS name, CASE WHEN n_nationkey IN (4, 8) THEN 'ready' ELSE 'notIndexed' END AS state,
      n_nationkey IN (4, 8) AS searchable FROM nation WHERE n_nationkey % 2 = 0""",
    "changed_signatures": f"""WITH {SNAP}, a AS (SELECT location_id, concat_ws(':', count(*)::VARCHAR, sum(('0x' || substr({SIG}, 1, 12))::BIGINT)::VARCHAR, sum(('0x' || substr({SIG}, 13, 12))::BIGINT)::VARCHAR) AS signature FROM aft GROUP BY 1),
      b AS (SELECT location_id, concat_ws(':', count(*)::VARCHAR, sum(('0x' || substr({SIG}, 1, 12))::BIGINT)::VARCHAR, sum(('0x' || substr({SIG}, 13, 12))::BIGINT)::VARCHAR) AS signature FROM bef GROUP BY 1)
      SELECT * FROM a WHERE (location_id, signature) NOT IN (SELECT (location_id, signature) FROM b)""",
    "index_status": f"""WITH {SNAP} SELECT location_id, count(*) FILTER (change <> 'removed') AS discovered, count(*) FILTER (change IN ('added', 'changed')) AS changed,
      count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change <> 'removed') AS indexed,
      count(*) FILTER (change <> 'removed' AND location_id = 's1' AND size % 1000 = 7) AS failed,
      CASE WHEN count(*) FILTER (change <> 'removed' AND location_id = 's1' AND size % 1000 = 7) > 0 THEN 'degraded' ELSE 'ready' END AS state FROM dif GROUP BY 1""",
    "activity_daily": f"""WITH {ACT} SELECT location_id, day, relative_path, changed_count, served_count, context_count, created_count, removed_count,
      strftime(last_changed, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS last_changed_at, strftime(last_served, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS last_served_at FROM daily""",
    "activity_top": f"""WITH {ACT}, t AS (SELECT location_id, relative_path, sum(changed_count)::BIGINT AS changed_count, sum(served_count)::BIGINT AS served_count, sum(context_count)::BIGINT AS context_count,
      sum(created_count)::BIGINT AS created_count, sum(removed_count)::BIGINT AS removed_count FROM daily WHERE day >= '2024-01-06' AND starts_with(relative_path, 'doc-1') GROUP BY ALL),
      r AS (SELECT *, changed_count + served_count + context_count + created_count + removed_count AS total FROM t)
      SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY total DESC, relative_path)::INT AS rank FROM r QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY total DESC, relative_path) <= 20""",
    "activity_expired": f"WITH {ACT} SELECT location_id, day, relative_path, changed_count FROM daily WHERE day >= '2024-01-11'",
    "activity_from_outputs": f"WITH {PACK} SELECT location_id, '2024-01-31' AS day, relative_path, count(*) AS served_count, 0::BIGINT AS context_count FROM ref WHERE ok GROUP BY ALL",
    "location_overview": f"""WITH RECURSIVE {PLINKS}, {ACT}, {LOGS}, dx AS (SELECT location_id, type, tags, 'concept' AS role, status, trust_tier, finding_count FROM pdocs
       UNION ALL SELECT location_id, NULL, []::VARCHAR[], 'index', NULL, NULL, 0 FROM roots),
      v AS (SELECT location_id, 'facet:type' AS section, type AS key FROM dx UNION ALL SELECT location_id, 'facet:role', role FROM dx UNION ALL SELECT location_id, 'facet:status', status FROM dx
       UNION ALL SELECT location_id, 'facet:trust', trust_tier FROM dx UNION ALL SELECT location_id, 'facet:tag', unnest(tags) FROM dx),
      t AS (SELECT location_id, relative_path, sum(changed_count + served_count + context_count + created_count + removed_count)::BIGINT AS total FROM daily WHERE day >= '2024-01-06' GROUP BY ALL),
      lg AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY date DESC NULLS LAST, relative_path, ord) AS rank FROM entries)
      SELECT location_id, section, key, NULL::VARCHAR AS value, count(*) AS count FROM v WHERE key <> '' GROUP BY ALL
      UNION ALL SELECT location_id, 'findings', 'total', NULL, sum(finding_count)::BIGINT FROM dx GROUP BY 1
      UNION ALL SELECT location_id, 'links', 'resolved', NULL, count(*) FILTER (status = 'resolved') FROM plinks GROUP BY 1
      UNION ALL SELECT location_id, 'links', 'unresolved', NULL, count(*) FILTER (status = 'unresolved') FROM plinks GROUP BY 1
      UNION ALL SELECT replace(location_id, 'c', 'b'), 'log', lpad(rank::VARCHAR, 2, '0') || ' ' || relative_path, concat_ws(': ', date, summary), 1 FROM lg WHERE rank <= 20
      UNION ALL SELECT replace(location_id, 'u', 'b'), 'activity', relative_path, NULL, total FROM t QUALIFY row_number() OVER (PARTITION BY location_id ORDER BY total DESC, relative_path) <= 20""",
    "lint_annotations": f"""WITH {FIN} SELECT location_id, relative_path, '::' || CASE severity WHEN 'info' THEN 'notice' ELSE severity END || ' file=kb/' || replace(relative_path, '\\', '/')
      || CASE WHEN l IS NULL THEN '' ELSE ',line=' || l::VARCHAR || ',col=' || c::VARCHAR || ',endLine=' || l::VARCHAR || ',endColumn=' || ec::VARCHAR END || ',title=' || code
      || '::Check | document%2C 100%25%3A ' || doc_id::VARCHAR AS annotation,
      '| ' || severity || ' | `' || code || '` | `' || relative_path || CASE WHEN l IS NULL THEN '' ELSE ':' || l::VARCHAR END || '` | Check \\| document, 100%: ' || doc_id::VARCHAR || ' |' AS row FROM fin""",
    "lint_report": f"""WITH {FIN}, b AS (SELECT location_id, string_agg(chr(10) || upper(severity) || ' ' || code || ' ' || {PLACE} || chr(10) || '  ' || message || chr(10), '' ORDER BY position) FILTER (position <= 30) AS lines FROM finr GROUP BY 1)
      SELECT location_id, errors, warnings, info, errors > 0 AS failed, documents > 30 AS truncated,
      'OKF lint: Bundle ' || location_id || chr(10) || lines || CASE WHEN documents > 30 THEN chr(10) || 'Output limited to 30 of ' || documents::VARCHAR || ' findings.' || chr(10) ELSE '' END
      || chr(10) || 'Summary: ' || documents::VARCHAR || CASE WHEN documents = 1 THEN ' document' ELSE ' documents' END || CASE WHEN documents % 2 = 1 THEN ' · 1 document ignored' ELSE '' END
      || ' · ' || errors::VARCHAR || CASE WHEN errors = 1 THEN ' error' ELSE ' errors' END || ' · ' || warnings::VARCHAR || CASE WHEN warnings = 1 THEN ' warning' ELSE ' warnings' END
      || ' · ' || info::VARCHAR || ' info' || chr(10) || 'Result: ' || CASE WHEN errors > 0 THEN 'failed' ELSE 'passed' END || chr(10) AS text FROM sums JOIN b USING (location_id)""",
    "job_summary_head": f"""WITH {FIN} SELECT location_id, '**' || documents::VARCHAR || ' documents · ' || errors::VARCHAR || ' errors · ' || warnings::VARCHAR || ' warnings · ' || info::VARCHAR || ' info**

Failure threshold: `error`' || CASE WHEN documents > 30 THEN ' · findings truncated by the CLI output limit' ELSE '' END || '

| Severity | Code | Location | Finding |
| --- | --- | --- | --- |' AS head FROM sums""",
    "health_handoff": f"""WITH {FIN} SELECT location_id, 0 AS block, NULL::VARCHAR AS code, NULL::VARCHAR AS relative_path, 'Review and fix the OKF findings in the "Bundle ' || location_id || '" bundle.

Preserve the author''s content and all unknown frontmatter fields. Do not invent metadata values or impose a closed type taxonomy. Inspect each document before choosing a missing type. Do not rewrite the bundle automatically beyond the findings you verify.

<okf-lint scope="repository policy (.workspaceignore applied)" documents="' || documents::VARCHAR || '" errors="' || errors::VARCHAR || '" warnings="' || warnings::VARCHAR || '" info="' || info::VARCHAR || '">
' AS text FROM sums
      UNION ALL SELECT location_id, 2, NULL, NULL, '</okf-lint>

After making changes, run the OKF linter again and report the remaining findings.' FROM sums
      UNION ALL SELECT location_id, 1, code, relative_path, '<violation code="' || code || '" severity="' || severity || '" location="' || {PLACE} || '">' || chr(10) || message || chr(10) || '</violation>' FROM fin""",
    "exported_references": f"""WITH {PACK} SELECT pack_id AS selection_id, pos + 2 AS line_no, '- Turn ' || pos::VARCHAR || ' — ' || CASE WHEN location_id = 'user' THEN 'NATION_1' ELSE location_id END || ':' || relative_path || ' (body match)' AS line FROM ref
      UNION ALL SELECT DISTINCT pack_id, 0, 'Selected Workspace references:' FROM ref UNION ALL SELECT DISTINCT pack_id, 1, '' FROM ref""",
    "related_documents": f"""WITH {REL} SELECT location_id, relative_path, other, direction, CASE direction WHEN 'mutual' THEN 'Linked in both directions with ' WHEN 'outgoing' THEN 'Linked from ' ELSE 'Links to ' END || relative_path AS reason,
      NULL::VARCHAR AS fragment, rank::INT AS rank FROM relx WHERE rank <= 3""",
    "related_counts": f"WITH {REL} SELECT location_id, relative_path, count(*) FILTER (o) AS outgoing_count, count(*) FILTER (i) AS incoming_count, greatest(count(*) - 3, 0) AS omitted_count FROM relx GROUP BY 1, 2",
    "backlinks": f"WITH {REL} SELECT DISTINCT location_id, s AS other, t AS relative_path, title FROM lk JOIN alld ON alld.location_id = lk.location_id AND alld.relative_path = s".replace("SELECT DISTINCT location_id, s", "SELECT DISTINCT lk.location_id AS location_id, s"),
    "concept_edges": f"WITH {EDGES} SELECT DISTINCT * FROM edges",
    "undirected_edges": f"WITH {EDGES} SELECT DISTINCT location_id, least(source, target) AS a, greatest(source, target) AS b FROM edges",
    "concept_degrees": f"WITH {EDGES} SELECT location_id, relative_path, degree FROM deg",
    "top_concepts": f"""WITH {EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY degree DESC, relative_path) AS rank FROM deg)
      SELECT location_id, relative_path, degree, rank::INT AS rank, rank <= 24 AS labelled FROM r WHERE rank <= 300""",
    "hidden_concepts": f"WITH {PARTS} SELECT location_id, greatest(count(*) - 300, 0) AS hidden FROM parts GROUP BY 1",
    "refreshed_links": f"""WITH {PLINKS}, kept AS (SELECT location_id, relative_path FROM parts WHERE k % 7 <> 3) SELECT l.location_id, l.origin,
      CASE WHEN l.target_relative_path IS NULL THEN l.status WHEN kept.relative_path IS NOT NULL THEN 'resolved' ELSE 'unresolved' END AS status, count(*) AS n
      FROM plinks l LEFT JOIN kept ON kept.location_id = l.location_id AND kept.relative_path = l.target_relative_path GROUP BY ALL""",
    "resolved_targets": f"""WITH {PAGE}, p AS (SELECT *, (['', '..', '../../..', './a%20b/..'])[position % 4 + 1] || target AS link FROM hrefs),
      u AS (SELECT *, split_part(split_part(link, '#', 1), '?', 1) AS path FROM p),
      f AS (SELECT *, '/' || array_to_string({foldup("CASE WHEN starts_with(path, '/') THEN '/data/site/' || url_decode(path) ELSE '/data/site/kb/notes/' || url_decode(path) END")}, '/') AS full_path FROM u)
      SELECT page_id, position::INT AS position, link, CASE WHEN contains(link, '#') THEN substr(link, instr(link, '#') + 1) END AS fragment,
      CASE WHEN path = '' THEN 'kb/notes/page.md' WHEN regexp_matches(path, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(path, '//') THEN NULL
       WHEN starts_with(full_path || '/', '/data/site/') THEN substr(full_path, 12) END AS target_relative_path,
      CASE WHEN path = '' THEN 'fragment' WHEN regexp_matches(path, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(path, '//') THEN 'external'
       WHEN starts_with(full_path || '/', '/data/site/') THEN 'candidate' ELSE 'outsideBundle' END AS status FROM f""",
    "assigned_locations": f"""WITH {PAGE}, p AS (SELECT target || '/x' || (page_id % 25)::VARCHAR || '/f.md' AS path FROM hrefs),
      l AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN '/de' ELSE '/de/x' || n_nationkey::VARCHAR END AS root, min('n' || n_nationkey::VARCHAR) AS location_id FROM nation GROUP BY 1)
      SELECT p.path, (SELECT arg_max(location_id, length(root)) FROM l WHERE p.path = root OR starts_with(p.path, root || '/')) AS location_id FROM p""",
    "snapshot_diff": f"WITH {SNAP} SELECT * FROM dif",
    "removed_paths": f"WITH {SNAP} SELECT location_id, relative_path FROM dif WHERE change = 'removed'",
    "touched_sources": f"WITH {SNAP} SELECT location_id, relative_path FROM dif WHERE change <> 'unchanged'",
    "carried_ids": f"""WITH {SNAP} SELECT location_id, relative_path, CASE WHEN change = 'added' THEN sha256(concat_ws(':', location_id, relative_path, modified_at_ms::VARCHAR)) ELSE 'id-' || relative_path END AS continuity_id
      FROM dif WHERE change <> 'removed'""",
    "matched_renames": f"WITH {MOVED} SELECT * FROM ren",
    "matched_renames_long_chains": """WITH RECURSIVE moved AS (SELECT 's' || (o_custkey % 4)::VARCHAR AS location_id, o_custkey % 50 AS size, o_orderkey % 3 AS side,
      'o' || lpad(o_orderkey::VARCHAR, 9, '0') || '.md' AS path, 1700000000000 + o_orderkey * 7 AS at FROM orders),
      gone AS (SELECT *, row_number() OVER (PARTITION BY location_id, size ORDER BY path) AS no FROM moved WHERE side = 0),
      walk AS (SELECT DISTINCT location_id, size, 0::BIGINT AS no, NULL::VARCHAR AS previous_path, NULL::VARCHAR AS relative_path, []::VARCHAR[] AS taken FROM gone
       UNION ALL SELECT w.location_id, w.size, g.no, g.path, min(a.path), list_append(any_value(w.taken), min(a.path)) FROM walk w
        JOIN gone g ON g.location_id = w.location_id AND g.size = w.size AND g.no = w.no + 1
        LEFT JOIN moved a ON a.side = 1 AND a.location_id = g.location_id AND a.size = g.size AND abs(a.at - g.at) < 2500 AND NOT list_contains(w.taken, a.path)
        GROUP BY w.location_id, w.size, g.no, g.path)
      SELECT location_id, previous_path, relative_path FROM walk WHERE relative_path IS NOT NULL""",
    "change_events": f"""WITH {MOVED} SELECT location_id, relative_path AS path, previous_path, 'renamed' AS kind, 1700000000000 AS observed_at, TRUE AS available FROM ren
      UNION ALL SELECT location_id, relative_path, NULL, CASE change WHEN 'added' THEN 'created' WHEN 'removed' THEN 'removed' ELSE 'modified' END, 1700000000000, change <> 'removed' FROM moved
      WHERE relative_path NOT IN (SELECT relative_path FROM ren UNION ALL SELECT previous_path FROM ren)""",
    "file_identity": f"WITH RECURSIVE {IDENT} SELECT DISTINCT location_id, path, identity FROM hist JOIN ident ON ident.node = hist.user_id",
    "deduped_history": f"""WITH RECURSIVE {IDENT} SELECT event_id, location_id, path, kind, observed_at FROM hist JOIN ident ON ident.node = hist.user_id
      QUALIFY row_number() OVER (PARTITION BY identity ORDER BY observed_at DESC, event_id) = 1""",
    "capped_history": f"WITH {HIST} SELECT event_id, observed_at FROM hist WHERE observed_at >= 1706745600000 - 20 * 86400000 ORDER BY observed_at DESC, event_id LIMIT 700",
    "recent_searches": """WITH s AS (SELECT user_id, max(event_id) AS search_id, event_type AS query, (event_id % 7)::VARCHAR AS filters FROM events GROUP BY user_id, event_type, event_id % 7)
      SELECT user_id, search_id, query, filters, row_number() OVER (PARTITION BY user_id ORDER BY search_id DESC)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY search_id DESC) <= 20""",
    "listed_documents": f"WITH {LISTREQ} SELECT request_id, location_id, relative_path, position::INT AS position FROM listed WHERE position <= 2",
    "listed_second_page": f"WITH {LISTREQ} SELECT request_id, location_id, relative_path, (position - 2)::INT AS position FROM listed WHERE position IN (3, 4)",
    "rejected_cursors": f"""WITH {LISTREQ} SELECT request_id, CASE WHEN request_id LIKE '%1' THEN 'The document list cursor does not match this request.'
      WHEN request_id LIKE '%2' THEN 'The document list cursor no longer matches the active index generation.' WHEN request_id LIKE '%3' THEN 'The document list cursor is invalid.' END AS error
      FROM listed GROUP BY request_id HAVING count(*) > 2""",
    "sorted_findings": f"WITH {FIN} SELECT location_id, position::INT AS position, relative_path, code, severity FROM finr WHERE position <= 40",
    "distinct_tags": "SELECT doc_id, array_to_string(list_sort(list_distinct([source, lang, 'en'])), '|') AS tags FROM documents",
    "pack_selection": f"WITH {PACK} SELECT pack_id, pos, location_id, relative_path, omission, reason, prefix_length::INT AS prefix_length, available::INT AS available FROM cut",
    "pack_omissions": f"""WITH {PACK} SELECT pack_id, row_number() OVER (PARTITION BY pack_id ORDER BY (omission = 'Character budget reached')::INT, pos)::INT AS position, location_id, relative_path, omission AS reason FROM cut WHERE omission IS NOT NULL""",
    "pack_totals": f"WITH {PACK} SELECT pack_id, count(*) FILTER (omission IS NULL) AS included, count(*) FILTER (omission IS NOT NULL) AS omitted, TRUE AS fits FROM cut GROUP BY 1",
    "even_fill": f"""WITH {LEN}, t AS (SELECT *, least(n, 160) AS tgt FROM len0), lv AS (SELECT pack_id, max(l) AS lvl FROM (SELECT pack_id, l, any_value(budget) AS budget, sum(least(tgt, l)) AS used
       FROM t, range(0, 161) r(l) GROUP BY ALL) WHERE used <= budget GROUP BY 1), u AS (SELECT t.*, lvl, tgt > lvl AS o, budget - sum(least(tgt, lvl)) OVER (PARTITION BY pack_id) AS rest FROM t JOIN lv USING (pack_id)),
      p AS (SELECT *, sum(o::INT) OVER (PARTITION BY pack_id ORDER BY pos) AS place FROM u)
      SELECT pack_id, pos, (least(tgt, lvl) + CASE WHEN o AND place <= rest THEN 1 ELSE 0 END)::INT AS allocated FROM p""",
    "proportional_split": f"""WITH {LEN}, t AS (SELECT *, least(n, 10) AS base, n - least(n, 10) AS need FROM len0), w AS (SELECT *, sum(need) OVER (PARTITION BY pack_id) AS total FROM t),
      b AS (SELECT *, least(budget, total) AS bb FROM w), f AS (SELECT *, CASE WHEN total > 0 THEN (bb * need) // total ELSE 0 END AS fl, CASE WHEN total > 0 THEN (bb * need) % total ELSE 0 END AS rm FROM b),
      r AS (SELECT *, bb - sum(fl) OVER (PARTITION BY pack_id) AS rest, row_number() OVER (PARTITION BY pack_id ORDER BY (fl < need)::INT DESC, rm DESC, need DESC, pos) AS place FROM f)
      SELECT pack_id, pos, (base + fl + CASE WHEN place <= rest AND fl < need THEN 1 ELSE 0 END)::INT AS allocated FROM r""",
    "folded_text": f"SELECT doc_id, md5({fold('text')}) AS folded_hash FROM documents",
    "normalized_paths": f"""WITH {PAGE}, r AS (SELECT *, './a\\' || target || '//b/./' || CASE WHEN position % 2 = 0 THEN 'c\\' ELSE 'c' END AS raw FROM hrefs),
      s AS (SELECT *, regexp_replace(replace(raw, '\\', '/'), '/+$', '') AS sl, array_to_string(list_filter(string_split(replace(raw, '\\', '/'), '/'), lambda p: p NOT IN ('', '.')), '/') AS path FROM r)
      SELECT page_id, position::INT AS position, path, path || CASE WHEN position % 2 = 0 THEN '/' ELSE '' END AS prefix, left(sl, length(sl) - 2) AS parent, 'c' AS base FROM s""",
    "path_identities": f"""WITH {PAGE}, r AS (SELECT *, (['C:\\Docs', '\\\\?\\C:\\Docs', '\\\\?\\UNC\\Srv', '/Home'])[position % 4 + 1] || target || '/' AS raw FROM hrefs),
      s AS (SELECT *, replace(raw, '\\', '/') AS sl, regexp_replace(replace(raw, '/', '\\'), '\\\\+$', '') AS bk FROM r)
      SELECT page_id, position::INT AS position, regexp_replace(CASE position % 4 WHEN 0 THEN lower(sl) WHEN 1 THEN lower(substr(sl, 5)) WHEN 2 THEN '//' || lower(substr(sl, 9)) ELSE sl END, '/+$', '') AS identity,
      CASE WHEN position % 4 IN (1, 2) THEN regexp_extract(bk, '^(.*)\\\\[^\\\\]*$', 1) ELSE regexp_extract(regexp_replace(sl, '/+$', ''), '^(.*)/[^/]*$', 1) END AS parent FROM s""",
    "split_link_targets": """SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS path, CASE WHEN contains(url, '#') THEN substr(url, instr(url, '#') + 1) END AS fragment,
      regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AS external FROM pages""",
    "decoded_paths": f"WITH {PAGE} SELECT page_id, position::INT AS position, url_decode('a+b%20c%') || url_decode(replace(target, 'e', '%65')) || '%zz' AS decoded FROM hrefs",
    "dot_folded_paths": f"WITH {PAGE} SELECT page_id, position::INT AS position, '/' || array_to_string({foldup(chr(39) + '/a/./b/..' + chr(39) + ' || target || ' + chr(39) + '/../../z/..//q' + chr(39))}, '/') AS folded FROM hrefs",
    "escaped_texts": """WITH t AS (SELECT page_id, html || '|''' || chr(10) AS x FROM pages), e AS (SELECT *, replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml FROM t)
      SELECT page_id, md5(xml) AS xml, md5(replace(replace(xml, '"', '&quot;'), '''', '&apos;')) AS attribute,
      md5(replace(replace(replace(replace(replace(x, '%', '%25'), chr(13), '%0D'), chr(10), '%0A'), ':', '%3A'), ',', '%2C')) AS command, md5(replace(replace(x, '|', '\\|'), chr(10), ' ')) AS cell FROM e""",
    "display_values": f"""WITH {DOCS} SELECT location_id, relative_path, CASE trust_tier WHEN 'humanReviewed' THEN 'Human Reviewed' WHEN 'machineConfirmed' THEN 'Machine Confirmed' WHEN 'unverified' THEN 'Unverified' END AS label,
      CASE WHEN d < 60000 THEN 'now' WHEN d < 3600000 THEN (d // 60000)::VARCHAR || 'm' ELSE (d // 3600000)::VARCHAR || 'h' END AS age, finding_count::VARCHAR || CASE WHEN finding_count = 1 THEN ' finding' ELSE ' findings' END AS counted
      FROM (SELECT *, greatest(0, 1700000900000 - modified_at_ms) AS d FROM docs)""",
    "surrogate_keys": f"WITH {DOCS} SELECT location_id, relative_path, sha256(concat_ws(':', location_id, generation::VARCHAR, relative_path)) AS key FROM docs",
    "cursor_round_trip": f"""WITH {DOCS} SELECT location_id, relative_path, rtrim(translate(base64(encode('{{"version":1,"location_id":"' || location_id || '","generation":1,"after_relative_path":"' || relative_path || '","request_hash":"h"}}')), '+/', '-_'), '=') AS cursor,
      relative_path AS after FROM docs""",
    "collapsed_text": f"SELECT page_id, md5({collapse('html')}) AS collapsed_hash FROM pages",
}

ORACLES["search_stored_index"] = ORACLES["search_candidates"]
ORACLES["streamed_activity"] = ORACLES["activity_daily"]
ORACLES["streamed_history"] = ORACLES["deduped_history"]
ORACLES["streamed_activity_retained"] = f"SELECT * FROM ({ORACLES['activity_daily']}) WHERE day >= (SELECT strftime(max(ts) - INTERVAL 14 DAYS, '%Y-%m-%d') FROM events)"
RECENT = IDENT.replace("FROM events)", "FROM events WHERE epoch_us(ts) // 1000 >= (SELECT max(epoch_us(ts) // 1000) FROM events) - 20 * 86400000)", 1)
ORACLES["streamed_history_retained"] = f"""WITH RECURSIVE {RECENT}, newest AS (SELECT event_id, location_id, path, kind, observed_at FROM hist JOIN ident ON ident.node = hist.user_id
  QUALIFY row_number() OVER (PARTITION BY identity ORDER BY observed_at DESC, event_id) = 1) SELECT * FROM newest ORDER BY observed_at DESC, event_id LIMIT 5000"""
ORACLES["streamed_bursts"] = f"""WITH {ACT}, o AS (SELECT location_id, kind, happened, lag(happened) OVER (PARTITION BY location_id ORDER BY happened) AS previous FROM act),
  g AS (SELECT *, sum(CASE WHEN previous IS NULL OR happened - previous >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY location_id ORDER BY happened) AS burst FROM o)
  SELECT location_id, strftime(min(happened), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS started_at, count(*) AS changes, bool_or(kind = 'removed') AS force FROM g
  GROUP BY location_id, burst"""
ORACLES["streamed_throttle"] = f"""WITH RECURSIVE {ACT}, req AS (SELECT DISTINCT location_id, epoch_us(happened) // 1000 AS at_ms FROM act),
  fired AS (SELECT location_id, min(at_ms) AS at_ms FROM req GROUP BY 1
    UNION ALL SELECT f.location_id, min(r.at_ms) FROM fired f JOIN req r ON r.location_id = f.location_id AND r.at_ms >= f.at_ms + 3600000 GROUP BY f.location_id)
  SELECT location_id, at_ms FROM fired"""
ORACLES["merged_findings"] = f"""WITH {FIN} SELECT location_id, code, message, CASE WHEN severity = 'info' THEN 'late' ELSE severity END AS severity FROM fin"""
ORACLES["dropped_generations"] = f"""WITH {SNAP} SELECT location_id, relative_path, size % 3 AS generation FROM aft WHERE size % 3 = substr(location_id, 2)::BIGINT"""
ORACLES["refreshed_links_delta"] = ORACLES["refreshed_links"]
ORACLES["reconciled_documents"] = ORACLES["inspected_documents"]
GENERATIONS = f"""WITH {SNAP}, g AS (SELECT location_id, ok, relative_path, size, modified_at_ms FROM snap),
  m AS (SELECT location_id, CASE ok % 10 WHEN 1 THEN 2 WHEN 3 THEN 2 WHEN 2 THEN 3 ELSE 1 END::BIGINT AS generation, relative_path,
    size + CASE ok % 10 WHEN 3 THEN 1 WHEN 2 THEN 5 ELSE 0 END AS size, modified_at_ms FROM g WHERE ok % 10 <> 4)"""
ORACLES["merged_generations"] = f"{GENERATIONS} SELECT * FROM m"
ORACLES["compacted_generations"] = f"{GENERATIONS} SELECT *, 1::BIGINT AS attempts FROM m"
ORACLES["wrapped_links"] = r"""WITH w AS (SELECT doc_id::VARCHAR AS doc, coalesce(lang, 'none') AS location_id, coalesce(source, 'none') AS folder,
    regexp_extract_all(text, '\p{L}+') AS words FROM documents),
  p AS (SELECT *, unnest(range((len(words) + 7) // 8)) AS k FROM w),
  t AS (SELECT *, k::VARCHAR || '-' || doc || '.md' AS target FROM p)
  SELECT location_id, folder || '/' || lpad(doc, 8, '0') || '.md' AS source_relative_path, k::INT AS position, target, folder || '/' || target AS target_relative_path,
    'candidate' AS status, (7 * k + 1)::INT AS start_line, (length(words[8 * k + 1]) + length(coalesce(words[8 * k + 2], 'x')) + 3)::INT AS start_column,
    (7 * k + 2)::INT AS end_line, (length(coalesce(words[8 * k + 5], 'x')) + length(target) + 4)::INT AS end_column FROM t"""
