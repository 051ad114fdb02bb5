"""DuckDB SQL for the queries of `documents`, from the same fixed values."""

from __future__ import annotations

from tessera.functions import lexicon as L
from tessera.functions import text as X
from tessera.operators.enrichment import ORGANISATION
from tessera.plans.search import _BM25, _DENSE


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


_MD = lambda x: _trim(f"regexp_replace(regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '[ \\t]+(\\n|$)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")
_CTX = lambda x: f"greatest(len({_words(_trim(x))}), strlen({_trim(x)}) // 4)"
_EST = lambda x: f"CASE WHEN {_trim(x)} = '' THEN 0 ELSE greatest(CAST(ceil(length({x}) / 4.0) AS BIGINT), CAST(trunc(len({_words(x)}) * 1.3) AS BIGINT)) END"
_STOP = _list([*L.ENGLISH_STOPWORDS, *L.TURKISH_STOPWORDS])
_KW = f"""kw AS (SELECT source, value FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS value FROM documents)
WHERE strlen(value) > 2 AND NOT regexp_matches(value, '^[0-9]+$') AND value NOT IN ({_STOP}))"""
_CATEGORY = """CASE WHEN starts_with(l, 'note:') OR starts_with(l, 'warning:') OR starts_with(l, 'caution:') OR starts_with(l, 'important:') THEN 'warning'
WHEN contains(l, 'is defined as') OR contains(l, 'refers to') OR starts_with(l, 'definition:') THEN 'definition'
WHEN starts_with(l, 'for example:') OR starts_with(l, 'e.g.,') OR starts_with(l, 'example:') THEN 'example'
WHEN starts_with(l, 'see ') OR starts_with(l, 'refer to ') THEN 'reference' ELSE 'narrative' END"""
_NAMED = """named AS (SELECT o_orderkey AS chunk_id, 'The firm Anton' || o_custkey || ' Holding' || CASE WHEN o_orderkey % 5 = 0 THEN ' was founded by ' ELSE ' was led by ' END
 || CASE WHEN o_orderkey % 3 = 0 THEN 'Rick Rubin' ELSE 'Atatürk' END || CASE WHEN o_orderkey % 2 = 0 THEN ' in New York.' ELSE ' at Ankara.' END AS text FROM orders)"""
_MENTIONS = _NAMED + f""",
m AS (SELECT DISTINCT chunk_id, {_trim('t')} AS text, 'organization' AS type, 0.85::DOUBLE AS confidence FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '{ORGANISATION}', 1)) AS t FROM named)
 {" ".join(f"UNION ALL SELECT chunk_id, '{n}', '{k}', {c}::DOUBLE FROM named WHERE contains(lower(text), '{t}')" for t, n, k, c in L.KNOWN_NAMES)})"""
_NODES = _MENTIONS + """,
nodes AS (SELECT lower(trim(text)) AS name, arg_min(text, (chunk_id, text, type)) AS canonical_name, arg_min(type, (chunk_id, text, type)) AS entity_type,
 round(least(1.0::DOUBLE, 0.8::DOUBLE + 0.1::DOUBLE * (count(*) - 1)), 6) AS score, list(DISTINCT chunk_id) AS chunks FROM m GROUP BY 1 HAVING score >= 0.9)"""
_GRAPH = _NODES + f""",
tk AS (SELECT DISTINCT query_id, token FROM (SELECT c_custkey AS query_id, unnest(['anton' || c_custkey, 'rubin']) AS token FROM customer WHERE c_custkey % 50 = 0)),
fd AS (SELECT query_id, name, count(*) AS matched FROM tk JOIN nodes ON contains(name, token) GROUP BY 1, 2),
gh AS (SELECT query_id, id, round(sum(p), 6) AS score FROM (SELECT query_id, unnest(chunks) AS id, score * least(matched, len({_words('name')})) / len({_words('name')})::DOUBLE AS p FROM fd JOIN nodes USING (name)) GROUP BY 1, 2),
gr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM gh QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10)"""
_Q = """q AS (SELECT conv_id, turn, list_extract(['Compare ' || a || ' with ' || b, a || ' vs. ' || b, 'What is the difference between ' || a || ' and ' || b, 'How do ' || a || ' and ' || b || ' differ?',
 'Who wrote ' || a || '?', 'What does the book say about ' || b || '?', 'how to ' || a, a], CAST((conv_id + turn) % 8 + 1 AS BIGINT)) AS query
 FROM (SELECT conv_id, turn, coalesce(t[1], 'x') AS a, coalesce(t[2], 'y') AS b FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM conversations)))"""
_SIDES = "coalesce(" + ", ".join(f"CASE WHEN regexp_extract(query, '{p}', 1) <> '' AND regexp_extract(query, '{p}', 2) <> '' AND lower({_trim(f'''regexp_extract(query, '{p}', 1)''')}) <> lower({_trim(f'''regexp_extract(query, '{p}', 2)''')}) THEN [{_trim(f'''regexp_extract(query, '{p}', 1)''')}, {_trim(f'''regexp_extract(query, '{p}', 2)''')}] END" for p in L.COMPARISONS) + ")"
_ROUTE = _Q + f""",
r AS (SELECT conv_id, turn, query, CASE WHEN starts_with(lower(query), 'who') OR contains(lower(query), 'author') OR regexp_matches(query, '{L.ENTITY_QUESTION}') THEN 'entity_lookup'
 WHEN starts_with(lower(query), 'how') THEN 'procedural_lookup' ELSE 'concept_lookup' END AS intent, {_SIDES} AS s FROM q)"""
_LINES = """sp AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
un AS (SELECT document_id, CAST(unnest(range(len(l))) AS INTEGER) AS ord, unnest(l) AS line FROM sp),
ln AS (SELECT *, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM un)"""
_MDL = _LINES + ", md AS (SELECT document_id, ord, start, CASE WHEN ord % 6 = 0 THEN repeat('#', CAST((ord // 6) % 3 + 1 AS BIGINT)) || ' ' || line ELSE line END AS line FROM ln)"
_HEAD = "regexp_matches(line, '^(#{1,6})(?:\\s+(.*))?$')"
_WINDOW = _BM25 + f""",
w0 AS (SELECT query_id, id, rank AS ref, '[Ref ' || rank || '] Source: ' || source || ' (Page [' || (doc_id % 7 + 1) || '], Section: ' || lang || ')' || chr(10) || CASE WHEN coalesce(text, '') = '' THEN 'Document ' || source || ', Section ' || lang ELSE text END || chr(10) || chr(10) AS block
 FROM bm JOIN documents ON doc_id = id),
w1 AS (SELECT *, CAST({_CTX('block')} AS BIGINT) AS block_tokens FROM w0),
w2 AS (SELECT *, CAST(sum(block_tokens) OVER (PARTITION BY query_id ORDER BY ref) AS BIGINT) AS total_tokens FROM w1),
w3 AS (SELECT * FROM w2 WHERE ref = 1 OR total_tokens <= 4000)"""
_SPAN = lambda size: f"(SELECT document_id, s AS r_start, least(s + {size} - 1, n - 1) AS r_end FROM (SELECT document_id, n, unnest(range(0, n, {size})) AS s FROM (SELECT doc_id AS document_id, strlen(text) AS n FROM documents WHERE strlen(text) > 0)))"
_LSPAN = "ls AS (SELECT document_id, ord, start AS l_start, start + strlen(line) - 1 AS l_end FROM ln WHERE line <> '')"
_ACC = f"regexp_replace(translate(lower(text), '{X.ACCENTED}', '{X.PLAIN}'), '\\p{{Mn}}', '', 'g')"
_FIRST = "list_filter(list_transform(string_split(replace(text, chr(10), ' '), '. '), lambda s: " + _trim("s") + "), lambda s: s <> '')[1]"
_FS = f"CASE WHEN ends_with({_FIRST}, '.') THEN {_FIRST} ELSE {_FIRST} || '.' END"
_RICH = """rich AS (SELECT doc_id AS document_id, coalesce(text, '') || chr(10) || '![figure ' || doc_id || '](img/' || doc_id || '.png)' || chr(10) || 'as in [' || doc_id || '] and [Smith et al., 2020] $$x = ' || doc_id || '$$' || chr(10)
 || '<img src="a.png">' || chr(10) || '<table><tr></tr></table> ISBN: 978-' || doc_id || ' [^n' || doc_id || ']' AS text FROM documents)"""


def _found(kind: str, sub: str, pattern: str, group: int = 0) -> str:
    return f"SELECT document_id, '{kind}' AS asset_type, '{sub}' AS subtype, unnest(regexp_extract_all(text, '{pattern}', {group})) AS raw FROM rich"


_ASSETS = " UNION ALL ".join(_found(*x) for x in (
    ("figure", "markdown", r"!\[[^\]]*\]\([^)\n]+\)"), ("figure", "html", r"(?i)<img\s[^>]*>"), ("table", "html", r"(?is)<table>.*?</table>"), ("equation", "display", r"(?s)\$\$.+?\$\$"),
    ("citation", "inline", L.INLINE_CITATION), ("citation", "catalog", L.CATALOG, 1), ("citation", "attribution", L.ATTRIBUTION, 1), ("citation", "footnote", r"\[\^[^\]]+\]"),
))
_QUOTE = "''" * 2  # an SQL string that holds one quote
_NORMAL = "regexp_replace(replace(regexp_replace(lower(regexp_replace(text, '[’`]', " + _QUOTE + ", 'g')), '[^\\p{L}\\p{N} '']', ' ', 'g'), " + _QUOTE + ", ''), '\\s+', ' ', 'g')"
_UUID = "(SELECT doc_id, sha256(source || ':' || lang || ':' || doc_id) AS h FROM documents)"

ORACLE = {
    "token_estimates": f"SELECT doc_id, {_EST('text')} AS tokens, CAST({_CTX('text')} AS BIGINT) AS context_tokens FROM documents",
    "content_hash_groups": f"SELECT sha256({_MD('text')}) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1",
    "index_signature": f"SELECT doc_id, sha256(sha256({_MD('text')}) || ':mock:mock-embed:1:1.0.0') AS signature FROM documents",
    "corpus_fingerprint": f"SELECT conv_id, sha256(string_agg(h, chr(10) ORDER BY h)) AS fingerprint FROM (SELECT conv_id, sha256({_MD('text')}) AS h FROM conversations) GROUP BY 1",
    "point_id": f"SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1))::BIGINT % 4 + 1 AS BIGINT), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM {_UUID}",
    "language_detect": f"SELECT doc_id, CASE WHEN {' + '.join(f'''CAST(contains(lower(text), '{m}') AS INTEGER)''' for m in L.TURKISH_MARKERS)} >= 2 THEN 'tr' ELSE 'en' END AS language FROM documents",
    "keyword_topk_global": f"WITH {_KW} SELECT value, frequency, CAST(row_number() OVER (ORDER BY frequency DESC, value) AS INTEGER) AS rank, round(frequency / max(frequency) OVER ()::DOUBLE, 6) AS score FROM (SELECT value, count(*) AS frequency FROM kw GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)",
    "keyword_by_source": f"WITH {_KW}, c AS (SELECT source, value, count(*) AS frequency FROM kw GROUP BY 1, 2) SELECT source, value, frequency, CAST(row_number() OVER w AS INTEGER) AS rank, round(frequency / max(frequency) OVER (PARTITION BY source)::DOUBLE, 6) AS score FROM c WINDOW w AS (PARTITION BY source ORDER BY frequency DESC, value) QUALIFY row_number() OVER w <= 15",
    "summary_first_sentence": f"SELECT doc_id, {_FS} AS summary FROM documents",
    "doc_summary": f"SELECT conv_id, string_agg(s, ' ' ORDER BY n) AS summary FROM (SELECT conv_id, s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT conv_id, turn, {_FS} AS s FROM conversations) WHERE s IS NOT NULL) WHERE n <= 3 GROUP BY 1",
    "heading_normalize": f"SELECT conv_id, turn, {_trim(_NORMAL)} AS heading FROM conversations",
    "slug_ascii": f"SELECT conv_id, turn, CASE WHEN s = '' THEN 'section' ELSE s END AS slug, regexp_replace(replace(lower({_trim('text')}), ' ', '-'), '[^a-z0-9-]', '', 'g') AS concept_slug FROM (SELECT *, regexp_replace(regexp_replace({_ACC}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM conversations)",
    "paragraph_categories": f"SELECT {_CATEGORY} AS category, count(*) AS n FROM (SELECT lower(list_extract(['Note: ', 'Example: ', 'See ', 'Definition: ', ''], CAST(conv_id % 5 + 1 AS BIGINT)) || text) AS l FROM conversations) GROUP BY 1",
    "entity_mentions": f"WITH {_MENTIONS} SELECT chunk_id, text, type, confidence FROM m",
    "mention_merge": f"WITH {_MENTIONS}, o AS (SELECT *, 0 AS p FROM m UNION ALL SELECT chunk_id, upper(text), type, CASE WHEN chunk_id % 3 = 0 THEN 0.99::DOUBLE ELSE 0.5::DOUBLE END, 1 FROM m WHERE chunk_id % 4 <> 0) SELECT chunk_id, type, text, confidence FROM o QUALIFY row_number() OVER (PARTITION BY chunk_id, type, lower(text) ORDER BY confidence DESC, p, text) = 1",
    "entity_groups": f"WITH {_MENTIONS} SELECT type || ':' || lower(text) AS entity_id, type, arg_min(text, (chunk_id, text)) AS name, count(*) AS mentions, round(least(1.0::DOUBLE, 0.8::DOUBLE + 0.1::DOUBLE * (count(*) - 1)), 6) AS score FROM m GROUP BY 1, 2",
    "relation_pairs": f"""WITH {_MENTIONS}, e AS (SELECT DISTINCT m.chunk_id, type, type || ':' || lower(m.text) AS entity, lower(named.text) AS t FROM m JOIN named USING (chunk_id)),
p AS (SELECT o.entity AS subject, 'founded_by' AS predicate, x.entity AS object, 0.9::DOUBLE AS confidence, o.chunk_id FROM e o JOIN e x USING (chunk_id) WHERE o.type = 'organization' AND x.type = 'person' AND regexp_matches(o.t, 'founded|created|started')
 UNION ALL SELECT o.entity, 'located_in', x.entity, 0.85::DOUBLE, o.chunk_id FROM e o JOIN e x USING (chunk_id) WHERE o.type = 'organization' AND x.type = 'location' AND regexp_matches(o.t, 'in |at '))
SELECT subject, predicate, object, max(confidence) AS confidence, min(chunk_id) AS chunk_id FROM p GROUP BY 1, 2, 3""",
    "concept_rank": f"""WITH a AS (SELECT {_trim('h')} AS name, 0.98::DOUBLE AS score, 0 AS p FROM (SELECT unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) AS h FROM pages) WHERE {_trim('h')} <> ''
 UNION ALL SELECT DISTINCT role || ' ' || turn, 0.8::DOUBLE, 1 FROM conversations WHERE length(role || ' ' || turn) > 3),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY p, score DESC, name) = 1)
SELECT 'concept:' || regexp_replace(replace(lower({_trim('name')}), ' ', '-'), '[^a-z0-9-]', '', 'g') AS concept_id, name, score FROM b""",
    "graph_nodes": f"WITH {_NODES} SELECT name, canonical_name, entity_type, score, len(chunks) AS evidence FROM nodes",
    "graph_retrieve": f"WITH {_GRAPH} SELECT query_id, id, score, rank FROM gr",
    "graph_fusion": f"""WITH {_GRAPH}, {_DENSE}, f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM dn UNION ALL SELECT query_id, id, rank FROM gr) GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""",
    "graph_bfs": """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
b(node, depth) AS (SELECT 'r' || r_regionkey, 0 FROM region WHERE r_regionkey % 2 = 0 UNION SELECT dst, depth + 1 FROM b JOIN e ON node = src WHERE depth < 2)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY 1""",
    "diff_plan": """WITH o AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE sha256(coalesce(text, '')) END AS s FROM documents WHERE doc_id % 7 <> 0), n AS (SELECT doc_id, sha256(coalesce(text, '')) AS s FROM documents WHERE doc_id % 11 <> 0)
SELECT coalesce(o.doc_id, n.doc_id) AS point_id, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.s IS NOT DISTINCT FROM n.s THEN 'unchanged' ELSE 'modified' END AS action FROM o FULL JOIN n ON o.doc_id = n.doc_id""",
    "upsert_latest": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "entity_evidence": "SELECT l_partkey AS node_id, max(l_discount) AS score, count(DISTINCT l_linenumber) AS chunks FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 3) GROUP BY 1",
    "state_transitions": f"""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'click' THEN 'retrying' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' END AS state FROM events),
t AS (SELECT lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state, state FROM s)
SELECT from_state, state, count(*) AS n FROM t WHERE from_state IS NOT NULL AND from_state <> state AND (from_state, state) NOT IN (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in L.JOB_MOVES)})) GROUP BY 1, 2""",
    "intent_route": f"WITH {_ROUTE} SELECT conv_id, turn, intent, CASE WHEN s IS NOT NULL THEN 'comparison' WHEN intent = 'entity_lookup' THEN 'entity' ELSE 'other' END AS hint, s IS NOT NULL AS decompose, CASE WHEN s IS NOT NULL THEN 8 END AS top_k, s IS NULL AND intent = 'entity_lookup' AS use_graph FROM r",
    "comparison_split": f"WITH {_ROUTE} SELECT conv_id, turn, s[1] AS left_side, s[2] AS right_side FROM r WHERE s IS NOT NULL",
    "context_window_budget": f"WITH {_WINDOW} SELECT query_id, ref, id, block_tokens, total_tokens FROM w3",
    "rag_prompts": f"""WITH {_WINDOW}, c AS (SELECT query_id, string_agg(block, '' ORDER BY ref) AS context FROM w3 GROUP BY 1),
u AS (SELECT doc_id AS query_id, 'CONTEXT:' || chr(10) || coalesce(context, 'No source context available.' || chr(10)) || chr(10) || 'USER QUESTION:' || chr(10) || 'Summarise ' || source AS u FROM documents LEFT JOIN c ON c.query_id = doc_id WHERE doc_id % 50 = 0)
SELECT query_id, sha256(u) AS prompt_sha256, strlen(u) AS bytes FROM u""",
    "citation_verify": """WITH t AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY 1), c AS (SELECT conv_id AS answer_id, unnest([turn % 5 + 1, 1, conv_id % 7 + 1, 2]) AS ref FROM t)
SELECT answer_id, count(ref) AS total, count(DISTINCT CASE WHEN ref <= 4 THEN ref END) AS verified, CAST(sum(CASE WHEN ref > 4 THEN 1 ELSE 0 END) AS BIGINT) AS invalid, CASE WHEN sum(CASE WHEN ref > 4 THEN 1 ELSE 0 END) = 0 THEN 'verified' ELSE 'unverified' END AS status FROM c GROUP BY 1""",
    "line_offsets": f"WITH {_LINES} SELECT document_id, count(*) AS lines, max(start) AS last_start, CAST(sum(start) AS BIGINT) AS sum_start FROM ln GROUP BY 1",
    "section_asof": f"""WITH {_MDL}, h AS (SELECT *, CASE WHEN {_HEAD} THEN {_trim("regexp_extract(line, '^(#{1,6})(?:\\s+(.*))?$', 2)")} END AS h FROM md)
SELECT document_id, section, count(*) AS n FROM (SELECT document_id, coalesce(last_value(h IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Document Overview') AS section FROM h) GROUP BY 1, 2""",
    "section_tree": f"""WITH {_MDL}, h AS (SELECT document_id, ord, CAST((ord // 6) % 3 + 1 AS INTEGER) AS level, CASE WHEN {_trim("substr(line, CAST((ord // 6) % 3 + 2 AS BIGINT))")} = '' THEN 'Untitled Section' ELSE {_trim("substr(line, CAST((ord // 6) % 3 + 2 AS BIGINT))")} END AS heading FROM md WHERE ord % 6 = 0)
SELECT a.document_id, a.ord, a.level, a.heading, CASE WHEN a.level > 1 THEN CAST(a.ord - 6 AS INTEGER) END AS parent_ord, concat_ws(' > ', c.heading, b.heading, a.heading) AS section_path
FROM h a LEFT JOIN h b ON a.level > 1 AND b.document_id = a.document_id AND b.ord = a.ord - 6 LEFT JOIN h c ON a.level > 2 AND c.document_id = a.document_id AND c.ord = a.ord - 12""",
    "page_marks": f"""WITH {_MDL}, p AS (SELECT document_id, ord, CASE WHEN ord % 10 = 9 THEN ord END AS mark, sum(CASE WHEN ord % 10 <> 9 AND ord % 4 = 3 THEN 1 ELSE 0 END) OVER o AS brk FROM md WINDOW o AS (PARTITION BY document_id ORDER BY ord)),
b AS (SELECT *, last_value(mark IGNORE NULLS) OVER o AS m, last_value(CASE WHEN mark IS NOT NULL THEN brk END IGNORE NULLS) OVER o AS k FROM p WINDOW o AS (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT document_id, CAST(coalesce(m + brk - k, brk + 1) AS INTEGER) AS page, count(*) AS n FROM b GROUP BY 1, 2""",
    "page_overlap": f"WITH {_LINES}, {_LSPAN} SELECT document_id, ord, count(*) AS pages, CAST(min(r_start) // 1000 AS BIGINT) AS first_page FROM ls JOIN {_SPAN(1000)} USING (document_id) WHERE l_start <= r_end AND l_end >= r_start GROUP BY 1, 2",
    "chunk_overlap": f"WITH {_LINES}, {_LSPAN} SELECT document_id, r_start, count(*) AS lines FROM ls JOIN {_SPAN(3000)} USING (document_id) WHERE l_start <= r_end AND l_end >= r_start GROUP BY 1, 2",
    "html_headings": "SELECT page_id, CAST(unnest(range(len(h))) AS INTEGER) AS n, unnest(h) AS heading FROM (SELECT page_id, regexp_extract_all(html, '(?i)<h[1-6]>([^<]*)</h[1-6]>', 1) AS h FROM pages)",
    "html_links": "SELECT href, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY 1",
    "assets_extract": f"WITH {_RICH} SELECT document_id, asset_type, subtype, count(*) AS n, max(raw) AS raw FROM ({_ASSETS}) GROUP BY 1, 2, 3",
    "table_islands": f"""WITH {_LINES}, t AS (SELECT document_id, ord, CASE WHEN ord % 5 < 2 THEN '| ' || line || ' |' ELSE line END AS line FROM ln),
k AS (SELECT *, ord - row_number() OVER (PARTITION BY document_id ORDER BY ord) AS run FROM t WHERE contains({_trim('line')}, '|') AND (starts_with({_trim('line')}, '|') OR ends_with({_trim('line')}, '|')))
SELECT document_id, min(ord) AS first_ord, max(ord) AS last_ord, sha256(string_agg(line, chr(10) ORDER BY ord)) AS body_sha256 FROM k GROUP BY document_id, run""",
    "code_blocks": f"""WITH {_LINES}, f AS (SELECT document_id, ord, ord % 4 = 1 OR regexp_matches({_trim('line')}, '^(```|~~~)') AS fence FROM ln), n AS (SELECT *, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY document_id ORDER BY ord) AS n FROM f)
SELECT document_id, CAST((n + 1) // 2 AS INTEGER) AS code_no, count(*) AS lines FROM n WHERE n % 2 = 1 OR fence GROUP BY 1, 2""",
    "chunk_neighbors": "SELECT conv_id, turn, lag(turn) OVER w AS previous_turn, lead(turn) OVER w AS next_turn, CAST(row_number() OVER w AS INTEGER) AS chunk_order FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "greedy_chunks": f"""WITH RECURSIVE {_LINES}, z AS (SELECT document_id, ord, {_EST('line')} AS n FROM ln),
g(document_id, ord, total, grp) AS (SELECT document_id, ord, n, 1 FROM z WHERE ord = 0 UNION ALL SELECT z.document_id, z.ord, CASE WHEN g.total + z.n <= 200 THEN g.total + z.n ELSE z.n END, CASE WHEN g.total + z.n <= 200 THEN g.grp ELSE g.grp + 1 END FROM g JOIN z ON z.document_id = g.document_id AND z.ord = g.ord + 1)
SELECT document_id AS doc_id, CAST(max(grp) AS BIGINT) AS groups FROM g GROUP BY 1""",
}
