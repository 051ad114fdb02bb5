"""Registered queries of records: assets, blocks, chunks, sections, metadata, indexing and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as X
from tessera.operators import assets as T
from tessera.operators import structure as S
from tessera.plans import documents as D
from tessera.plans.documents_sql import _CATEGORY, _EST, _trim
from tessera.sources.tables import table


def _marked(spark, sf_dir) -> DataFrame:
    """Documents with a page mark, tables, figures, code, equations and citations of all kinds behind their texts."""
    i = F.col("doc_id").cast("string")
    lit = F.lit
    tail = F.concat(
        lit("\n--- page 2 ---\n## Part "), i, lit("\nTable 1: sizes\n| a | b"), i, lit(" |\n|---|---|\n| 1 | 2 |\n\n<table><tr>"), i, lit("</tr></table>\n![figure "), i, lit("](img/"), i,
        lit('.png "t")\n<img class="x" src=\'b.png\' alt=\'alt '), i, lit("'>\n<img src=broken\n```sql\nselect "), i, lit("\n\n```\n$$\nx = "), i, lit("\n$$\n\\[ y \\]\nas in ["), i,
        lit("] and [Smith et al., 2020], [^n"), i, lit("] ISBN: 978-"), i, lit("\n[^n"), i, lit("]: Excerpt from Book "), i, lit("\n### References\n[1] First "), i, lit("\n* Second\nnone\n# End\nExcerpt from Chapter "), i, lit("\n~~~\nopen"),
    )
    return D._docs(spark, sf_dir).select("doc_id", F.concat(F.coalesce("text", F.lit("")), tail).alias("text"))


def asset_records(spark, sf_dir):
    found = T.assets(_marked(spark, sf_dir), "doc_id", "text")
    return found.select(
        "document_id", "asset_id", "asset_type", "subtype", "asset_order", "start_offset", "end_offset", "line_no", "caption", "uri", "language",
        F.array_join("headers", ",").alias("headers"), F.sha2("content", 256).alias("content_sha256"),
    )


def asset_stats(spark, sf_dir):
    return T.statistics(T.assets(_marked(spark, sf_dir), "doc_id", "text"))


def asset_places(spark, sf_dir):
    """Assets with section, pages of 1,500 bytes and related chunks of 1,000 bytes."""
    docs = _marked(spark, sf_dir)
    lines = S.section_of_lines(S.lines(docs, "doc_id", F.col("text")))
    pages = D._spans(docs, 1500, "r").withColumn("page_number", (F.col("r_start") / 1500 + 1).cast("int"))
    chunks = D._spans(docs, 1000, "r").withColumn("chunk_id", F.concat(F.lit("c"), (F.col("r_start") / 1000).cast("bigint").cast("string")))
    p = T.placed(T.assets(docs, "doc_id", "text"), lines, pages, chunks)
    return p.select("document_id", "asset_id", "section_path", "page_number", F.array_join(F.transform("page_numbers", lambda n: n.cast("string")), ",").alias("page_numbers"), F.array_join("related_chunk_ids", ",").alias("related_chunk_ids"))


def asset_numbers(spark, sf_dir):
    """Ids of the assets of pages: their tables, images and code by place."""
    html = table(spark, sf_dir, "pages")
    kinds = (("table", "(?i)<table"), ("figure", "(?i)<img"), ("code", "(?i)<(?:pre|code)"), ("citation", "(?i)<a "))
    found = lambda kind, p: F.transform(F.regexp_extract_all("html", F.lit(p), F.lit(0)), lambda x, k: F.struct(F.lit(kind).alias("asset_type"), k.alias("place")))
    every = F.concat(*[found(*k) for k in kinds])
    return T.numbered(html.select(F.col("page_id").alias("document_id"), F.inline(every)), "place").select("document_id", "asset_type", "place", "asset_id")


def paragraph_blocks(spark, sf_dir):
    """Paragraphs of texts (runs of lines between blank lines) with category, distinct citations and tokens."""
    lead = F.element_at(F.array(*map(F.lit, ("Note: ", "Example: ", "See ", "Definition: ", "It refers to [3] and [3], [Lee et al. 2001]. "))), (F.col("doc_id") % 5 + 1).cast("int"))
    parts = F.filter(F.split(F.concat(lead, F.coalesce("text", F.lit(""))), r"\n(?:[ \t]*\n)+"), lambda p: X.bare(p) != "")
    p = D._docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.posexplode(parts).alias("block_ord", "content"))
    cited = F.array_distinct(F.regexp_extract_all("content", F.lit(L.INLINE_CITATION), F.lit(0)))
    return p.select("document_id", "block_ord", X.paragraph_category(F.col("content")).alias("category"), F.array_join(cited, ";").alias("citations"), X.token_estimate(F.col("content")).alias("tokens"))


def list_items(spark, sf_dir):
    rows = S.lines(D._docs(spark, sf_dir), "doc_id", F.col("text"))
    lead = F.element_at(F.array(*map(F.lit, ("- ", "12. ", "* ", "1.x ", "+ ", "123456. ", ""))), (F.col("ord") % 7 + 1).cast("int"))
    line = F.concat(lead, "line")
    return rows.withColumn("item", X.is_list_item(line)).groupBy("document_id").agg(F.sum(F.col("item").cast("int")).alias("items"), F.count("*").alias("lines"))


def chunk_records(spark, sf_dir):
    chunks, _ = S.chunk_documents(_marked(spark, sf_dir), "doc_id", "text")
    return chunks.select(
        "document_id", "chunk_id", "chunk_order", "heading_level", "parent_id", F.size("child_ids").alias("children"), "content_type", "category", "tokens", "character_count",
        "is_oversized", F.array_join("citations", ";").alias("citations"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "fingerprint",
    )


def chunk_oversize(spark, sf_dir):
    _, warnings = S.chunk_documents(_marked(spark, sf_dir), "doc_id", "text")
    return warnings


def _lettered(spark, sf_dir) -> DataFrame:
    """The lines of documents with letters and digits only, so that what is put before and behind them alone makes blocks."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9\\n]+", " ")
    return D._docs(spark, sf_dir).select("doc_id", F.transform(F.split(plain, "\n"), lambda x: F.concat(F.lit("x"), x)).alias("l"))


def block_kinds(spark, sf_dir):
    """Blocks of texts whose lines are headings, paragraphs, lists, tables, equations, figures and code in turn."""
    docs = _lettered(spark, sf_dir)
    lit = F.lit
    mark = lambda x, k: (
        F.when(k % 7 == 0, F.concat(lit("## "), x)).when(k % 7 == 2, F.concat(lit("- "), x)).when(k % 7 == 3, F.concat(lit("| "), x, lit(" |"))).when(k % 7 == 4, F.concat(lit("$$"), x, lit("$$")))
        .when(k % 7 == 5, F.concat(lit("!["), x, lit("](u)"))).when(k % 7 == 6, F.concat(lit("```\n"), x, lit("\n```"))).otherwise(x)
    )
    b = S.blocks(docs.select("doc_id", F.array_join(F.transform("l", mark), "\n\n").alias("text")), "doc_id", "text")
    return b.select("document_id", "block_ord", "kind", "category", "heading_level", "section_path", "start_offset", "end_offset", "tokens", F.sha2("content", 256).alias("content_sha256"))


def chunk_sections(spark, sf_dir):
    """Chunks of texts whose lines are paragraphs, each fifth a heading: packed, with parents, ids, links and flags."""
    docs = _lettered(spark, sf_dir)
    text = F.array_join(F.transform("l", lambda x, k: F.when(k % 5 == 0, F.concat(F.lit("# "), F.substring(x, 1, 3))).otherwise(F.repeat(F.concat(x, F.lit(" ")), 4))), "\n\n")
    chunks, _ = S.chunk_documents(docs.select("doc_id", text.alias("text")), "doc_id", "text")
    return chunks.select("document_id", "chunk_id", "chunk_order", "section_path", "is_parent", "parent_id", F.size("child_ids").alias("children"), "tokens", "is_oversized", "start_offset", "end_offset", F.sha2("content", 256).alias("content_sha256"), "previous_id", "next_id")


_R = """rich AS (SELECT doc_id AS document_id, coalesce(text, '') || chr(10) || '--- page 2 ---' || chr(10) || '## Part ' || doc_id || chr(10) || 'Table 1: sizes' || chr(10) || '| a | b' || doc_id || ' |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |' || chr(10) || chr(10)
 || '<table><tr>' || doc_id || '</tr></table>' || chr(10) || '![figure ' || doc_id || '](img/' || doc_id || '.png "t")' || chr(10) || '<img class="x" src=''b.png'' alt=''alt ' || doc_id || '''>' || chr(10) || '<img src=broken' || chr(10)
 || '```sql' || chr(10) || 'select ' || doc_id || chr(10) || chr(10) || '```' || chr(10) || '$$' || chr(10) || 'x = ' || doc_id || chr(10) || '$$' || chr(10) || '\\[ y \\]' || chr(10) || 'as in [' || doc_id || '] and [Smith et al., 2020], [^n' || doc_id || '] ISBN: 978-' || doc_id || chr(10)
 || '[^n' || doc_id || ']: Excerpt from Book ' || doc_id || chr(10) || '### References' || chr(10) || '[1] First ' || doc_id || chr(10) || '* Second' || chr(10) || 'none' || chr(10) || '# End' || chr(10) || 'Excerpt from Chapter ' || doc_id || chr(10) || '~~~' || chr(10) || 'open' AS text FROM documents),
sp AS (SELECT document_id, text, string_split(text, chr(10)) AS l FROM rich),
un AS (SELECT document_id, strlen(text) AS n_bytes, CAST(unnest(range(len(l))) AS INTEGER) AS ord, unnest(l) AS line FROM sp),
ln AS (SELECT *, CAST(coalesce(sum(strlen(line) + 1) OVER w, 0) AS BIGINT) AS start, lag(line) OVER (PARTITION BY document_id ORDER BY ord) AS above FROM un WINDOW w AS (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""".replace("\\\\", "\\")
_LN_TRIM = _trim("line")


def _places(pattern: str) -> str:
    """Rows of a pattern's matches with their first byte, by what the pattern leaves between them."""
    p = pattern.replace("'", "''")
    return f"""(SELECT document_id, m[k] AS raw, CAST(list_sum(list_transform(s[1:k], lambda v: strlen(v))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda v: strlen(v))), 0) AS BIGINT) AS start FROM
 (SELECT document_id, s, m, unnest(range(1, len(m) + 1)) AS k FROM (SELECT document_id, regexp_split_to_array(text, '{p}') AS s, regexp_extract_all(text, '{p}') AS m FROM rich)))"""


_CAPTION = "CASE WHEN starts_with(lower({x}), 'table') OR starts_with(lower({x}), 'caption:') OR starts_with(lower({x}), '**table') THEN {x} ELSE '' END"
_ABOVE = _CAPTION.format(x=_trim("coalesce(above, '')"))
_Q = lambda p: p.replace("'", "''")
_ASSETS = _R + f""",
tr AS (SELECT *, ord - row_number() OVER (PARTITION BY document_id ORDER BY ord) AS run FROM ln WHERE contains(line, '|') AND (starts_with({_LN_TRIM}, '|') OR ends_with({_LN_TRIM}, '|'))),
t1 AS (SELECT document_id, 1 AS scan, 'table' AS asset_type, 'markdown' AS subtype, min(start) AS start_offset, least(arg_max(start + strlen(line) + 1, ord), min(n_bytes)) AS end_offset, arg_min({_ABOVE}, ord) AS caption, NULL AS uri, NULL AS language,
 array_to_string(list_filter(list_transform(string_split(arg_min(line, ord), '|'), lambda v: {_trim('v')}), lambda v: v <> ''), ',') AS headers, string_agg(line, chr(10) ORDER BY ord) AS content FROM tr GROUP BY document_id, run),
t2 AS (SELECT p.document_id, 2 AS scan, CASE WHEN contains(raw, '</table>') THEN 'table' ELSE 'warning' END AS asset_type, CASE WHEN contains(raw, '</table>') THEN 'html' ELSE 'table' END AS subtype, p.start AS start_offset, p.start + strlen(raw) AS end_offset,
 CASE WHEN contains(raw, '</table>') THEN {_ABOVE} END AS caption, NULL AS uri, NULL AS language, CASE WHEN contains(raw, '</table>') THEN '' END AS headers, CASE WHEN contains(raw, '</table>') THEN raw ELSE 'malformed HTML table block encountered' END AS content
 FROM {_places(L.HTML_TABLE)} p JOIN ln ON ln.document_id = p.document_id AND p.start >= ln.start AND p.start <= ln.start + strlen(line)),
f1 AS (SELECT document_id, 3 AS scan, 'figure' AS asset_type, 'markdown' AS subtype, start AS start_offset, start + strlen(raw) AS end_offset, regexp_extract(raw, '{_Q(L.MARKDOWN_IMAGE)}', 1) AS caption,
 {_trim("regexp_extract(regexp_extract(raw, '" + _Q(L.MARKDOWN_IMAGE) + "', 2), '^(.[^ ]*)', 1)")} AS uri, NULL AS language, NULL AS headers, NULL AS content FROM {_places(L.MARKDOWN_IMAGE)}),
f2 AS (SELECT document_id, 4 AS scan, 'figure' AS asset_type, 'html' AS subtype, start AS start_offset, start + strlen(raw) AS end_offset, coalesce(regexp_extract(raw, '{_Q(L.ALT_TEXT)}', 1), '') AS caption, regexp_extract(raw, '{_Q(L.HTML_IMAGE)}', 1) AS uri, NULL AS language, NULL AS headers, NULL AS content FROM {_places(L.HTML_IMAGE)}),
f3 AS (SELECT document_id, 5 AS scan, 'warning' AS asset_type, 'figure' AS subtype, start AS start_offset, start + strlen(line) AS end_offset, NULL AS caption, NULL AS uri, NULL AS language, NULL AS headers, 'malformed HTML image tag encountered: ' || {_LN_TRIM} AS content FROM ln WHERE contains(lower(line), '<img') AND NOT contains(line, '>')),
fl AS (SELECT *, sum(CASE WHEN regexp_matches({_LN_TRIM}, '^(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ord) AS fences, regexp_matches({_LN_TRIM}, '^(```|~~~)') AS fence FROM ln),
c1 AS (SELECT document_id, 6 AS scan, 'code' AS asset_type, 'fenced' AS subtype, min(start) AS start_offset, CASE WHEN count(CASE WHEN fence THEN 1 END) = 2 THEN max(start + strlen(line)) ELSE max(n_bytes) END AS end_offset, NULL AS caption, NULL AS uri,
 {_trim("substr(" + _trim("arg_min(line, ord)") + ", 4)")} AS language, NULL AS headers, coalesce(string_agg(CASE WHEN NOT fence THEN line END, chr(10) ORDER BY ord), '') AS content FROM (SELECT *, CASE WHEN fences % 2 = 1 OR fence THEN (fences + 1) // 2 END AS block FROM fl) WHERE block IS NOT NULL GROUP BY document_id, block),
e1 AS (SELECT document_id, 7 AS scan, 'equation' AS asset_type, 'display' AS subtype, start AS start_offset, start + strlen(raw) AS end_offset, NULL AS caption, NULL AS uri, NULL AS language, NULL AS headers, {_trim("substr(raw, 3, length(raw) - 4)")} AS content FROM {_places(L.DISPLAY_MATH)}),
bl AS (SELECT *, last_value(CASE WHEN regexp_matches({_LN_TRIM}, '{L.BIBLIOGRAPHY_HEADING}') THEN 1 WHEN starts_with({_LN_TRIM}, '#') THEN 0 END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inside FROM ln),
ci AS (SELECT document_id, 8 AS scan, 'bibliography' AS subtype, start, start + strlen(line) AS fin, {_LN_TRIM} AS raw FROM bl WHERE inside = 1 AND regexp_matches({_LN_TRIM}, '{L.BIBLIOGRAPHY_ITEM}')
 UNION ALL SELECT document_id, 9, 'footnote', start, start + strlen(line), {_LN_TRIM} FROM ln WHERE regexp_matches({_LN_TRIM}, '{L.FOOTNOTE_TEXT}')
 UNION ALL SELECT p.document_id, 9, 'footnote', p.start, p.start + strlen(raw), raw FROM {_places(L.FOOTNOTE_MARK)} p JOIN ln ON ln.document_id = p.document_id AND p.start >= ln.start AND p.start <= ln.start + strlen(line) WHERE NOT regexp_matches({_LN_TRIM}, '{L.FOOTNOTE_TEXT}')
 UNION ALL SELECT document_id, 10, 'attribution', start, start + strlen(raw), {_trim('raw')} FROM {_places(L.CATALOG)}
 UNION ALL SELECT document_id, 11, 'inline', start, start + strlen(raw), raw FROM {_places(L.INLINE_CITATION)}
 UNION ALL SELECT document_id, 12, 'attribution', start, start + strlen(raw), {_trim('raw')} FROM {_places(L.ATTRIBUTION)}),
c2 AS (SELECT document_id, scan, 'citation' AS asset_type, subtype, start AS start_offset, fin AS end_offset, NULL AS caption, NULL AS uri, NULL AS language, NULL AS headers, raw AS content FROM ci QUALIFY row_number() OVER (PARTITION BY document_id, start ORDER BY scan) = 1),
al AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM c2),
an AS (SELECT *, CASE asset_type WHEN 'table' THEN 'tbl' WHEN 'figure' THEN 'fig' WHEN 'code' THEN 'code' WHEN 'equation' THEN 'eq' WHEN 'citation' THEN 'cit' END || '-' || row_number() OVER (PARTITION BY document_id, asset_type ORDER BY scan, start_offset) AS asset_id,
 CASE WHEN asset_type <> 'warning' THEN CAST(row_number() OVER (PARTITION BY document_id, asset_type = 'warning' ORDER BY start_offset, CASE asset_type WHEN 'table' THEN 0 WHEN 'figure' THEN 1 WHEN 'code' THEN 2 WHEN 'equation' THEN 3 ELSE 4 END, scan) AS INTEGER) END AS asset_order FROM al),
av AS (SELECT an.*, ln.ord + 1 AS line_no FROM an JOIN ln ON ln.document_id = an.document_id AND start_offset >= ln.start AND start_offset <= ln.start + strlen(line))"""
_PART = "regexp_split_to_array(list_extract(['Note: ', 'Example: ', 'See ', 'Definition: ', 'It refers to [3] and [3], [Lee et al. 2001]. '], CAST(doc_id % 5 + 1 AS BIGINT)) || coalesce(text, ''), '\\n(?:[ \\t]*\\n)+')"
_SPANS = lambda size: f"(SELECT document_id, s AS r_start, least(s + {size} - 1, n - 1) AS r_end FROM (SELECT document_id, strlen(text) AS n, unnest(range(0, strlen(text), {size})) AS s FROM rich))"
ORACLE = {
    "asset_records": f"WITH {_ASSETS} SELECT document_id, asset_id, asset_type, subtype, asset_order, start_offset, end_offset, CAST(line_no AS INTEGER) AS line_no, caption, uri, language, headers, sha256(content) AS content_sha256 FROM av",
    "asset_stats": f"""WITH {_ASSETS} SELECT document_id, {', '.join(f"CAST(sum(CAST(asset_type = '{k}' AS INTEGER)) AS BIGINT) AS {k}s" for k in ('table', 'figure', 'code', 'equation', 'citation', 'warning'))} FROM al GROUP BY 1""",
    "asset_places": f"""WITH {_ASSETS}, hd AS (SELECT document_id, ord, last_value(CASE WHEN regexp_matches(line, '^(#{{1,6}})(?:\\s+(.*))?$') THEN {_trim("regexp_extract(line, '^(#{1,6})(?:\\s+(.*))?$', 2)")} END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM ln),
pg AS (SELECT document_id, asset_id, min(r_start // 1500 + 1) AS p, string_agg(DISTINCT CAST(r_start // 1500 + 1 AS VARCHAR), ',' ORDER BY CAST(r_start // 1500 + 1 AS VARCHAR)) AS ps, list_sort(list(DISTINCT r_start // 1500 + 1)) AS pl FROM av JOIN {_SPANS(1500)} USING (document_id) WHERE start_offset <= r_end AND end_offset >= r_start AND asset_type <> 'warning' GROUP BY 1, 2),
ck AS (SELECT document_id, asset_id, array_to_string(list_sort(list(DISTINCT 'c' || (r_start // 1000))), ',') AS cs FROM av JOIN {_SPANS(1000)} USING (document_id) WHERE start_offset <= r_end AND end_offset >= r_start AND asset_type <> 'warning' GROUP BY 1, 2)
SELECT av.document_id, av.asset_id, coalesce(h, 'Document Overview') AS section_path, CAST(p AS INTEGER) AS page_number, array_to_string(list_transform(pl, lambda v: CAST(v AS VARCHAR)), ',') AS page_numbers, cs AS related_chunk_ids
FROM av JOIN hd ON hd.document_id = av.document_id AND hd.ord = line_no - 1 JOIN pg ON pg.document_id = av.document_id AND pg.asset_id = av.asset_id JOIN ck ON ck.document_id = av.document_id AND ck.asset_id = av.asset_id""",
    "asset_numbers": """WITH h AS (SELECT page_id, 'table' AS t, 'tbl' AS p, regexp_extract_all(html, '(?i)<table') AS m FROM pages UNION ALL SELECT page_id, 'figure', 'fig', regexp_extract_all(html, '(?i)<img') FROM pages
 UNION ALL SELECT page_id, 'code', 'code', regexp_extract_all(html, '(?i)<(?:pre|code)') FROM pages UNION ALL SELECT page_id, 'citation', 'cit', regexp_extract_all(html, '(?i)<a ') FROM pages)
SELECT page_id AS document_id, t AS asset_type, CAST(place AS INTEGER) AS place, p || '-' || (place + 1) AS asset_id FROM (SELECT page_id, t, p, unnest(range(len(m))) AS place FROM h)""",
    "paragraph_blocks": f"""WITH p AS (SELECT doc_id, list_filter({_PART}, lambda v: {_trim('v')} <> '') AS parts FROM documents), q AS (SELECT doc_id AS document_id, CAST(unnest(range(len(parts))) AS INTEGER) AS block_ord, unnest(parts) AS content FROM p),
c AS (SELECT *, lower(content) AS l, regexp_extract_all(content, '{L.INLINE_CITATION}') AS m FROM q)
SELECT document_id, block_ord, {_CATEGORY} AS category, array_to_string(list_filter(list_transform(range(1, len(m) + 1), lambda k: CASE WHEN list_position(m, m[k]) = k THEN m[k] END), lambda v: v IS NOT NULL), ';') AS citations, {_EST('content')} AS tokens FROM c""",
    "list_items": """WITH sp AS (SELECT doc_id AS document_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), un AS (SELECT document_id, unnest(range(len(l))) AS ord, unnest(l) AS line FROM sp),
x AS (SELECT document_id, list_extract(['- ', '12. ', '* ', '1.x ', '+ ', '123456. ', ''], CAST(ord % 7 + 1 AS BIGINT)) || line AS line FROM un)
SELECT document_id, CAST(sum(CAST(starts_with(line, '- ') OR starts_with(line, '* ') OR starts_with(line, '+ ') OR (regexp_matches(line, '^[0-9]') AND length(line) > 2 AND strpos(line, '. ') BETWEEN 2 AND 5) AS INTEGER)) AS BIGINT) AS items, count(*) AS lines FROM x GROUP BY 1""",
}
_LETTERED = """lt AS (SELECT doc_id AS document_id, list_transform(string_split(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9\\n]+', ' ', 'g'), chr(10)), lambda x: 'x' || x) AS l FROM documents),
lx AS (SELECT document_id, CAST(unnest(range(len(l))) AS INTEGER) AS k, unnest(l) AS x FROM lt)"""
_SEC = "last_value(CASE WHEN head THEN {x} END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
ORACLE |= {
    "block_kinds": f"""WITH {_LETTERED}, md AS (SELECT document_id, k, x, k % 7 = 0 AS head, CASE k % 7 WHEN 0 THEN '## ' || x WHEN 2 THEN '- ' || x WHEN 3 THEN '| ' || x || ' |' WHEN 4 THEN '$$' || x || '$$' WHEN 5 THEN '![' || x || '](u)' WHEN 6 THEN '```' || chr(10) || x || chr(10) || '```' ELSE x END AS content FROM lx),
ps AS (SELECT *, CAST(coalesce(sum(strlen(content) + 2) OVER (PARTITION BY document_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset, sum(strlen(content) + 2) OVER (PARTITION BY document_id) - 2 AS size, {_SEC.format(x=_trim('x'))} AS section_path, lower({_trim('x')}) AS l FROM md)
SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY k) - 1 AS INTEGER) AS block_ord, CASE k % 7 WHEN 1 THEN 'paragraph' WHEN 2 THEN 'list' WHEN 3 THEN 'table' WHEN 4 THEN 'equation' WHEN 5 THEN 'figure' ELSE 'code' END AS kind,
 CASE k % 7 WHEN 1 THEN {_CATEGORY} WHEN 2 THEN 'procedure' WHEN 3 THEN 'table' WHEN 4 THEN 'equation' WHEN 5 THEN 'figure' ELSE 'code' END AS category, 2 AS heading_level, section_path, start_offset,
 CAST(least(start_offset + strlen(content) + CASE WHEN k % 7 IN (2, 3) THEN 2 ELSE 1 END, size) AS BIGINT) AS end_offset, {_EST('content')} AS tokens, sha256(content) AS content_sha256 FROM ps WHERE NOT head""",
    "chunk_sections": f"""WITH RECURSIVE {_LETTERED}, md AS (SELECT document_id, k, k % 5 = 0 AS head, CASE WHEN k % 5 = 0 THEN '# ' || left(x, 3) ELSE repeat(x || ' ', 4) END AS content FROM lx),
ps AS (SELECT *, CAST(coalesce(sum(strlen(content) + 2) OVER (PARTITION BY document_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, sum(strlen(content) + 2) OVER (PARTITION BY document_id) - 2 AS size, {_SEC.format(x=_trim('substr(content, 3)'))} AS path FROM md),
bl AS (SELECT document_id, path, content, start, least(start + strlen(content) + 1, size) AS fin, {_EST('content')} AS n, CAST(row_number() OVER (PARTITION BY document_id ORDER BY k) AS INTEGER) AS b FROM ps WHERE NOT head),
gr(document_id, b, path, total, grp, alone) AS (SELECT document_id, b, path, n, 1, n > 1200 FROM bl WHERE b = 1 UNION ALL
 SELECT bl.document_id, bl.b, bl.path, CASE WHEN NOT alone AND n <= 1200 AND bl.path = gr.path AND total + n <= 700 THEN total + n ELSE n END, CASE WHEN NOT alone AND n <= 1200 AND bl.path = gr.path AND total + n <= 700 THEN grp ELSE grp + 1 END, n > 1200 FROM gr JOIN bl ON bl.document_id = gr.document_id AND bl.b = gr.b + 1),
ch AS (SELECT bl.document_id, bl.path, grp, min(bl.b) AS fb, CAST(sum(n) AS BIGINT) AS tokens, max(n) > 1200 AS big, min(start) AS a, max(fin) AS z, string_agg(content, chr(10) || chr(10) ORDER BY bl.b) AS content FROM bl JOIN gr ON gr.document_id = bl.document_id AND gr.b = bl.b GROUP BY 1, 2, 3),
pa AS (SELECT document_id, path, min(fb) AS fb, min(a) AS a, max(z) AS z, string_agg(content, chr(10) || chr(10) ORDER BY fb) AS content, count(*) AS c FROM ch GROUP BY 1, 2 HAVING count(*) > 1),
al AS (SELECT document_id, path, fb, false AS is_parent, tokens, big, a, z, content, 0 AS c FROM ch UNION ALL SELECT document_id, path, fb, true, {_EST('content')}, {_EST('content')} > 1200, a, z, content, c FROM pa),
od AS (SELECT *, min(fb) OVER (PARTITION BY document_id, path) AS first, regexp_replace(regexp_replace(lower(path), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM al),
nu AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY first, is_parent DESC, fb) AS INTEGER) AS chunk_order FROM od),
id AS (SELECT *, document_id || '/' || slug || '/' || lpad(CAST(row_number() OVER (PARTITION BY document_id, slug ORDER BY chunk_order) AS VARCHAR), 3, '0') AS chunk_id FROM nu)
SELECT document_id, chunk_id, chunk_order, path AS section_path, is_parent, CASE WHEN NOT is_parent THEN max(CASE WHEN is_parent THEN chunk_id END) OVER (PARTITION BY document_id, path) END AS parent_id, CAST(c AS INTEGER) AS children, tokens, big AS is_oversized, a AS start_offset, CAST(z AS BIGINT) AS end_offset, sha256(content) AS content_sha256,
 lag(chunk_id) OVER (PARTITION BY document_id ORDER BY chunk_order) AS previous_id, lead(chunk_id) OVER (PARTITION BY document_id ORDER BY chunk_order) AS next_id FROM id""",
}
QUERIES = {f.__name__: f for f in (block_kinds, chunk_sections, asset_records, asset_stats, asset_places, asset_numbers, paragraph_blocks, list_items, chunk_records, chunk_oversize)}
