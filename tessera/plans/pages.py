"""Registered queries of outlines, pages, metadata, sources and indexing, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import indexing as I
from tessera.operators import metadata as M
from tessera.operators import retrieval as R
from tessera.operators import structure as S
from tessera.operators.statistics import Statistics
from tessera.plans import documents as D
from tessera.plans.documents_sql import _LINES, _MDL, _NORMAL, _trim, _words
from tessera.sources.storage import work_folder
from tessera.sources.tables import from_result, gold_set_violations, pages_from_layout, pdf_status, to_result


def _paged(spark, sf_dir) -> DataFrame:
    """The Markdown lines of `section_tree` with page marks and breaks between them."""
    marked = F.when(F.col("ord") % 10 == 9, F.concat(F.lit("--- page "), F.col("ord").cast("string"), F.lit(" ---"))).when(F.col("ord") % 4 == 3, F.lit("<!-- pagebreak -->")).otherwise(F.col("line"))
    return D._markdown(spark, sf_dir).withColumn("line", marked)


def _numbers(c: str) -> Column:
    return F.array_join(F.transform(c, lambda p: p.cast("string")), ",")


def outline_nodes(spark, sf_dir):
    o = S.outline(S.marked_lines(_paged(spark, sf_dir)))
    return o.select("document_id", "ord", "node_id", "level", "heading", "parent_ord", _numbers("page_numbers").alias("page_numbers"))


def outline_warnings(spark, sf_dir):
    """Documents that begin with text and skip a level at every third heading."""
    rows = S.lines(D._docs(spark, sf_dir), "doc_id", F.col("text"), offsets=False)
    mark = F.concat(F.repeat(F.lit("#"), F.element_at(F.array(F.lit(1), F.lit(3), F.lit(2)), (F.floor(F.col("ord") / 6) % 3 + 1).cast("int"))), F.lit(" "))
    return S.outline_warnings(S.marked_lines(rows.withColumn("line", F.when(F.col("ord") % 6 == 1, F.concat(mark, "line")).otherwise(F.col("line")))))


def _layouts(spark, sf_dir) -> DataFrame:
    """Layouts of nodes and of pages, a document for each conversation and an entry for each turn; a turn's text is
    shuffled once."""
    def node(x: Column) -> Column:
        t = x["turn"]
        kind = F.when(t % 3 == 0, "heading").when(t % 3 == 1, "header").when(t % 6 == 2, "paragraph").otherwise("sidebar")
        return F.struct(t.alias("turn"), kind.alias("type"), F.when(t % 3 == 1, 2).alias("level"), x["text"].alias("text"), (t - 1).cast("int").alias("page"))

    def page(x: Column) -> Column:
        t = x["turn"]
        return F.struct(t.alias("turn"), F.when(t % 3 > 0, t + 100).cast("int").alias("page_number"), F.when(t % 2 == 0, x["text"]).alias("markdown"), F.when(t % 2 == 1, x["text"]).alias("text"))

    grouped = D._turns(spark, sf_dir).groupBy(F.col("conv_id").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    layout = F.struct(F.transform("turns", node).alias("nodes"), F.transform("turns", page).alias("pages"))
    return grouped.select("document_id", F.to_json(layout).alias("json_layout"), F.lit("").alias("markdown"))


def layout_outline(spark, sf_dir):
    o = S.outline(S.layout_nodes(_layouts(spark, sf_dir)))
    return o.select("document_id", "ord", "node_id", "level", "heading", "parent_ord", _numbers("page_numbers").alias("page_numbers"))


def layout_warnings(spark, sf_dir):
    return S.layout_warnings(S.layout_nodes(_layouts(spark, sf_dir)))


def layout_pages(spark, sf_dir):
    return pages_from_layout(_layouts(spark, sf_dir))


def _resolved(spark, sf_dir):
    """Headings found again on pages (turns): as a heading line, by a chunk's path, in the text, or not at all."""
    t, n = D._turns(spark, sf_dir), F.col("turn")
    three = F.array_join(F.slice(X.words(F.col("text")), 1, 3), " ")
    chapter = F.concat(F.lit("Chapter "), n.cast("string"))
    doc = F.col("conv_id").alias("document_id")
    pages = t.select(doc, (n + 1).cast("int").alias("page_number"), F.when(n % 4 == 1, F.concat(F.lit("# "), three, F.lit("\n"), F.col("text"))).otherwise(F.col("text")).alias("markdown"))
    nodes = t.select(doc, n.alias("node"), F.when(n % 4 < 2, three).when(n % 4 == 2, chapter).otherwise("Nowhere zz").alias("heading"))
    chunks = t.select(doc, n.alias("chunk_order"), chapter.alias("section_path"), F.array((n + 10).cast("int")).alias("pages"))
    return S.resolve_pages(nodes, pages, chunks)


def section_pages(spark, sf_dir):
    return _resolved(spark, sf_dir).select("document_id", "node", "page")


def section_page_warnings(spark, sf_dir):
    """Sections at the root whose pages were not found, where they have no pages of their own or the first alone."""
    n = F.col("node")
    given = F.when(n % 5 == 0, F.array(F.lit(1))).when(n % 5 == 1, F.array(F.lit(3))).when(n % 5 == 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array().cast("array<int>"))
    quoted = F.when(n % 7 == 3, F.concat(F.lit('a "b" '), "heading")).otherwise(F.col("heading"))
    return S.page_warnings(_resolved(spark, sf_dir).withColumns({"given": given, "heading": quoted, "is_root": n % 3 < 2}))


def metadata_map(spark, sf_dir):
    i = F.col("doc_id")
    s = i.cast("string")
    raw = F.concat(F.lit('{"title": "'), F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("T"), s)), F.lit('", "author": "A'), s, F.lit('", "page_count": '), (i % 4).cast("string"), F.lit(', "searchable": '), F.when(i % 2 == 0, F.lit("false")).otherwise(F.lit("true")), F.lit(', "pdf_type": "native", "fonts": ["a", "", "f'), s, F.lit('"]}'))
    docs = D._docs(spark, sf_dir).select(i.alias("document_id"), raw.alias("metadata"), F.when(i % 6 == 0, F.col("source")).alias("head"), (i % 5).cast("int").alias("last"))
    m = M.from_map(docs, F.col("head"), F.lit(2), F.col("last"))
    return m.select("document_id", "title", "author", "pdf_type", "page_count", F.array_join("fonts", ",").alias("fonts"), "encrypted", "searchable")


def metadata_consistency(spark, sf_dir):
    t = D._turns(spark, sf_dir)
    doc = F.col("conv_id").alias("document_id")
    meta = t.select(doc).distinct().select("document_id", F.when(F.col("document_id") % 2 == 0, 0).otherwise(7).alias("page_count"), F.lit(False).alias("searchable"))
    pages = t.where("conv_id % 3 > 0").select(doc, F.col("turn").alias("page_number"), F.when(F.col("conv_id") % 3 == 1, F.col("text")).otherwise("").alias("markdown"))
    chunks = t.where("turn % 2 = 0").select(doc, F.array((F.col("turn") + 2).cast("int")).alias("pages"))
    return M.consistent(meta, pages, chunks)


def pdf_bytes(spark, sf_dir):
    """Bytes of texts, some with the marks of PDF files and of encryption."""
    i, t = F.col("doc_id"), F.coalesce("text", F.lit(""))
    body = F.when(i % 5 == 0, F.lit("")).when(i % 5 == 1, t).when(i % 5 == 2, F.concat(F.lit("%PDF-1.7 "), t)).when(i % 5 == 3, F.concat(F.lit("%PDF-1.4 /Encrypt /V 2 "), t)).otherwise(F.concat(F.repeat(F.lit("x"), 2000), F.lit("%PDF-"), t))
    return D._docs(spark, sf_dir).select("doc_id", pdf_status(body.cast("binary")).alias("status"))


def gold_violations(spark, sf_dir):
    n = F.col("conv_id") + F.col("turn")
    gold = D._turns(spark, sf_dir).select(
        F.when(n % 11 == 0, "").otherwise(F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - F.col("turn") % 2).cast("string"))).alias("id"), F.when(n % 7 == 0, "odd").when(n % 3 == 0, "abstention").otherwise("concept").alias("intent"),
        F.when(n % 5 == 0, " ").otherwise(F.col("text")).alias("query"), F.when(n % 4 > 0, F.array(F.lit("c"))).alias("expected_chunk_ids"), (n % 3 == 0).alias("expected_no_evidence"),
    )
    return gold_set_violations(gold).groupBy("id", "problem").agg(F.count("*").alias("n"))


def result_roundtrip(spark, sf_dir):
    """Rows as versioned JSON results and back."""
    docs = D._docs(spark, sf_dir).select("doc_id", "text", "lang", F.array("source", "lang").alias("tags"))
    back = from_result(to_result(docs), "doc_id bigint, text string, lang string, tags array<string>")
    return back.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "lang", F.array_join("tags", ",", "-").alias("tags"))


def index_progress(spark, sf_dir):
    """How far a job is that has indexed the points divisible by 4 of its diff plan."""
    return I.progress(D.diff_plan(spark, sf_dir), D._docs(spark, sf_dir).where("doc_id % 4 = 0").select(F.col("doc_id").alias("point_id")))


def upsert_points(spark, sf_dir):
    docs = D._docs(spark, sf_dir).select(F.col("doc_id").alias("point_id"), F.coalesce("text", F.lit("")).alias("text"))
    old = docs.where("point_id % 3 <> 0").withColumn("text", F.concat(F.lit("old "), "text"))
    return I.upsert(old, docs.where("point_id % 2 = 0"), "point_id").select("point_id", F.sha2("text", 256).alias("sha256"))


def content_store(spark, sf_dir):
    """Contents put, replaced and deleted, and looked up for every id."""
    c = D._docs(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"))
    put = I.content_put(c.where("chunk_id % 2 = 0"), c.where("chunk_id % 3 = 0").withColumn("content", F.concat(F.lit("new "), "content")))
    left = I.content_delete(put, c.where("chunk_id % 5 = 0"))
    return I.content_get(left, c).select("chunk_id", F.sha2("content", 256).alias("sha256"))


def _snapshot(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("document_id"), F.concat_ws("/", F.col("doc_id").cast("string"), "lang").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("content"))


def index_documents(spark, sf_dir):
    """The diff plan of a second snapshot against the index of a first one, and what the index then holds of each point."""
    docs = D._docs(spark, sf_dir)
    index = I.Index(spark, work_folder(spark, "index"), parts=8)
    first = docs.where("doc_id % 3 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("old Acme Corp "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    I.index_documents(index, _snapshot(first))
    plan = I.index_documents(index, _snapshot(docs.where("doc_id % 7 <> 0")))
    counted = index.statistics.postings().groupBy("point_id").agg(F.count("*").alias("terms"))
    held = index.points.read().select("point_id", "document_id", F.sha2("content", 256).alias("content_sha256")).join(index.vectors.read().select("point_id", F.size("vector").alias("dims")), "point_id", "left").join(counted, "point_id", "left")
    return plan.join(held, "point_id", "left").select("action", "document_id", "content_sha256", "dims", F.coalesce("terms", F.lit(0)).alias("terms"))


def index_shared_chunks(spark, sf_dir):
    """Evidence of an index whose documents use the same few chunk ids, after a second snapshot that names other ones."""
    docs = D._docs(spark, sf_dir)
    index = I.Index(spark, work_folder(spark, "index"), parts=8)
    for rest in (0, 4):
        named = F.when(F.col("doc_id") % 9 == rest, F.concat(F.lit("Rick Rubin read this. "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
        I.index_documents(index, docs.select(F.col("doc_id").alias("document_id"), F.concat(F.lit("c"), (F.col("doc_id") % 4).cast("string")).alias("chunk_id"), named.alias("content")))
    return index.evidence.read().select("document_id", "chunk_id", "node_id").where("node_id = 'rick rubin'")


def stream_statistics(spark, sf_dir):
    """Weights of all texts after batches that add, change and take away texts, of which one is replayed, and what was
    weighed before the last one is weighed anew."""
    docs = D._docs(spark, sf_dir).select(F.col("doc_id").alias("document_id"), F.lit("t").alias("point_id"), F.coalesce("text", F.lit("")).alias("text"))
    i = F.col("document_id")
    before = lambda words: F.concat(F.lit(words), "text").alias("text")
    batches = [(docs.where(i % 3 != 0).select("document_id", "point_id", before("old words ")), None), (docs.where(i % 2 == 0), None), (docs.where((i % 5 == 0) & (i % 7 != 0)).select("document_id", "point_id", before("new ")), docs.where(i % 7 == 0))]
    folder = work_folder(spark, "statistics")
    for number in (0, 1, 1, 2):
        Statistics(spark, folder, 8).update(*batches[number], ("batches", number))
    found = Statistics(spark, folder, 8).postings()
    return found.groupBy("document_id").agg(F.count("*").alias("terms"), F.round(F.sum(F.col("weight").cast("double")), 4).alias("total_weight"), F.count_distinct("stats_version").alias("versions"))


def bound_encoder(spark, sf_dir):
    """Weights of incoming texts by the statistics of both corpora, and of queries by those of the persisted one."""
    docs = D._docs(spark, sf_dir)
    new, asked = R.bound_postings(docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 4 = 0"), docs.where("doc_id % 50 = 0"), "doc_id", "text")
    both = new.withColumn("side", F.lit("document")).unionByName(asked.withColumn("side", F.lit("query")))
    return both.groupBy("side", "id").agg(F.count("*").alias("terms"), F.round(F.sum(F.col("weight").cast("double")), 4).alias("total_weight"), F.count_distinct("stats_version").alias("versions"))


QUERIES = {f.__name__: f for f in (outline_nodes, outline_warnings, layout_outline, layout_warnings, layout_pages, section_pages, section_page_warnings, metadata_map, metadata_consistency, pdf_bytes, gold_violations, result_roundtrip, index_progress, upsert_points, content_store, index_documents, index_shared_chunks, stream_statistics, bound_encoder)}

_PAGED = _MDL + f""", pp AS (SELECT document_id, ord, line, CASE WHEN ord % 10 = 9 THEN ord END AS mark, sum(CASE WHEN ord % 10 <> 9 AND ord % 4 = 3 THEN 1 ELSE 0 END) OVER o AS brk FROM md WINDOW o AS (PARTITION BY document_id ORDER BY ord)),
pb AS (SELECT *, last_value(mark IGNORE NULLS) OVER o AS m, last_value(CASE WHEN mark IS NOT NULL THEN brk END IGNORE NULLS) OVER o AS k FROM pp WINDOW o AS (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pq AS (SELECT document_id, ord, line, CAST(coalesce(m + brk - k, brk + 1) AS BIGINT) AS page, ord // 6 AS b, (ord // 6) % 3 + 1 AS level FROM pb WHERE ord % 10 <> 9 AND ord % 4 <> 3 AND {_trim('line')} <> '')"""
_HEAD_TEXT = _trim("substr(line, CAST(level + 1 AS BIGINT))")
_NORM = lambda x: _trim(_NORMAL.replace("(text,", f"({x},"))
_THREE = f"array_to_string(({_words('text')})[1:3], ' ')"
_GOLD = """gd AS (SELECT CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE conv_id || '-' || (turn - turn % 2) END AS id, conv_id + turn AS n, text FROM conversations), gc AS (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM gd)"""
_PAGE_LIST = "array_to_string(list_transform(p, lambda v: CAST(v AS VARCHAR)), ',') AS page_numbers"
_TURNS = f"c AS (SELECT conv_id AS document_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ord, turn, greatest(turn - 1, 1) AS page, {_trim('text')} AS h FROM conversations)"


def _bound(corpus: str, texts: str) -> str:
    return f"""(SELECT id, count(*) AS terms, round(sum(CAST(CAST(ln(1 + (total - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean)) AS FLOAT) AS DOUBLE)), 4) AS total_weight FROM
 (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(t) AS length, unnest(t) AS term FROM tok WHERE {texts}) GROUP BY ALL) JOIN (SELECT term, count(DISTINCT id) AS df FROM (SELECT id, unnest(t) AS term FROM tok WHERE {corpus}) GROUP BY 1) USING (term)
 CROSS JOIN (SELECT count(*) AS total, avg(len(t)) AS mean FROM tok WHERE len(t) > 0 AND ({corpus})) GROUP BY 1)"""


ORACLE = {
    "outline_nodes": f"""WITH {_PAGED}, hd AS (SELECT *, CASE WHEN {_HEAD_TEXT} = '' THEN 'Untitled Section' ELSE {_HEAD_TEXT} END AS heading FROM pq WHERE ord % 6 = 0),
tp AS (SELECT document_id, ord, page FROM hd UNION ALL SELECT document_id, b * 6, page FROM pq WHERE ord % 6 <> 0 UNION ALL SELECT document_id, (b - 1) * 6, page FROM pq WHERE ord % 6 <> 0 AND level >= 2 UNION ALL SELECT document_id, (b - 2) * 6, page FROM pq WHERE ord % 6 <> 0 AND level = 3),
pl AS (SELECT document_id, ord, list_sort(list(DISTINCT page)) AS p FROM tp GROUP BY 1, 2)
SELECT hd.document_id, hd.ord, 'sec-' || row_number() OVER (PARTITION BY hd.document_id ORDER BY hd.ord) AS node_id, CAST(level AS INTEGER) AS level, heading, CASE WHEN level > 1 THEN CAST(hd.ord - 6 AS INTEGER) END AS parent_ord, {_PAGE_LIST}
FROM hd JOIN pl ON pl.document_id = hd.document_id AND pl.ord = hd.ord""",
    "outline_warnings": f"""WITH {_LINES}, h AS (SELECT document_id, ord, {_trim('line')} AS heading, (ord // 6) % 3 AS b FROM ln WHERE ord % 6 = 1), f AS (SELECT document_id, max(ord) AS last FROM ln WHERE {_trim('line')} <> '' OR ord % 6 = 1 GROUP BY 1)
SELECT document_id, ord, 'empty heading text encountered at page 1' AS message FROM h WHERE heading = '' UNION ALL
SELECT document_id, ord, 'heading level skipped: expected level 2 before level 3 for heading ''' || CASE WHEN heading = '' THEN 'Untitled Section' ELSE heading END || '''' FROM h WHERE b = 1 UNION ALL
SELECT ln.document_id, CASE WHEN last >= 1 THEN 1 ELSE 0 END, 'preamble text detected before first heading node at page 1' FROM ln JOIN f USING (document_id) WHERE ord = 0 AND {_trim('line')} <> ''""",
    "layout_outline": f"""WITH {_TURNS}, hd AS (SELECT *, turn % 3 + 1 AS level FROM c WHERE turn % 3 < 2),
tp AS (SELECT document_id, ord, page FROM hd UNION ALL SELECT hd.document_id, hd.ord, c.page FROM hd JOIN c ON c.document_id = hd.document_id AND c.turn % 3 = 2 AND c.turn // 3 = hd.turn // 3),
pl AS (SELECT document_id, ord, list_sort(list(DISTINCT page)) AS p FROM tp GROUP BY 1, 2)
SELECT hd.document_id, hd.ord, 'sec-' || row_number() OVER (PARTITION BY hd.document_id ORDER BY hd.ord) AS node_id, CAST(level AS INTEGER) AS level, CASE WHEN h = '' THEN 'Untitled Section' ELSE h END AS heading, CASE WHEN level = 2 THEN CAST(hd.ord - 1 AS INTEGER) END AS parent_ord, {_PAGE_LIST}
FROM hd JOIN pl ON pl.document_id = hd.document_id AND pl.ord = hd.ord""",
    "layout_warnings": f"""WITH {_TURNS} SELECT document_id, ord, 'empty heading text encountered at page ' || page AS message FROM c WHERE turn % 3 < 2 AND h = '' UNION ALL SELECT document_id, ord, 'ambiguous page reference ' || (turn - 1) || ' in JSON layout node' FROM c WHERE turn - 1 < 1
UNION ALL SELECT document_id, ord, 'unmapped custom layout node type: ''sidebar'' on page ' || page FROM c WHERE turn % 6 = 5""",
    "layout_pages": "SELECT conv_id AS document_id, CAST(CASE WHEN turn % 3 > 0 THEN turn + 100 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn) END AS INTEGER) AS page_number, text AS markdown FROM conversations",
    "section_pages": f"""WITH t AS (SELECT conv_id, turn, text, {_THREE} AS three FROM conversations), pg AS (SELECT conv_id, turn + 1 AS page, CASE WHEN turn % 4 = 1 THEN '# ' || three || chr(10) || text ELSE text END AS md FROM t),
nd AS (SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN three WHEN turn % 4 = 2 THEN 'Chapter ' || turn ELSE 'Nowhere zz' END AS h FROM t), nk AS (SELECT *, {_NORM('h')} AS key FROM nd),
hl AS (SELECT conv_id, page, unnest(string_split(md, chr(10))) AS line FROM pg), ha AS (SELECT conv_id, {_NORM("regexp_replace(" + _trim('line') + ", '^#+', '')")} AS key, min(page) AS a FROM hl WHERE starts_with(ltrim(line), '#') GROUP BY 1, 2),
hb AS (SELECT conv_id, {_NORM("'Chapter ' || turn")} AS key, min(turn + 10) AS b FROM t GROUP BY 1, 2), po AS (SELECT conv_id, page, x FROM (SELECT conv_id, page, md, {_NORM('md')} AS x FROM pg) WHERE NOT contains(x, 'contents') AND NOT contains(md, '.....') AND NOT contains(md, '. . . .')),
hc AS (SELECT nk.conv_id, nk.turn, min(page) AS c FROM nk JOIN po ON po.conv_id = nk.conv_id AND contains(x, key) WHERE key <> '' GROUP BY 1, 2)
SELECT nk.conv_id AS document_id, nk.turn AS node, CAST(coalesce(a, b, c) AS INTEGER) AS page FROM nk LEFT JOIN ha ON ha.conv_id = nk.conv_id AND ha.key = nk.key LEFT JOIN hb ON hb.conv_id = nk.conv_id AND hb.key = nk.key LEFT JOIN hc ON hc.conv_id = nk.conv_id AND hc.turn = nk.turn""",
    "section_page_warnings": f"""SELECT document_id, node, 'semantic page resolution unavailable for heading "' || CASE WHEN node % 7 = 3 THEN 'a \\"b\\" ' ELSE '' END || h || '"' AS message FROM (WITH t AS (SELECT conv_id, turn, text, {_THREE} AS three FROM conversations), pg AS (SELECT conv_id, turn + 1 AS page, CASE WHEN turn % 4 = 1 THEN '# ' || three || chr(10) || text ELSE text END AS md FROM t),
nd AS (SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN three WHEN turn % 4 = 2 THEN 'Chapter ' || turn ELSE 'Nowhere zz' END AS h FROM t), nk AS (SELECT *, {_NORM('h')} AS key FROM nd),
hl AS (SELECT conv_id, page, unnest(string_split(md, chr(10))) AS line FROM pg), ha AS (SELECT conv_id, {_NORM("regexp_replace(" + _trim('line') + ", '^#+', '')")} AS key, min(page) AS a FROM hl WHERE starts_with(ltrim(line), '#') GROUP BY 1, 2),
hb AS (SELECT conv_id, {_NORM("'Chapter ' || turn")} AS key, min(turn + 10) AS b FROM t GROUP BY 1, 2), po AS (SELECT conv_id, page, x FROM (SELECT conv_id, page, md, {_NORM('md')} AS x FROM pg) WHERE NOT contains(x, 'contents') AND NOT contains(md, '.....') AND NOT contains(md, '. . . .')),
hc AS (SELECT nk.conv_id, nk.turn, min(page) AS c FROM nk JOIN po ON po.conv_id = nk.conv_id AND contains(x, key) WHERE key <> '' GROUP BY 1, 2)
SELECT nk.conv_id AS document_id, nk.turn AS node, CAST(coalesce(a, b, c) AS INTEGER) AS page, nk.h FROM nk LEFT JOIN ha ON ha.conv_id = nk.conv_id AND ha.key = nk.key LEFT JOIN hb ON hb.conv_id = nk.conv_id AND hb.key = nk.key LEFT JOIN hc ON hc.conv_id = nk.conv_id AND hc.turn = nk.turn) WHERE page IS NULL AND node % 3 < 2 AND node % 5 NOT IN (1, 2)""",
    "metadata_map": """SELECT doc_id AS document_id, CASE WHEN doc_id % 3 <> 0 THEN 'T' || doc_id WHEN doc_id % 6 = 0 THEN coalesce(nullif(source, ''), 'Untitled Document') ELSE 'Untitled Document' END AS title, 'A' || doc_id AS author, 'native' AS pdf_type,
 CAST(CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 ELSE greatest(2, doc_id % 5) END AS INTEGER) AS page_count, 'a,f' || doc_id AS fonts, false AS encrypted, doc_id % 2 = 1 AS searchable FROM documents""",
    "metadata_consistency": """WITH t AS (SELECT conv_id, count(*) AS n, max(CASE WHEN turn % 2 = 0 THEN turn + 2 END) AS last, max(CASE WHEN text <> '' THEN 1 ELSE 0 END) AS has_text FROM conversations GROUP BY 1)
SELECT conv_id AS document_id, CAST(CASE WHEN conv_id % 2 = 0 THEN greatest(CASE WHEN conv_id % 3 > 0 THEN n ELSE 0 END, coalesce(last, 0)) ELSE 7 END AS INTEGER) AS page_count, conv_id % 3 = 1 AND has_text = 1 AS searchable FROM t""",
    "pdf_bytes": """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN CASE WHEN coalesce(text, '') = '' THEN 'empty' ELSE 'not_pdf' END WHEN 2 THEN 'ok' WHEN 3 THEN 'encrypted' ELSE 'not_pdf' END AS status FROM documents""",
    "gold_violations": f"""WITH {_GOLD}, p AS (SELECT id, unnest(list_filter([CASE WHEN id = '' THEN 'empty id' END, CASE WHEN c > 1 THEN 'repeated id' END, CASE WHEN n % 7 = 0 THEN 'unknown intent' END, CASE WHEN n % 5 = 0 OR trim(text) = '' THEN 'empty query' END,
 CASE WHEN n % 3 = 0 AND n % 4 > 0 THEN 'chunks expected of an abstention query' END, CASE WHEN n % 3 <> 0 AND n % 4 = 0 THEN 'no chunks expected' END], lambda v: v IS NOT NULL)) AS problem FROM gc) SELECT id, problem, count(*) AS n FROM p GROUP BY 1, 2""",
    "result_roundtrip": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, lang, coalesce(source, '-') || ',' || coalesce(lang, '-') AS tags FROM documents",
    "index_progress": """WITH d AS (SELECT doc_id, doc_id % 7 <> 0 AS was, doc_id % 11 <> 0 AS is_, doc_id % 5 = 0 AS stale FROM documents), c AS (SELECT CAST(sum(CASE WHEN is_ AND (NOT was OR stale) AND doc_id % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS indexed,
 CAST(sum(CASE WHEN is_ AND was AND NOT stale THEN 1 ELSE 0 END) AS BIGINT) AS skipped, CAST(sum(CASE WHEN was AND NOT is_ THEN 1 ELSE 0 END) AS BIGINT) AS deleted, CAST(sum(CASE WHEN is_ THEN 1 ELSE 0 END) AS BIGINT) AS total FROM d)
SELECT *, round(100.0::DOUBLE * (indexed + skipped) / total, 3) AS percent FROM c""",
    "upsert_points": "SELECT doc_id AS point_id, sha256(CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE 'old ' || coalesce(text, '') END) AS sha256 FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0",
    "content_store": "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN sha256('new ' || coalesce(text, '')) WHEN doc_id % 2 = 0 THEN sha256(coalesce(text, '')) END AS sha256 FROM documents",
    "index_documents": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 3 <> 0 AS was, doc_id % 7 <> 0 AS is_ FROM documents)
SELECT CASE WHEN was AND is_ AND doc_id % 5 = 0 THEN 'modified' WHEN was AND is_ THEN 'unchanged' WHEN is_ THEN 'new' ELSE 'deleted' END AS action, CASE WHEN is_ THEN doc_id END AS document_id, CASE WHEN is_ THEN sha256(t) END AS content_sha256, CASE WHEN is_ THEN 32 END AS dims,
 CASE WHEN is_ THEN CAST(len(list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+'))) AS BIGINT) ELSE 0 END AS terms FROM d WHERE was OR is_""",
    "index_shared_chunks": "SELECT doc_id AS document_id, 'c' || (doc_id % 4) AS chunk_id, 'rick rubin' AS node_id FROM documents WHERE doc_id % 9 = 4",
    "stream_statistics": """WITH tok AS (SELECT doc_id AS id, regexp_extract_all(lower(CASE WHEN doc_id % 5 = 0 THEN 'new ' WHEN doc_id % 2 = 0 THEN '' ELSE 'old words ' END || coalesce(text, '')), '[a-z0-9]+') AS t FROM documents WHERE doc_id % 7 <> 0 AND (doc_id % 5 = 0 OR doc_id % 2 = 0 OR doc_id % 3 <> 0)),
tf AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(t) AS length, unnest(t) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), st AS (SELECT count(*) AS total, avg(len(t)) AS mean FROM tok WHERE len(t) > 0)
SELECT id AS document_id, count(*) AS terms, round(sum(CAST(CAST(ln(1 + (total - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean)) AS FLOAT) AS DOUBLE)), 4) AS total_weight, 1 AS versions FROM tf JOIN df USING (term) CROSS JOIN st GROUP BY 1""",
    "bound_encoder": f"""WITH tok AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents)
SELECT 'document' AS side, id, terms, total_weight, 1 AS versions FROM {_bound('id % 3 <> 0 OR id % 4 = 0', 'id % 4 = 0')} UNION ALL SELECT 'query', id, terms, total_weight, 1 FROM {_bound('id % 3 <> 0', 'id % 50 = 0')}""",
}
