"""Registered queries of metadata, model seams and answers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import enrichment as N
from tessera.operators import fingerprints as P
from tessera.operators import metadata as M
from tessera.operators import models as O
from tessera.operators import structure as S
from tessera.plans import documents as D
from tessera.plans import search
from tessera.plans.documents_sql import _KW, _LINES, _MD, _WINDOW, _trim, _words
from tessera.plans.search import _BM25
from tessera.sources.tables import plain_pages, table

DIMS = 32


def embed_mock(spark, sf_dir):
    v = D._turns(spark, sf_dir).select("conv_id", "turn", O.mock_embedding(F.col("text"), DIMS).alias("v"))
    r = lambda k: (F.round(F.get("v", F.lit(k)).cast("double"), 4) + 0.0).alias(f"v{k}")  # noqa: E731  no negative zero
    return v.select("conv_id", "turn", r(0), r(7), r(31))


def embedding_inputs(spark, sf_dir):
    path = F.concat_ws(" > ", "source", "lang")
    made = lambda kind: F.sha2(M.embedding_input(kind, F.col("source"), F.when(F.col("doc_id") % 2 == 0, "Title"), path, F.coalesce("text", F.lit(""))), 256).alias(kind)
    return D._docs(spark, sf_dir).select("doc_id", *map(made, ("content", "section_title", "section_path", "book_path")))


def titles_and_authors(spark, sf_dir):
    i = F.col("doc_id")
    meta = F.when(i % 4 == 0, "Introduction").when(i % 4 == 1, "").otherwise(F.concat(F.lit("Title "), i.cast("string")))
    heading = F.when(i % 3 == 0, "Contents").otherwise(F.concat(F.lit("Head "), "source"))
    early = F.concat(F.when(i % 2 == 0, "Written by jane van doe\n").otherwise("by \n"), F.coalesce("text", F.lit("")))
    name = F.concat(F.lit("my-own_file "), i.cast("string"), F.lit(".pdf"))
    return D._docs(spark, sf_dir).select("doc_id", M.title(meta, heading, (i % 9).cast("int"), name).alias("title"), M.author(F.when(i % 5 == 0, "A. Name"), early).alias("author"))


def chunk_statistics(spark, sf_dir):
    docs = D._docs(spark, sf_dir).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).otherwise(0).alias("character_count"), F.when(F.col("doc_id") % 3 == 0, 5).otherwise(0).alias("token_estimate"))
    return M.filled_statistics(docs, "text").select("doc_id", "character_count", "token_estimate")


def concept_attach(spark, sf_dir):
    """Texts with the nations that they name."""
    nation = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("dealt with nation_"), (F.col("c_custkey") % 31).cast("string"), F.lit(" and NATION_"), F.col("c_nationkey").cast("string")).alias("t"))
    named = N.named_in(c, nation.select(F.col("n_name").alias("name")), "c_custkey", "t").join(nation.select(F.col("n_name").alias("name"), "n_nationkey"), "name")
    names = named.groupBy(F.col("chunk_id").alias("c_custkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "name"))), lambda x: x["name"]), ",").alias("concepts"))
    return c.select("c_custkey").join(names, "c_custkey", "left").select("c_custkey", F.coalesce("concepts", F.lit("")).alias("concepts"))


def keyword_attach(spark, sf_dir):
    """How many of the corpus's top keywords each document has, and how often."""
    docs = D._docs(spark, sf_dir)
    top = N.keywords(N.keyword_counts(docs, [], "text"), []).select("value")
    own = N.keyword_counts(docs, ["doc_id"], "text")
    return own.join(F.broadcast(top), "value").groupBy("doc_id").agg(F.count("*").alias("keywords"), F.sum("frequency").alias("uses"))  # 15 rows


def bibliography_items(spark, sf_dir):
    rows = S.lines(D._docs(spark, sf_dir), "doc_id", F.col("text"))
    line = F.when(F.col("ord") % 9 == 2, "## References").when(F.col("ord") % 9 == 6, "# Other").otherwise(F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("] "), "line"))
    return M.bibliography(rows.withColumn("line", line)).groupBy("document_id").agg(F.count("*").alias("items"), F.min("ord").alias("first_ord"))


def block_pages(spark, sf_dir):
    """Every line of each conversation turn found again on its pages; a turn is a page, a conversation a document."""
    turns = D._turns(spark, sf_dir)
    pages = turns.select(F.col("conv_id").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.col("text").alias("markdown"))
    blocks = turns.select(F.col("conv_id").alias("document_id"), "turn", F.posexplode(F.split("text", r"\n|\. ")).alias("at", "content")).where("trim(content) <> ''")
    blocks = blocks.select("document_id", F.row_number().over(W.partitionBy("document_id").orderBy("turn", "at")).alias("block_ord"), "content")
    return M.block_pages(blocks, pages)


def diagnostics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("code"), (F.col("event_id") % 7).alias("page"))
    d = M.diagnostics(e.where("code = 'error' OR code = 'click'").select("document_id", "code"), e.where("page > 4").select("document_id", "page"))
    return d.select("document_id", "status", F.array_join("warnings", ",").alias("warnings"), F.array_join("skipped_pages", ",").alias("skipped_pages"))


def error_kinds(spark, sf_dir):
    texts = F.array(*map(F.lit, ("File is ENCRYPTED", "need a password", "Invalid PDF body", "header not found", "timeout")))
    return table(spark, sf_dir, "events").groupBy(M.error_kind(F.element_at(texts, (F.col("event_id") % 5 + 1).cast("int"))).alias("kind")).agg(F.count("*").alias("n"))


def rerank_budget(spark, sf_dir):
    """BM25 hits reranked by a score of their own; for queries divisible by 100 the reranker fails and the order stays."""
    score = F.when(F.col("query_id") % 100 != 0, (F.col("id") % 7).cast("double"))
    return O.rerank(search._bm25(spark, sf_dir), score, 6, 4).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _answers(spark, sf_dir):
    queries = D._docs(spark, sf_dir).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 100 == 0, F.concat(F.lit("what is in "), "source")).otherwise("zzz qqqqq").alias("query"))
    return O.answer(queries, D._window(spark, sf_dir))


def answer_engine(spark, sf_dir):
    return _answers(spark, sf_dir).select("query_id", "status", "answer", "total", "verified", "invalid")


def answer_stream(spark, sf_dir):
    return O.answer_events(_answers(spark, sf_dir))


def abstention_metrics(spark, sf_dir):
    hits = search._bm25(spark, sf_dir).groupBy("query_id").agg(F.count("*").alias("retrieved"))
    a = _answers(spark, sf_dir).join(hits, "query_id", "left")
    return O.abstention(a.select(F.coalesce("retrieved", F.lit(0)).alias("retrieved"), F.when(F.col("status") == "no_evidence", "unsupported").otherwise("supported").alias("decision"), (F.col("query_id") % 150 == 0).alias("expected")))


def probe_sweep(spark, sf_dir):
    """nDCG-like gain of each candidate budget: the share of reranked top hits of a query's own language."""
    lang = D._docs(spark, sf_dir).select("doc_id", "lang")
    hits = search._bm25(spark, sf_dir, 20).join(lang.select(F.col("doc_id").alias("id"), F.col("lang").alias("a")), "id").join(lang.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("b")), "query_id")
    budgets = hits.withColumn("candidates", F.explode(F.array(*map(F.lit, (5, 10, 20))))).where("rank <= candidates")
    return budgets.groupBy("candidates").agg(F.count("*").alias("hits"), F.round(F.avg((F.col("a") == F.col("b")).cast("double")), 6).alias("same_language"))


def fingerprint_check(spark, sf_dir):
    """Conversations whose fingerprint is not the expected one: every third expects that of an altered text."""
    now = D.corpus_fingerprint(spark, sf_dir)
    then = D._turns(spark, sf_dir).withColumn("text", F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    h = F.array_sort(F.collect_list(X.content_hash(F.col("text"))))
    then = then.groupBy("conv_id").agg(F.sha2(F.array_join(h, "\n"), 256).alias("expected"))
    return now.join(then, "conv_id").where("fingerprint <> expected").select("conv_id")


def corpus_tree(spark, sf_dir):
    """Root, first level and leaves of the hash tree of all documents' texts, after every fifth text has changed."""
    docs = D._docs(spark, sf_dir)
    hashed = lambda text: docs.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("hash"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("!"), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    touched = docs.where("doc_id % 5 = 0")
    both = touched.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")).unionByName(touched.select(F.sha2(changed, 256).alias("hash")))
    return P.updated_tree(P.hash_tree(hashed(F.col("text")), 2), hashed(changed), both, 2)


def plain_outline(spark, sf_dir):
    """Markdown of texts without marks, by the shape of their lines, and its pages of equally many lines."""
    texts = D._docs(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("CHAPTER ONE\r\n1. first things\n\n  Plain line\n"), F.coalesce("text", F.lit("")))).otherwise(F.col("text")))
    pages = plain_pages(texts.select(F.col("doc_id").alias("document_id"), "text", (F.col("doc_id") % 4).cast("int").alias("page_count")))
    return pages.select("document_id", "page_number", F.sha2(F.concat(F.lit("|"), F.replace("markdown", F.lit("\n"), F.lit("\n|"))), 256).alias("sha256"), F.regexp_count("markdown", F.lit("(?m)^## ")).alias("headings"))


QUERIES = {f.__name__: f for f in (corpus_tree, plain_outline, embed_mock, embedding_inputs, titles_and_authors, chunk_statistics, concept_attach, keyword_attach, bibliography_items, block_pages, diagnostics, error_kinds, rerank_budget, answer_engine, answer_stream, abstention_metrics, probe_sweep, fingerprint_check)}

_T = "coalesce(text, '')"
_ANSWERS = _WINDOW + f""",
qs AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 100 = 0 THEN 'what is in ' || source ELSE 'zzz qqqqq' END AS query, CASE WHEN doc_id % 100 = 0 THEN lower(source) ELSE 'qqqqq' END AS term FROM documents WHERE doc_id % 50 = 0),
cx AS (SELECT query_id, lower(string_agg(block, '' ORDER BY ref)) AS context FROM w3 GROUP BY 1),
an AS (SELECT query_id, CASE WHEN context IS NOT NULL AND length(term) > 3 AND contains(context, term) THEN 'On ' || query || ': see [Ref 1].' END AS answer FROM qs LEFT JOIN cx USING (query_id))"""
_TITLE = "array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ')"
ORACLE = {
    "corpus_tree": """WITH h AS (SELECT sha256(CASE WHEN doc_id % 5 = 0 THEN '!' ELSE '' END || coalesce(text, '')) AS hash FROM documents), c AS (SELECT hash, count(*) AS n FROM h GROUP BY 1),
l2 AS (SELECT substr(hash, 1, 2) AS prefix, sha256(string_agg(hash || ':' || n, chr(10) ORDER BY hash)) AS digest FROM c GROUP BY 1),
l1 AS (SELECT substr(prefix, 1, 1) AS up, sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix)) AS digest FROM l2 GROUP BY 1)
SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT '', sha256(string_agg(up || ':' || digest, chr(10) ORDER BY up)) FROM l1""",
    "plain_outline": r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'CHAPTER ONE' || chr(13) || chr(10) || '1. first things' || chr(10) || chr(10) || '  Plain line' || chr(10) ELSE '' END || coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(t, '\r?\n'), lambda x: regexp_replace(regexp_replace(x, '^[ \t\x0B\f\r]+', ''), '[ \t\x0B\f\r]+$', '')), lambda x: x <> '') AS l FROM t),
m AS (SELECT doc_id, string_split(array_to_string(list_transform(l, lambda x: CASE WHEN length(x) < 60 AND regexp_matches(x, '^(?:[0-9]+\.|[A-Z0-9][A-Z0-9 \t\x0B\f\r]{1,38}(?:[A-Z0-9](?:[^A-Za-z0-9_]|$)|[ \t\x0B\f\r][A-Za-z0-9_]))') THEN chr(10) || '## ' || x || chr(10) ELSE x END), chr(10) || chr(10)), chr(10)) AS ls, greatest(1, doc_id % 4) AS n FROM l),
p AS (SELECT doc_id, ls, unnest(range(0, n)) AS k, CAST(ceil(len(ls) / n::DOUBLE) AS BIGINT) AS per FROM m),
q AS (SELECT doc_id, k, ls[k * per + 1 : (k + 1) * per] AS part FROM p)
SELECT doc_id AS document_id, CAST(k + 1 AS INTEGER) AS page_number, sha256(coalesce(nullif(array_to_string(list_transform(part, lambda x: '|' || x), chr(10)), ''), '|')) AS sha256, CAST(len(list_filter(part, lambda x: starts_with(x, '## '))) AS INTEGER) AS headings FROM q""",
    "embed_mock": f"""WITH h AS (SELECT conv_id, turn, sha256(text) AS d FROM conversations), r AS (SELECT conv_id, turn, list_transform(range({DIMS}), lambda i: sin(((('0x' || substr(d, CAST(((i * 4) % 28) * 2 + 1 AS BIGINT), 8))::BIGINT + i) % 4294967296)::DOUBLE)) AS v FROM h),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS m FROM r)
SELECT conv_id, turn, round(CAST(CAST(CAST(v[1] AS FLOAT) / m AS FLOAT) AS DOUBLE), 4) + 0.0 AS v0, round(CAST(CAST(CAST(v[8] AS FLOAT) / m AS FLOAT) AS DOUBLE), 4) + 0.0 AS v7, round(CAST(CAST(CAST(v[32] AS FLOAT) / m AS FLOAT) AS DOUBLE), 4) + 0.0 AS v31 FROM n""",
    "embedding_inputs": f"""SELECT doc_id, sha256({_T}) AS content, sha256(lang || chr(10) || chr(10) || {_T}) AS section_title, sha256(source || ' > ' || lang || chr(10) || chr(10) || {_T}) AS section_path,
sha256(CASE WHEN doc_id % 2 = 0 THEN 'Title' ELSE source END || ' > ' || source || ' > ' || lang || chr(10) || chr(10) || {_T}) AS book_path FROM documents""",
    "titles_and_authors": f"""WITH a AS (SELECT doc_id, source, list_filter(list_transform(string_split(lower(CASE WHEN doc_id % 2 = 0 THEN 'Written by jane van doe' ELSE 'by ' END || chr(10) || {_T}), chr(10)), lambda s: CASE WHEN starts_with(s, 'by ') OR starts_with(s, 'written by ') THEN {_trim("regexp_replace(s, '^(written by |by )', '')")} ELSE '' END), lambda s: s <> '')[1] AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 > 1 THEN 'Title ' || doc_id WHEN doc_id % 3 <> 0 AND doc_id % 9 <= 5 THEN 'Head ' || source ELSE 'My Own File ' || doc_id END AS title,
 CASE WHEN doc_id % 5 = 0 THEN 'A. Name' WHEN n IS NOT NULL THEN {_TITLE.format(x='n')} ELSE 'Unknown Author' END AS author FROM a""",
    "chunk_statistics": f"""WITH c AS (SELECT doc_id, text, CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END AS c, CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END AS t FROM documents),
d AS (SELECT *, CASE WHEN {_T} <> '' AND c = 0 THEN strlen(text) ELSE c END AS n FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS character_count, CAST(CASE WHEN {_T} <> '' AND t = 0 THEN greatest(1, n // 4) ELSE t END AS BIGINT) AS token_estimate FROM d""",
    "concept_attach": "SELECT c_custkey, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS concepts FROM (SELECT c_custkey, lower('dealt with nation_' || (c_custkey % 31) || ' and NATION_' || c_nationkey) AS t FROM customer) LEFT JOIN nation ON contains(t, lower(n_name)) GROUP BY 1",
    "bibliography_items": f"""WITH {_LINES}, b AS (SELECT document_id, ord, CASE WHEN ord % 9 = 2 THEN '## References' WHEN ord % 9 = 6 THEN '# Other' ELSE '[' || ord || '] ' || line END AS line FROM ln),
c AS (SELECT *, {_trim('line')} AS raw, last_value(CASE WHEN ord % 9 = 2 THEN 1 WHEN ord % 9 = 6 THEN 0 END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM b)
SELECT document_id, count(*) AS items, CAST(min(ord) AS INTEGER) AS first_ord FROM c WHERE i = 1 AND regexp_matches(raw, '^(?:\\d+\\.|\\*|\\[\\d+\\]|\\[[^\\]]+\\])\\s+.+') GROUP BY 1""",
    "diagnostics": """WITH e AS (SELECT user_id AS document_id, event_type AS code, event_id % 7 AS page FROM events), w AS (SELECT document_id, string_agg(DISTINCT code, ',' ORDER BY code) AS warnings FROM e WHERE code IN ('error', 'click') GROUP BY 1),
s AS (SELECT document_id, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS skipped_pages FROM e WHERE page > 4 GROUP BY 1)
SELECT document_id, 'partial' AS status, warnings, skipped_pages FROM w FULL JOIN s USING (document_id)""",
    "error_kinds": "SELECT CASE event_id % 5 WHEN 0 THEN 'encrypted_document' WHEN 1 THEN 'encrypted_document' WHEN 2 THEN 'invalid_document' WHEN 3 THEN 'invalid_document' ELSE 'other' END AS kind, count(*) AS n FROM events GROUP BY 1",
    "rerank_budget": f"""WITH {_BM25}, b AS (SELECT query_id, id, CASE WHEN query_id % 100 <> 0 THEN (id % 7)::DOUBLE ELSE score END AS score, CASE WHEN query_id % 100 <> 0 THEN (id % 7)::DOUBLE ELSE -rank END AS k FROM bm WHERE rank <= 6)
SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k DESC, id) AS INTEGER) AS rank FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC, id) <= 4""",
    "answer_engine": f"""WITH {_ANSWERS} SELECT query_id, CASE WHEN answer IS NULL THEN 'no_evidence' WHEN total = good AND good > 0 THEN 'verified' ELSE 'unverified' END AS status, answer, total, verified, total - good AS invalid FROM (SELECT query_id, answer, CAST(len(r) AS BIGINT) AS total,
 CAST(len(list_filter(r, lambda v: v <= n)) AS BIGINT) AS good, CAST(len(list_distinct(list_filter(r, lambda v: v <= n))) AS BIGINT) AS verified FROM (SELECT query_id, answer, coalesce(n, 0) AS n, list_transform(regexp_extract_all(answer, '\\[Ref (\\d+)\\]', 1), lambda v: CAST(v AS BIGINT)) AS r FROM an LEFT JOIN (SELECT query_id, count(*) AS n FROM w3 GROUP BY 1) USING (query_id)))""",
    "answer_stream": f"""WITH {_ANSWERS}, t AS (SELECT query_id, list_concat(list_transform({_words("coalesce(answer, '')")}, lambda w: {{'type': 'token', 'content': w}}), [{{'type': 'verification', 'content': CASE WHEN answer IS NULL THEN 'no_evidence' ELSE 'verified' END}}, {{'type': 'done', 'content': ''}}]) AS e FROM an)
SELECT query_id, seq, x.type AS type, x.content AS content FROM (SELECT query_id, CAST(unnest(range(len(e))) AS INTEGER) AS seq, unnest(e) AS x FROM t)""",
    "abstention_metrics": f"""WITH {_ANSWERS}, r AS (SELECT query_id, answer IS NULL AS a, query_id % 150 = 0 AS e FROM an)
SELECT coalesce(round(sum(CAST(a AND e AS INTEGER)) / nullif(sum(CAST(a AS INTEGER)), 0)::DOUBLE, 6), 0) AS abstention_precision, coalesce(round(sum(CAST(a AND e AS INTEGER)) / nullif(sum(CAST(e AS INTEGER)), 0)::DOUBLE, 6), 0) AS abstention_recall,
 CAST(sum(CAST(a AND NOT e AS INTEGER)) AS BIGINT) AS false_abstentions, CAST(sum(CAST(NOT a AND e AS INTEGER)) AS BIGINT) AS missed_abstentions, CAST(sum(CAST(a AS INTEGER)) AS BIGINT) AS generation_skipped FROM r""",
    "keyword_attach": f"""WITH {_KW.replace("source", "doc_id")}, top AS (SELECT value FROM kw GROUP BY 1 ORDER BY count(*) DESC, value LIMIT 15)
SELECT doc_id, count(DISTINCT value) AS keywords, count(*) AS uses FROM kw JOIN top USING (value) GROUP BY 1""",
    "probe_sweep": f"""WITH {_BM25.replace(f"<= {search.K}", "<= 20")}
SELECT candidates, count(*) AS hits, round(avg(CASE WHEN a.lang = b.lang THEN 1.0::DOUBLE ELSE 0 END), 6) AS same_language FROM bm JOIN (SELECT unnest([5, 10, 20]) AS candidates) ON rank <= candidates
JOIN documents a ON a.doc_id = bm.id JOIN documents b ON b.doc_id = bm.query_id GROUP BY 1""",
    "fingerprint_check": f"""WITH h AS (SELECT conv_id, sha256({_MD('text')}) AS a, sha256({_MD("CASE WHEN conv_id % 3 = 0 THEN text || '!' ELSE text END")}) AS b FROM conversations)
SELECT conv_id FROM (SELECT conv_id, sha256(string_agg(a, chr(10) ORDER BY a)) AS now, sha256(string_agg(b, chr(10) ORDER BY b)) AS expected FROM h GROUP BY 1) WHERE now <> expected""",
}
