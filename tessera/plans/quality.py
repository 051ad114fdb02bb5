"""Registered queries of enrichment, content, gates and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import lexicon as L
from tessera.functions import text as X
from tessera.operators import answers as A
from tessera.operators import enrichment as N
from tessera.operators import evaluation as E
from tessera.operators import indexing as I
from tessera.operators import models as O
from tessera.operators import retrieval as R
from tessera.plans import documents as D
from tessera.plans import search
from tessera.plans.documents_sql import _GRAPH, _KW, _MENTIONS, _trim, _words
from tessera.plans.search import _BM25, _DENSE, _METRICS
from tessera.sources.storage import stored
from tessera.sources.tables import table


def _stories(spark, sf_dir) -> DataFrame:
    """Documents, with a sentence about a firm, its founder and its place in front of every fourth."""
    i = F.col("doc_id")
    founder = F.when(i % 8 == 0, "Rick Rubin").otherwise("Atatürk")
    firm = F.concat(F.lit("Anton"), (i % 40).cast("string"), F.lit(" Holding was founded by "), founder, F.when(i % 12 == 0, " in New York. ").otherwise(" at Ankara. "))
    return D._docs(spark, sf_dir).select("doc_id", "source", "lang", F.when(i % 4 == 0, F.concat(firm, F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit(""))).alias("text"))


def document_entities(spark, sf_dir):
    """Entities of whole documents, grouped over the corpus."""
    return N.entities(N.mentions(_stories(spark, sf_dir), "doc_id", "text"))


def keyword_fragments(spark, sf_dir):
    """Keywords of each source without fragments of its entities, with the number of texts that hold them."""
    docs = _stories(spark, sf_dir)
    names = N.mentions(docs, "doc_id", "text").join(docs.select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id").select("source", F.col("text").alias("name")).distinct()
    counts = N.keyword_counts(docs, ["source"], "text", "doc_id", N.entity_fragments(names, ["source"]))
    return N.keywords(counts, ["source"]).select("source", "value", "frequency", "chunks", "rank", "score")


def keyword_chunks(spark, sf_dir):
    """How many texts of each source hold how many of its keywords, and how often in all."""
    docs = D._docs(spark, sf_dir)
    top = N.keywords(N.keyword_counts(docs, ["source"], "text"), ["source"])
    return N.keyword_chunks(top, docs, ["source"], "doc_id", "text").groupBy("source", "value").agg(F.count("*").alias("texts"), F.sum("uses").alias("uses"), F.min("chunk_id").alias("first_text"))


def _headings(spark, sf_dir) -> DataFrame:
    """Headings of levels 1 to 4 of pages' HTML."""
    html = table(spark, sf_dir, "pages")
    level = lambda k: F.transform(F.regexp_extract_all("html", F.lit(f"(?i)<h{k}[^>]*>([^<]*)</h{k}>"), F.lit(1)), lambda h: F.struct(h.alias("heading"), F.lit(k).alias("level")))
    return html.select(F.inline(F.concat(*map(level, (1, 2, 3, 4)))))


def concept_levels(spark, sf_dir):
    """Concepts of headings of all levels and of two-word phrases of documents, without fragments of names."""
    t = X.tokens(F.coalesce(F.col("text"), F.lit("")))
    phrase = F.concat_ws(" ", F.get(t, F.lit(0)), F.get(t, F.lit(1)))
    phrases = D._docs(spark, sf_dir).select(phrase.alias("value"), F.when(F.col("doc_id") % 2 == 0, 0.8).otherwise(0.7).alias("score")).distinct()
    fragments = D._docs(spark, sf_dir).where("doc_id % 6 = 0").select(phrase.alias("value")).distinct()
    return N.concepts(_headings(spark, sf_dir), phrases, fragments).select("concept_id", "name", "score")


def _topics(spark, sf_dir) -> DataFrame:
    """Names to look for: the first two words of every conversation's first turn, and the nations."""
    t = X.tokens(F.col("text"))
    first = D._turns(spark, sf_dir).where("turn = 0").select(F.concat_ws(" ", F.get(t, F.lit(0)), F.get(t, F.lit(1))).alias("name"))
    return first.unionByName(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))).where("name <> ''").distinct()


def concepts_named(spark, sf_dir):
    """Which documents hold which names, anywhere in their texts."""
    return N.named_in(D._docs(spark, sf_dir), _topics(spark, sf_dir), "doc_id", "text").groupBy("name").agg(F.count("*").alias("texts"), F.min("chunk_id").alias("first_text"))


def relates_to(spark, sf_dir):
    """Entities of documents and the names that their texts hold."""
    docs = _stories(spark, sf_dir)
    attached = N.named_in(docs, _topics(spark, sf_dir), "doc_id", "text").select("chunk_id", F.concat(F.lit("concept:"), X.concept_slug(F.col("name"))).alias("concept_id"))
    return N.related_concepts(N.mentions(docs, "doc_id", "text"), attached)


def summary_topics(spark, sf_dir):
    """Summaries of conversations with their best topics: the first words of their turns, scored by turn."""
    t = D._turns(spark, sf_dir)
    topics = t.select("conv_id", F.get(X.tokens(F.col("text")), F.lit(0)).alias("name"), (1.0 / (F.col("turn") + 1)).alias("score")).where("name IS NOT NULL AND conv_id % 4 > 0")
    return N.summary_with_topics(N.document_summary(t, "conv_id", "turn", "text"), topics, "conv_id")


def recognised_entities(spark, sf_dir):
    """Mentions of a recogniser that knows one person and fails on some texts, else those of the rules."""
    def known(docs: DataFrame) -> DataFrame:
        some = docs.where("chunk_id % 3 = 0 AND contains(text, 'Rubin')")
        return some.select("chunk_id", F.when(F.col("chunk_id") % 5 > 0, "Frederick Rubin").alias("text"), F.lit("person").alias("type"), F.lit(0.97).alias("confidence"))

    return N.recognised(D._named(spark, sf_dir), "chunk_id", "text", known)


def _contents(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = D._docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return docs.where("id % 2 = 0"), docs.where("id % 5 > 0").withColumn("content", F.concat(F.lit("stored "), "content"))


def sparse_with_content(spark, sf_dir):
    """BM25 hits with the content of their payload, else of the content store, else none."""
    payload, store = _contents(spark, sf_dir)
    return R.with_content(search._bm25(spark, sf_dir), payload, store).select("query_id", "id", "rank", F.sha2("content", 256).alias("content_sha256"))


def dense_with_content(spark, sf_dir):
    payload, store = _contents(spark, sf_dir)
    hits = search._dense(spark, sf_dir).join(payload.select("id", F.col("content").alias("own")), "id", "left")
    return R.with_content(hits, store, payload="own").select("query_id", "id", "rank", F.sha2("content", 256).alias("content_sha256"))


def graph_with_content(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("content"))
    return R.with_content(D.graph_retrieve(spark, sf_dir), o.where("id % 3 = 0"), o.where("id % 2 = 0").withColumn("content", F.lit("stored"))).select("query_id", "id", "rank", "content")


def graph_fusion_rule(spark, sf_dir):
    """Fusion where the graph has hits; dense hits unchanged for queries without any."""
    graph = D.graph_retrieve(spark, sf_dir).where("query_id % 100 = 0")
    return R.graph_fuse(search._dense(spark, sf_dir), graph, 10).select("query_id", "id", "score", "rank")


def query_checks(spark, sf_dir):
    n = F.col("conv_id") + F.col("turn")
    q = D._turns(spark, sf_dir).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.when(n % 5 == 0, "").otherwise(F.col("text")).alias("query"),
        F.array((n % 3).cast("int"), F.col("turn").cast("int")).alias("page_numbers"), F.when(n % 4 == 0, F.array(F.lit("table"), F.lit("video"))).alias("content_types"),
    )
    return R.query_problems(q).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("problem")), "; ").alias("problems"))


def question_terms(spark, sf_dir):
    return D._turns(spark, sf_dir).select("conv_id", "turn", F.array_join(A.query_terms(F.concat(F.lit("?What's "), F.col("text"), F.lit('."'))), ",").alias("terms"))


def _replies(n):
    forms = ('{"decision": "supported"}', '{"decision": "unsupported"}', "no idea", ' {"decision": " SUPPORTED "} ', '{"decision": "supported"} so', '{"answer": 1}')
    return F.element_at(F.array(*map(F.lit, forms)), (n % len(forms) + 1).cast("int"))


def gate_attempts(spark, sf_dir):
    """Replies of a gate, parsed strictly, with a second attempt after an error."""
    n = F.col("conv_id") + F.col("turn")
    return D._turns(spark, sf_dir).select("conv_id", "turn", A.attempted_decision(_replies(n), _replies(n * 5 + F.col("turn"))).alias("decision"))


def gate_medians(spark, sf_dir):
    runs = D._turns(spark, sf_dir).select(F.col("conv_id").alias("query_id"), F.col("turn").alias("run"), A.gate_decision(_replies(F.col("conv_id") + F.col("turn"))).alias("decision"), (F.col("turn") * 10).cast("double").alias("latency_ms"), (F.col("turn") % 2).cast("int").alias("retries"))
    return E.gate_repetition(runs)


def question_jobs(spark, sf_dir):
    """Moves of question jobs that are not legal, by kind."""
    names = F.create_map(*[F.lit(x) for p in (("signup", "pending"), ("view", "planning"), ("click", "retrieving"), ("purchase", "generating"), ("error", "failed")) for x in p])
    states = table(spark, sf_dir, "events").select("user_id", "event_id", names[F.col("event_type")].alias("state"))
    moves = spark.createDataFrame(L.QUESTION_MOVES, "from_state string, to_state string")
    return I.illegal_moves(states, moves, "user_id", "event_id", "state").groupBy("_from", "state").agg(F.count("*").alias("n")).withColumnRenamed("_from", "from_state")


def eval_runner(spark, sf_dir):
    """Means of a gold set of dense queries, of which every third expects nothing (at a score of 0.45, itself left out)."""
    hits, totals = search._judged(spark, sf_dir)
    m = E.ranked_metrics(hits, totals.select("query_id", "n"), 5)
    kept = search._dense(spark, sf_dir, min_score=0.45).where("query_id <> id").groupBy("query_id").agg(F.count("*").alias("retrieved"))
    gold = totals.select("query_id", (F.floor(F.col("query_id") / 50) % 3 == 0).alias("abstain"))
    return E.run_metrics(m.join(kept, "query_id", "left"), gold)


def model_sweep(spark, sf_dir):
    """Two models and two budgets over dense candidates; queries divisible by 100 are not reranked."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = search._dense(spark, sf_dir).join(points.select(F.col("vec_id").alias("id"), F.col("label").alias("_a")), "id").join(points.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_b")), "query_id")
    ranked = stored(hits.select("query_id", "id", "rank", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("relevant")), "ranked")  # read three times
    models = ranked.select("query_id", "id", F.explode(F.array(F.struct(F.lit("far").alias("model"), F.col("rank").cast("double").alias("score")), F.struct(F.lit("mod").alias("model"), (F.col("id") % 7).cast("double").alias("score")))).alias("m")).select("query_id", "id", "m.*")
    totals = search._totals(spark, sf_dir).select("query_id", "n")
    out = E.sweep(ranked, models, [5, 10], totals, 5, ranked.where("query_id % 100 <> 0").select("query_id").distinct())
    return out.groupBy("model", "candidates").agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 5).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


def representation_gate(spark, sf_dir):
    """Which way to represent line items gains the most on one measure without losing on another."""
    kind = F.element_at(F.array(*map(F.lit, "abcd")), (F.col("l_orderkey") % 4 + 1).cast("int"))
    r = table(spark, sf_dir, "lineitem").groupBy(kind.alias("representation")).agg((F.avg("l_quantity") / 50).alias("ndcg_new"), F.avg("l_discount").alias("ndcg_old"))
    r = r.withColumn("ndcg_new", F.col("ndcg_new") + F.when(F.col("representation") == "a", 0.0).when(F.col("representation") == "c", 0.03).otherwise(0.02))
    return E.representation_gate(r).select("representation", F.round("ndcg_new", 6).alias("ndcg_new"), F.round("ndcg_old", 6).alias("ndcg_old"))


def candidate_artifact(spark, sf_dir):
    """The first 100 fused candidates of every query with content digests, as the artifact keeps them."""
    fused = R.graph_fuse(search._dense(spark, sf_dir, 100), R.graph_search(*D._graph_sides(spark, sf_dir), 100), 100)
    docs = D._docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return R.with_content(fused, docs).select("query_id", "id", "rank", F.sha2("content", 256).alias("content_sha256"))


def embed_batches(spark, sf_dir):
    """Vectors of documents by an encoder that takes batches: lengths and letters of the texts."""
    encode = lambda texts: [[float(len(t)), float(t.count("a")), float(t.count(" "))] for t in texts]
    v = O.embed(D._docs(spark, sf_dir), "text", encode, 50)
    return v.select("doc_id", *[F.get("vector", F.lit(k)).cast("double").alias(f"v{k}") for k in range(3)])


QUERIES = {f.__name__: f for f in (document_entities, keyword_fragments, keyword_chunks, concept_levels, concepts_named, relates_to, summary_topics, recognised_entities, sparse_with_content, dense_with_content, graph_with_content, graph_fusion_rule, query_checks, question_terms, gate_attempts, gate_medians, question_jobs, eval_runner, model_sweep, representation_gate, candidate_artifact, embed_batches)}

_STORY = """st AS (SELECT doc_id, source, lang, CASE WHEN doc_id % 4 = 0 THEN 'Anton' || (doc_id % 40) || ' Holding was founded by ' || CASE WHEN doc_id % 8 = 0 THEN 'Rick Rubin' ELSE 'Atatürk' END || CASE WHEN doc_id % 12 = 0 THEN ' in New York. ' ELSE ' at Ankara. ' END ELSE '' END || coalesce(text, '') AS text FROM documents)"""
_FOUND = _STORY + ", " + _MENTIONS.split("),\n", 1)[1].replace("FROM named", "FROM st").replace("chunk_id, unnest", "doc_id AS chunk_id, unnest").replace("SELECT chunk_id, '", "SELECT doc_id, '")
_FIRST2 = "concat_ws(' ', t[1], t[2])"
_TOPICS = """tp AS (SELECT DISTINCT name FROM (SELECT concat_ws(' ', t[1], t[2]) AS name FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM conversations WHERE turn = 0) UNION ALL SELECT n_name FROM nation) WHERE name <> '')"""
_TURN_FS = "CASE WHEN ends_with({x}, '.') THEN {x} ELSE {x} || '.' END".format(x="list_filter(list_transform(string_split(replace(text, chr(10), ' '), '. '), lambda s: " + _trim("s") + "), lambda s: s <> '')[1]")
_REPLY = lambda n: f"list_extract(['supported', 'unsupported', 'gate_error', 'supported', 'gate_error', 'gate_error'], CAST(({n}) % 6 + 1 AS BIGINT))"
_C0, _C1 = "CASE WHEN id % 2 = 0 AND text <> '' THEN text", "WHEN id % 5 > 0 AND text IS NOT NULL THEN 'stored ' || text END"
_METRIC = """round(coalesce(hit / n::DOUBLE, 0), 6) AS recall, round(coalesce(hit / 5.0::DOUBLE, 0), 6) AS precision, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
 round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 0), 6) AS ndcg"""
ORACLE = {
    "document_entities": f"WITH {_FOUND} SELECT type || ':' || lower(text) AS entity_id, type, arg_min(text, (chunk_id, text)) AS name, count(*) AS mentions, round(least(1.0::DOUBLE, 0.8::DOUBLE + 0.1::DOUBLE * (count(*) - 1)), 6) AS score FROM m GROUP BY 1, 2",
    "keyword_fragments": f"""WITH {_FOUND}, {_KW.replace('FROM documents', 'FROM st').replace('SELECT source, unnest', 'SELECT source, doc_id, unnest').replace('kw AS (SELECT source, value', 'kw AS (SELECT source, doc_id, value')},
fr AS (SELECT DISTINCT source, value FROM (SELECT source, unnest({_words('lower(m.text)')}) AS value FROM m JOIN st ON doc_id = chunk_id) WHERE strlen(value) >= 3),
c AS (SELECT source, value, count(*) AS frequency, count(DISTINCT doc_id) AS chunks FROM kw WHERE NOT EXISTS (SELECT 1 FROM fr WHERE fr.source = kw.source AND fr.value = kw.value) GROUP BY 1, 2)
SELECT source, value, frequency, chunks, CAST(row_number() OVER w AS INTEGER) AS rank, round(frequency / max(frequency) OVER (PARTITION BY source)::DOUBLE, 6) AS score FROM c WINDOW w AS (PARTITION BY source ORDER BY frequency DESC, value) QUALIFY row_number() OVER w <= 15""",
    "keyword_chunks": f"""WITH {_KW.replace('SELECT source, unnest', 'SELECT source, doc_id, unnest').replace('kw AS (SELECT source, value', 'kw AS (SELECT source, doc_id, value')}, top AS (SELECT source, value FROM kw GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, value) <= 15)
SELECT kw.source, kw.value, count(DISTINCT doc_id) AS texts, count(*) AS uses, min(doc_id) AS first_text FROM kw JOIN top ON top.source IS NOT DISTINCT FROM kw.source AND top.value = kw.value GROUP BY 1, 2""",
    "concept_levels": f"""WITH h AS ({' UNION ALL '.join(f"SELECT unnest(regexp_extract_all(html, '(?i)<h{k}[^>]*>([^<]*)</h{k}>', 1)) AS h, {k} AS l FROM pages" for k in (1, 2, 3))}),
ph AS (SELECT DISTINCT {_FIRST2} AS name, CASE WHEN doc_id % 2 = 0 THEN 0.8::DOUBLE ELSE 0.7::DOUBLE END AS score FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents)),
fr AS (SELECT DISTINCT {_FIRST2} AS v FROM (SELECT regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents WHERE doc_id % 6 = 0)),
a AS (SELECT {_trim('h')} AS name, CASE l WHEN 1 THEN 0.98::DOUBLE WHEN 2 THEN 0.94::DOUBLE ELSE 0.90::DOUBLE END AS score, 0 AS p FROM h WHERE {_trim('h')} <> ''
 UNION ALL SELECT name, score, 1 FROM ph WHERE score >= 0.75 AND length(name) > 3 AND contains(name, ' ') AND name NOT IN (SELECT v FROM fr)),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY p, score DESC, name) = 1)
SELECT 'concept:' || regexp_replace(replace(lower({_trim('name')}), ' ', '-'), '[^a-z0-9-]', '', 'g') AS concept_id, name, score FROM b""",
    "concepts_named": f"WITH {_TOPICS} SELECT name, count(*) AS texts, min(doc_id) AS first_text FROM tp JOIN documents ON contains(lower(text), lower(name)) GROUP BY 1",
    "relates_to": f"""WITH {_FOUND}, {_TOPICS}, at AS (SELECT DISTINCT doc_id, 'concept:' || regexp_replace(replace(lower({_trim('name')}), ' ', '-'), '[^a-z0-9-]', '', 'g') AS c FROM tp JOIN st ON contains(lower(text), lower(name)))
SELECT type || ':' || lower(text) AS subject, 'relates_to' AS predicate, c AS object, 0.8::DOUBLE AS confidence, min(chunk_id) AS chunk_id FROM m JOIN at ON doc_id = chunk_id GROUP BY 1, 3""".replace(", at AS", ", att AS").replace("JOIN at ON", "JOIN att ON"),
    "summary_topics": f"""WITH s AS (SELECT conv_id, string_agg(s, ' ' ORDER BY n) AS summary FROM (SELECT conv_id, s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM (SELECT conv_id, turn, {_TURN_FS} AS s FROM conversations) WHERE s IS NOT NULL) WHERE n <= 3 GROUP BY 1),
t AS (SELECT conv_id, regexp_extract_all(lower(text), '[a-z0-9]+')[1] AS name, 1.0::DOUBLE / (turn + 1) AS score FROM conversations WHERE conv_id % 4 > 0),
k AS (SELECT conv_id, string_agg(name, ', ' ORDER BY n) AS names FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, name) AS n FROM t WHERE name IS NOT NULL) WHERE n <= 3 GROUP BY 1),
j AS (SELECT coalesce(s.conv_id, k.conv_id) AS conv_id, concat_ws(' ', nullif(summary, ''), 'Key Topics: ' || names || '.') AS summary FROM s FULL JOIN k ON k.conv_id = s.conv_id) SELECT conv_id, summary FROM j WHERE summary <> ''""",
    "recognised_entities": f"""WITH {_MENTIONS}, g AS (SELECT chunk_id FROM named WHERE chunk_id % 3 = 0 AND contains(text, 'Rubin') AND chunk_id % 5 > 0)
SELECT chunk_id, 'Frederick Rubin' AS text, 'person' AS type, 0.97::DOUBLE AS confidence FROM g UNION ALL SELECT chunk_id, text, type, confidence FROM m WHERE chunk_id NOT IN (SELECT chunk_id FROM g)""",
    "sparse_with_content": f"WITH {_BM25} SELECT query_id, id, rank, sha256({_C0} {_C1}) AS content_sha256 FROM bm LEFT JOIN documents ON doc_id = id",
    "dense_with_content": f"WITH {_DENSE} SELECT query_id, id, rank, sha256({_C0} {_C1}) AS content_sha256 FROM dn LEFT JOIN documents ON doc_id = id",
    "graph_fusion_rule": f"""WITH {_GRAPH}, {_DENSE}, g AS (SELECT * FROM gr WHERE query_id % 100 = 0), f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM dn WHERE query_id IN (SELECT query_id FROM g) UNION ALL SELECT query_id, id, rank FROM g) GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10
UNION ALL SELECT query_id, id, score, rank FROM dn WHERE query_id NOT IN (SELECT query_id FROM g)""",
    "query_checks": """WITH q AS (SELECT conv_id, turn, conv_id + turn AS n, text FROM conversations), p AS (SELECT conv_id, turn, unnest(list_filter([CASE WHEN n % 5 = 0 OR text = '' THEN 'empty query' END, CASE WHEN n % 3 < 1 THEN 'invalid page number ' || (n % 3) END,
 CASE WHEN turn < 1 THEN 'invalid page number ' || turn END, CASE WHEN n % 4 = 0 THEN 'unsupported content type video' END], lambda v: v IS NOT NULL)) AS problem FROM q)
SELECT conv_id || '-' || turn AS query_id, string_agg(problem, '; ' ORDER BY problem) AS problems FROM p GROUP BY 1""",
    "question_terms": f"""SELECT conv_id, turn, array_to_string(list_filter(list_transform({_words(_trim("'?What''s ' || text || '.\"'"))}, lambda w: regexp_replace(w, '^[?!.,"'']+|[?!.,"'']+$', '', 'g')), lambda w: strlen(w) > 3), ',') AS terms FROM conversations""",
    "gate_attempts": f"SELECT conv_id, turn, coalesce(nullif({_REPLY('conv_id + turn')}, 'gate_error'), {_REPLY('(conv_id + turn) * 5 + turn')}) AS decision FROM conversations",
    "gate_medians": f"""WITH r AS (SELECT conv_id, turn, {_REPLY('conv_id + turn')} AS d FROM conversations), k AS (SELECT conv_id, list_sort(list(CASE d WHEN 'supported' THEN 0 WHEN 'unsupported' THEN 1 ELSE 2 END)) AS l, avg(turn * 10) AS a FROM r GROUP BY 1),
m AS (SELECT conv_id, a, list_extract(['supported', 'unsupported', 'gate_error'], CAST(l[(len(l) - 1) // 2 + 1] + 1 AS BIGINT)) AS d FROM k)
SELECT m.conv_id AS query_id, m.d AS decision, round(a, 3) AS latency_ms, CAST(min(turn) % 2 AS INTEGER) AS retries FROM m JOIN r ON r.conv_id = m.conv_id AND r.d = m.d GROUP BY 1, 2, 3""",
    "question_jobs": f"""WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'planning' WHEN 'click' THEN 'retrieving' WHEN 'purchase' THEN 'generating' WHEN 'error' THEN 'failed' END AS state FROM events),
t AS (SELECT lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state, state FROM s)
SELECT from_state, state, count(*) AS n FROM t WHERE from_state IS NOT NULL AND from_state <> state AND (from_state, state) NOT IN (SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in L.QUESTION_MOVES)})) GROUP BY 1, 2""",
    "eval_runner": f"""{_METRICS}, k AS (SELECT query_id, count(*) AS c FROM dn WHERE score >= 0.45 AND query_id <> id GROUP BY 1), g AS (SELECT totals.query_id, (totals.query_id // 50) % 3 = 0 AS abstain, recall, precision, mrr, ndcg, coalesce(c, 0) AS c FROM totals LEFT JOIN m USING (query_id) LEFT JOIN k ON k.query_id = totals.query_id)
SELECT count(*) AS queries, CAST(sum(CAST(abstain AS INTEGER)) AS BIGINT) AS abstention_queries, {', '.join(f"round(coalesce(avg(CASE WHEN NOT abstain THEN coalesce({c}, 0) END), 0), 6) AS {c}" for c in ('recall', 'precision', 'mrr', 'ndcg'))}, round(avg(CASE WHEN abstain THEN CASE WHEN c = 0 THEN 1.0::DOUBLE ELSE 0 END END), 6) AS no_evidence_precision FROM g""",
    "model_sweep": f"""{_METRICS}, jd AS (SELECT dn.query_id, dn.id, dn.rank, coalesce(a.label = b.label, false) AS relevant FROM dn JOIN embeddings a ON a.vec_id = dn.id JOIN embeddings b ON b.vec_id = dn.query_id),
sc AS (SELECT *, 'far' AS model, rank::DOUBLE AS s FROM jd UNION ALL SELECT *, 'mod', (id % 7)::DOUBLE FROM jd), bu AS (SELECT *, CASE WHEN query_id % 100 = 0 THEN -rank ELSE s END AS o FROM sc JOIN (SELECT unnest([5, 10]) AS candidates) ON rank <= candidates),
rk AS (SELECT *, row_number() OVER (PARTITION BY model, candidates, query_id ORDER BY o DESC, id) AS r FROM bu),
fo AS (SELECT model, candidates, query_id, sum(CASE WHEN r <= 5 THEN 1 ELSE 0 END) AS hit, min(r) AS first, sum(CASE WHEN r <= 5 THEN 1 / log2(r + 1.0::DOUBLE) ELSE 0 END) AS dcg FROM rk WHERE relevant GROUP BY 1, 2, 3),
al AS (SELECT DISTINCT model, candidates, query_id FROM rk), mm AS (SELECT al.model, al.candidates, al.query_id, {_METRIC} FROM al JOIN totals USING (query_id) LEFT JOIN fo USING (model, candidates, query_id))
SELECT model, candidates, count(*) AS queries, round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision, round(avg(mrr), 5) AS mrr, round(avg(ndcg), 5) AS ndcg FROM mm GROUP BY 1, 2""",
    "representation_gate": """WITH r AS (SELECT list_extract(['a', 'b', 'c', 'd'], CAST(l_orderkey % 4 + 1 AS BIGINT)) AS representation, avg(l_quantity) / 50 AS n, avg(l_discount) AS o FROM lineitem GROUP BY 1), s AS (SELECT representation, n + CASE representation WHEN 'a' THEN 0 WHEN 'c' THEN 0.03 ELSE 0.02 END AS n, o FROM r)
SELECT s.representation, round(s.n, 6) AS ndcg_new, round(s.o, 6) AS ndcg_old FROM s, s b WHERE b.representation = 'a' AND s.representation <> 'a' AND (s.n - b.n) * 100 >= 1 AND CASE WHEN b.o > 0 THEN (b.o - s.o) / b.o ELSE 0 END <= 0.05 ORDER BY s.n DESC, s.representation LIMIT 1""",
    "embed_batches": "SELECT doc_id, length(coalesce(text, ''))::DOUBLE AS v0, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), 'a', '')))::DOUBLE AS v1, (length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')))::DOUBLE AS v2 FROM documents",
    "graph_with_content": f"WITH {_GRAPH} SELECT query_id, id, rank, CASE WHEN id % 3 = 0 AND content <> '' THEN content WHEN id % 2 = 0 THEN 'stored' END AS content FROM gr LEFT JOIN (SELECT o_orderkey, o_orderstatus AS content FROM orders) ON o_orderkey = id",
    "candidate_artifact": f"""WITH {_GRAPH.replace('<= 10)', '<= 100)')}, {_DENSE.replace(f'<= {search.K})', '<= 100)')}, f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM dn WHERE query_id IN (SELECT query_id FROM gr) UNION ALL SELECT query_id, id, rank FROM gr) GROUP BY 1, 2),
u AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 100 UNION ALL SELECT query_id, id, rank FROM dn WHERE query_id NOT IN (SELECT query_id FROM gr))
SELECT query_id, id, CAST(rank AS INTEGER) AS rank, sha256(CASE WHEN text <> '' THEN text END) AS content_sha256 FROM u LEFT JOIN documents ON doc_id = id""",
}
