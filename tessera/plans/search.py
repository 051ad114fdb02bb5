"""Registered queries of retrieval and evaluation. Searches take as queries every row whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import evaluation as E
from tessera.operators import retrieval as R
from tessera.sources.storage import stored
from tessera.sources.tables import table

K = 10


def _sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    terms = stored(R.term_counts(docs, "doc_id", F.col("text")), "terms")  # texts are cut into tokens once
    df = R.document_frequencies(terms)
    stats = R.stats_of_terms(terms)
    return terms, df, stats, R.postings(terms, df, stats)


def corpus_stats(spark, sf_dir):
    _, df, stats, _ = _sparse(spark, sf_dir)
    return stats.crossJoin(df.agg(F.count("*").alias("vocabulary"))).select("total_docs", F.round("avg_length", 6).alias("avg_length"), "vocabulary")


def term_df_topk(spark, sf_dir):
    _, df, _, _ = _sparse(spark, sf_dir)
    return df.orderBy(F.col("df").desc(), "term").limit(100)


def posting_weights(spark, sf_dir):
    *_, index = _sparse(spark, sf_dir)
    return index.groupBy("id").agg(F.count("*").alias("terms"), F.round(F.sum(F.col("weight").cast("double")), 4).alias("total_weight"))


def _bm25(spark, sf_dir, k=K):
    return R.sparse_text_search(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), F.col("doc_id") % 50 == 0, k, near=F.col("lang"))


def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).select("query_id", "id", "score", "rank")


def _dense(spark, sf_dir, k=K, min_score=0.0):
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = points.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return R.dense_search(queries, points, k, min_score)


def dense_topk_cosine(spark, sf_dir):
    return _dense(spark, sf_dir).select("query_id", "id", "score", "rank")


def dense_min_score(spark, sf_dir):
    return _dense(spark, sf_dir, min_score=0.3).select("query_id", "id", "score", "rank")


def rrf_hybrid(spark, sf_dir):
    return R.fuse([(_dense(spark, sf_dir), 1.0), (_bm25(spark, sf_dir), 1.0)], K).select("query_id", "id", "score", "rank")


def rrf_dense_biased(spark, sf_dir):
    return R.fuse([(_dense(spark, sf_dir), 1.0), (_bm25(spark, sf_dir), 0.5)], K).select("query_id", "id", "score", "rank")


def rrf_sparse_cap(spark, sf_dir):
    return R.fuse([(_dense(spark, sf_dir), 1.0), (_bm25(spark, sf_dir).where("rank <= 3"), 1.0)], K).select("query_id", "id", "score", "rank")


def merge_ranked_lists(spark, sf_dir):
    lists = _bm25(spark, sf_dir).withColumn("list_no", F.lit(0)).unionByName(_dense(spark, sf_dir).withColumn("list_no", F.lit(1)))
    return R.merge_ranked(lists, K)


def metadata_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return R.metadata_filter(docs, within={"lang": ["en", "de"]}, prefix={"source": "src1"}, equal={"text": None}).select("doc_id", "lang", "source")


def metadata_filter_fields(spark, sf_dir):
    """All fields of a filter at once: workspace and space, documents, kinds, languages, a path's prefix, pages and time."""
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("paragraph", "table", "code"))), (i % 3 + 1).cast("int"))
    points = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "n_chars", F.concat_ws(" > ", "source", "lang").alias("section_path"), kind.alias("content_type"), F.array((i % 5).cast("int"), (i % 7).cast("int")).alias("page_numbers"),
        F.when(i % 11 > 0, "main").otherwise("other").alias("workspace"), F.when(i % 13 > 0, "open").otherwise("closed").alias("space"), (i % 4).alias("document_group"),
    )
    kept = R.metadata_filter(
        points, equal={"workspace": "main", "space": "open"}, within={"document_group": [0, 1, 3], "content_type": ["table", "paragraph"], "lang": ["en", "de", "fr"]},
        prefix={"section_path": "src1"}, overlap={"page_numbers": [1, 2, 3]}, after={"n_chars": 100},
    )
    return kept.select("doc_id", "section_path", "content_type")


def rerank_structure(spark, sf_dir):
    meta = table(spark, sf_dir, "documents")
    side = lambda name, c: meta.select(F.col("doc_id").alias(name), c.alias(f"_{name}"))
    heading = F.concat(F.col("source"), F.lit(" > "), F.col("lang"), F.lit("-texts of "), F.col("source"))
    hits = _bm25(spark, sf_dir).join(side("id", heading), "id").join(side("query_id", F.concat(F.lit("what does the "), F.col("lang"), F.lit(" text say about "), F.col("source"), F.lit("?"))), "query_id")
    return R.structure_rerank(hits, "_query_id", "_id", 0.5, 5).select("query_id", "id", "score", "rank")


def _judged(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    hits = _dense(spark, sf_dir).join(points.select(F.col("vec_id").alias("id"), F.col("label").alias("_a")), "id").join(points.select(F.col("vec_id").alias("query_id"), F.col("label").alias("_b")), "query_id")
    return hits.select("query_id", "rank", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("relevant")), _totals(spark, sf_dir)


def _totals(spark, sf_dir) -> DataFrame:
    """(query_id, label, n): each query with the number of points of its label."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return points.where("vec_id % 50 = 0").join(points.groupBy("label").agg(F.count("*").alias("n")), "label").select(F.col("vec_id").alias("query_id"), "label", "n")


def ir_metrics(spark, sf_dir):
    hits, totals = _judged(spark, sf_dir)
    return E.ranked_metrics(hits, totals.select("query_id", "n"), 5)


def ir_metrics_rollup(spark, sf_dir):
    hits, totals = _judged(spark, sf_dir)
    m = E.ranked_metrics(hits, totals.select("query_id", "n"), 5).join(totals.select("query_id", "label"), "query_id")
    return m.rollup("label").agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 5).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


def no_evidence(spark, sf_dir):
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    hits = _dense(spark, sf_dir, min_score=0.45).where("query_id <> id")
    return E.no_evidence_precision(queries, hits).select(F.round("no_evidence_precision", 6).alias("no_evidence_precision"))


def abstention_signals(spark, sf_dir):
    """Coverage of a query's rare tokens (df of 3 or less) by the texts retrieved for it, and the ratio of the best scores."""
    blocks = R.text_blocks(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), F.col("doc_id") % 50 == 0, near=F.col("lang"))
    asked = R.weighed_queries(blocks)
    hits = stored(R.asked_search(blocks, asked, K), "hits").where("query_id <> id")
    scores = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("s"))
    gap = F.when(F.size("s") == 1, 1.0).when(F.get("s", F.lit(0))["score"] > 0, F.try_divide(F.get("s", F.lit(0))["score"], F.get("s", F.lit(1))["score"]))
    rare = stored(asked.where("df <= 3").select(F.col("id").alias("query_id"), "term", "tf"), "rare")
    there = R.block_postings(blocks, A.bitmap(rare, "term"), 3)  # a term of three postings has no more in a block
    present = rare.select("query_id", "term").join(there, "term").join(hits.select("query_id", "id"), ["query_id", "id"], "left_semi").select("query_id", "term").distinct().withColumn("hit", F.lit(1))
    cover = rare.join(present, ["query_id", "term"], "left").groupBy("query_id").agg((F.sum(F.col("tf") * F.coalesce("hit", F.lit(0))) / F.sum("tf")).alias("c"))
    return scores.join(cover, "query_id", "left").select("query_id", F.round(F.coalesce("c", F.lit(1.0)), 6).alias("lexical_coverage"), F.round(F.coalesce(gap, F.lit(0.0)), 5).alias("score_gap"))


def percentile_ceil(spark, sf_dir):
    p = [0.5, 0.95, 0.99]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY value)").alias(f"p{int(x * 100)}") for x in p])


def lower_median(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("user_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median_value"), F.count("*").alias("n"))


def kill_gate(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    metrics = [F.avg("l_discount").alias("ndcg"), F.avg("l_tax").alias("mrr"), (F.avg("l_quantity") / 50).alias("verified")]
    combos = lines.groupBy(F.concat_ws("-", "l_returnflag", "l_linestatus").alias("model"), F.col("l_linenumber").cast("int").alias("candidates")).agg(*metrics, F.max("l_quantity").alias("p95_ms"), F.count("*").cast("double").alias("rss"))
    base = lines.agg(*metrics).select((F.col("ndcg") - 0.011).alias("ndcg"), "mrr", "verified")
    return E.kill_gate(combos.withColumn("aligned", F.lit(True)), base, 50, 1e18).select("model", "candidates", F.round("ndcg", 6).alias("ndcg"))


def bootstrap_ci(spark, sf_dir):
    hits, totals = _judged(spark, sf_dir)
    m = E.ranked_metrics(hits, totals.select("query_id", "n"), 5)
    return E.bootstrap_interval(m.select("query_id", (F.col("ndcg") - F.col("recall")).alias("delta")))


QUERIES = {f.__name__: f for f in (corpus_stats, term_df_topk, posting_weights, bm25_topk, dense_topk_cosine, dense_min_score, rrf_hybrid, rrf_dense_biased, rrf_sparse_cap, merge_ranked_lists, metadata_filter, metadata_filter_fields, rerank_structure, ir_metrics, ir_metrics_rollup, no_evidence, abstention_signals, percentile_ceil, lower_median, kill_gate, bootstrap_ci)}

_TERMS = """
tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
terms AS (SELECT id, length, term, count(*) AS tf FROM (SELECT id, len(t) AS length, unnest(t) AS term FROM tok) GROUP BY ALL),
stats AS (SELECT count(*) AS total, avg(len(t)) AS mean FROM tok WHERE len(t) > 0),
df AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
post AS (SELECT id, term, CAST(ln(1 + (total - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * length / mean)) AS FLOAT) AS w
         FROM terms JOIN df USING (term) CROSS JOIN stats)"""
_BM25 = _TERMS + f""",
bm_all AS (SELECT q.id AS query_id, d.id, round(sum(CAST(q.w AS DOUBLE) * CAST(d.w AS DOUBLE)), 6) AS score
           FROM post q JOIN post d USING (term) WHERE q.id % 50 = 0 GROUP BY 1, 2),
bm AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm_all
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {K})"""
_DENSE = f"""
dn_all AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score
           FROM embeddings q, embeddings d WHERE q.vec_id % 50 = 0),
dn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM dn_all
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {K})"""


def _fused(dense: str, sparse: str, w: float) -> str:
    return f"""WITH {_BM25}, {_DENSE},
f AS (SELECT query_id, id, round(sum(p), 9) AS score FROM (
      SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS p FROM {dense} UNION ALL
      SELECT query_id, id, {w}::DOUBLE / (60 + rank) AS p FROM {sparse}) GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM f
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= {K}"""


_METRICS = f"""WITH {_DENSE},
judged AS (SELECT dn.query_id, rank, coalesce(a.label = b.label, false) AS relevant FROM dn JOIN embeddings a ON a.vec_id = dn.id JOIN embeddings b ON b.vec_id = dn.query_id),
totals AS (SELECT vec_id AS query_id, label, n FROM embeddings JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label) WHERE vec_id % 50 = 0),
found AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS hit, min(rank) AS first, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS dcg
          FROM judged WHERE relevant GROUP BY 1),
m AS (SELECT query_id, label, round(coalesce(hit / n::DOUBLE, 0), 6) AS recall, round(coalesce(hit / 5.0::DOUBLE, 0), 6) AS precision,
             round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr,
             round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 0), 6) AS ndcg
      FROM totals LEFT JOIN found USING (query_id))"""

_HEAD = "SELECT query_id, id, score, rank FROM"
ORACLE = {
    "corpus_stats": f"WITH {_TERMS} SELECT total AS total_docs, round(mean, 6) AS avg_length, (SELECT count(*) FROM df) AS vocabulary FROM stats",
    "term_df_topk": f"WITH {_TERMS} SELECT term, df FROM df ORDER BY df DESC, term LIMIT 100",
    "posting_weights": f"WITH {_TERMS} SELECT id, count(*) AS terms, round(sum(CAST(w AS DOUBLE)), 4) AS total_weight FROM post GROUP BY id",
    "bm25_topk": f"WITH {_BM25} {_HEAD} bm",
    "dense_topk_cosine": f"WITH {_DENSE} {_HEAD} dn",
    "dense_min_score": f"WITH {_DENSE} {_HEAD} dn WHERE score >= 0.3",
    "rrf_hybrid": _fused("dn", "bm", 1.0),
    "rrf_dense_biased": _fused("dn", "bm", 0.5),
    "rrf_sparse_cap": _fused("dn", "(SELECT * FROM bm WHERE rank <= 3)", 1.0),
    "merge_ranked_lists": f"""WITH {_BM25}, {_DENSE},
u AS (SELECT query_id, id, rank, 0 AS l FROM bm UNION ALL SELECT query_id, id, rank, 1 FROM dn),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY rank, l) AS n FROM u)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, l, id) AS INTEGER) AS place FROM o WHERE n = 1
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, l, id) <= {K}""",
    "metadata_filter": "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source LIKE 'src1%'",
    "metadata_filter_fields": """SELECT doc_id, concat_ws(' > ', source, lang) AS section_path, list_extract(['paragraph', 'table', 'code'], CAST(doc_id % 3 + 1 AS BIGINT)) AS content_type FROM documents
WHERE doc_id % 11 > 0 AND doc_id % 13 > 0 AND doc_id % 4 IN (0, 1, 3) AND doc_id % 3 < 2 AND lang IN ('en', 'de', 'fr') AND concat_ws(' > ', source, lang) LIKE 'src1%' AND (doc_id % 5 IN (1, 2, 3) OR doc_id % 7 IN (1, 2, 3)) AND n_chars >= 100""",
    "rerank_structure": f"""WITH {_BM25},
s AS (SELECT query_id, bm.id, round(bm.score * (1 + 0.5 * ((CASE WHEN q.lang = d.lang THEN 1 ELSE 0 END) + (CASE WHEN q.source = d.source THEN 1 ELSE 0 END)) / 3.0::DOUBLE), 5) AS score
      FROM bm JOIN documents d ON d.doc_id = bm.id JOIN documents q ON q.doc_id = bm.query_id)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s""",
    "ir_metrics": f"{_METRICS} SELECT query_id, recall, precision, mrr, ndcg FROM m",
    "ir_metrics_rollup": f"{_METRICS} SELECT label, count(*) AS queries, round(avg(recall), 5) AS recall, round(avg(precision), 5) AS precision, round(avg(mrr), 5) AS mrr, round(avg(ndcg), 5) AS ndcg FROM m GROUP BY ROLLUP (label)",
    "no_evidence": f"""WITH {_DENSE}, h AS (SELECT DISTINCT query_id FROM dn WHERE score >= 0.45 AND query_id <> id)
SELECT round(avg(CASE WHEN h.query_id IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS no_evidence_precision FROM (SELECT vec_id FROM embeddings WHERE vec_id % 50 = 0) q LEFT JOIN h ON h.query_id = q.vec_id""",
    "abstention_signals": f"""WITH {_BM25}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, count(*) OVER (PARTITION BY query_id) AS c FROM bm WHERE query_id <> id),
g AS (SELECT query_id, max(c) AS c, max(CASE WHEN n = 1 THEN score END) AS a, max(CASE WHEN n = 2 THEN score END) AS b FROM h GROUP BY 1),
rare AS (SELECT id AS query_id, term, tf FROM terms JOIN df USING (term) WHERE id % 50 = 0 AND df <= 3),
present AS (SELECT DISTINCT query_id, term FROM h JOIN terms USING (id)),
cover AS (SELECT rare.query_id, sum(CASE WHEN present.term IS NOT NULL THEN tf ELSE 0 END) / sum(tf)::DOUBLE AS v FROM rare LEFT JOIN present ON rare.query_id = present.query_id AND rare.term = present.term GROUP BY 1)
SELECT query_id, round(coalesce(v, 1), 6) AS lexical_coverage, round(CASE WHEN c = 1 THEN 1 WHEN a > 0 THEN coalesce(a / b, 0) ELSE 0 END, 5) AS score_gap FROM g LEFT JOIN cover USING (query_id)""",
    "percentile_ceil": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1",
    "lower_median": "SELECT user_id, quantile_disc(value, 0.5) AS median_value, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1",
    "kill_gate": """WITH c AS (SELECT l_returnflag || '-' || l_linestatus AS model, CAST(l_linenumber AS INTEGER) AS candidates, avg(l_discount) AS ndcg, avg(l_tax) AS mrr, avg(l_quantity) / 50 AS verified FROM lineitem GROUP BY 1, 2),
b AS (SELECT avg(l_discount) - 0.011 AS n, avg(l_tax) AS m, avg(l_quantity) / 50 AS v FROM lineitem),
a AS (SELECT c.* FROM c, b WHERE (ndcg - n) * 100 >= 1 AND (mrr - m) * 100 >= -0.5 AND (verified - v) * 100 >= -1)
SELECT model, candidates, round(ndcg, 6) AS ndcg FROM a WHERE ndcg >= (SELECT max(ndcg) FROM a) * 0.95 ORDER BY candidates, model LIMIT 1""",
}
