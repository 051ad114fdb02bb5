"""Hand-computed values and invariants of the operators."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import answers as A
from tessera.operators import enrichment as N
from tessera.operators import evaluation as E
from tessera.operators import indexing as I
from tessera.operators import retrieval as R
from tessera.operators import structure as S
from tessera.sources import tables as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("v")).first().v


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, X.token_estimate(t), t="  ") == 0
    assert one(spark, X.token_estimate(t), t="one two three") == 4
    assert one(spark, X.normal_markdown(t), t="a  \r\n\n\n\n\nb\t\n ") == "a\n\nb"
    assert one(spark, X.slug(t), t=" Ça va, bien? ") == "ca-va-bien" and one(spark, X.slug(t), t="???") == "section"
    assert one(spark, X.concept_slug(t), t=" Two Words! ") == "two-words"
    assert one(spark, X.normal_heading(t), t="What’s  Next: Now?") == "whats next now"
    assert one(spark, X.language(t), t="Bu bir deneme") == "tr" and one(spark, X.language(t), t="plain words") == "en"
    assert one(spark, X.first_sentence(t), t="First one. Second.") == "First one." and one(spark, X.first_sentence(t), t=" . ") is None
    assert one(spark, X.paragraph_category(t), t="WARNING: hot") == "warning"
    assert one(spark, X.is_list_item(t), t="12. item") and not one(spark, X.is_list_item(t), t="12345. item")
    assert one(spark, X.comparison(t), t="Compare A with B") == ["A", "B"] and one(spark, X.comparison(t), t="Compare a with A") is None
    assert one(spark, X.point_id(t, t, F.lit(1)), t="d")[14] == "5" and len(one(spark, X.point_id(t, t, F.lit(1)), t="d")) == 36
    assert one(spark, X.chunk_fingerprint(t, t, F.lit(1), F.array(F.lit("1"), F.lit("2")), t), t="x") == one(spark, F.sha2(F.lit("x|x|1|[1 2]|x"), 256), t="x")


def test_bm25_weight_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana"), (3, "")], "id long, t string")
    terms = R.term_counts(docs, "id", F.col("t"))
    index = R.postings(terms, R.document_frequencies(terms), R.corpus_stats(docs, F.col("t")))
    got = {(r.id, r.term): r.weight for r in index.collect()}
    idf = math.log(1 + (2 - 1 + 0.5) / 1.5)
    assert got[1, "apple"] == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)), rel=1e-6)
    assert set(got) == {(1, "apple"), (1, "banana"), (2, "banana")}


def test_dense_search_ties_zero_vectors_and_blocks(spark):
    rows = [(k, [float(k % 3), 1.0]) for k in range(40)] + [(100, [0.0, 0.0]), (101, [1.0]), (102, None)]
    points = spark.createDataFrame(rows, "id long, vector array<float>")
    queries = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, query_vector array<float>")
    a = R.dense_search(queries, points, 5).orderBy("rank").collect()
    b = R.dense_search(queries, points, 5, block_rows=7).orderBy("rank").collect()
    assert a == b and [r.id for r in a] == [0, 3, 6, 9, 12]


def test_fusion_and_merge(spark):
    s = lambda *ids: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "query_id long, id long, rank int")
    got = R.fuse([(s(5, 6), 1.0), (s(6, 7), 0.0)], 10).orderBy("rank").collect()
    assert [r.id for r in got] == [6, 5, 7] and got[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    lists = s(5, 6, 7).withColumn("list_no", F.lit(0)).unionByName(s(6, 8).withColumn("list_no", F.lit(1)))
    assert [r.id for r in R.merge_ranked(lists, 3).orderBy("place").collect()] == [5, 6, 8]


def test_metrics_by_hand(spark):
    hits = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True)], "query_id long, rank int, relevant boolean")
    totals = spark.createDataFrame([(1, 4), (2, 1), (3, 0)], "query_id long, n long")
    got = {r.query_id: r for r in E.ranked_metrics(hits, totals, 5).collect()}
    assert (got[1].recall, got[1].precision, got[1].mrr) == (0.5, 0.4, 0.5)
    assert got[1].ndcg == pytest.approx((1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3) + 0.5 + 1 / math.log2(5)), abs=1e-6)
    assert (got[2].recall, got[2].mrr) == (0, 0) and 3 not in got


def test_kill_gate_and_bootstrap(spark):
    rows = [("a", 20, 0.72, 0.7, 0.8, 100.0, 1.0, True), ("b", 50, 0.73, 0.7, 0.8, 100.0, 1.0, True), ("c", 10, 0.73, 0.7, 0.8, 9999.0, 1.0, True), ("d", 5, 0.80, 0.1, 0.8, 1.0, 1.0, True), ("e", 5, 0.80, 0.7, 0.8, 1.0, 1.0, False)]
    combos = spark.createDataFrame(rows, "model string, candidates int, ndcg double, mrr double, verified double, p95_ms double, rss double, aligned boolean")
    base = spark.createDataFrame([(0.70, 0.7, 0.8)], "ndcg double, mrr double, verified double")
    assert tuple(E.kill_gate(combos, base, 8000, 4.0).first())[:2] == ("a", 20)
    assert E.kill_gate(combos.where("model = 'd'"), base, 8000, 4.0).collect() == []
    deltas = spark.createDataFrame([(k, float(k % 5)) for k in range(200)], "query_id long, delta double")
    r = E.bootstrap_interval(deltas, 400).first()
    assert r == E.bootstrap_interval(deltas.repartition(9), 400).first() and r.low < r["mean"] == 2.0 < r.high and r.high - r.low < 0.8


def test_context_window_first_always_in_and_stop_at_overflow(spark):
    rows = [(1, 1, 10, "a b c " * 50), (1, 2, 11, "x " * 5), (1, 3, 10, "again"), (1, 4, 12, "y " * 900), (1, 5, 13, "z")]
    hits = spark.createDataFrame([(*r[:3], "doc", "sec", ["1", "2"], r[3]) for r in rows], "query_id long, rank int, id long, document string, section string, pages array<string>, content string")
    got = A.context_window(hits, 200).orderBy("ref").collect()
    assert [r.id for r in got] == [10, 11] and got[0].block.startswith("[Ref 1] Source: doc (Page [1 2], Section: sec)\n")
    assert [r.id for r in A.context_window(hits, 1).collect()] == [10]


def test_citations(spark):
    rows = [(1, "Yes [Ref 1] and [Ref 1, 2] or [Ref 2, Ref 9]."), (2, "none [1, 2]"), (3, "[Ref 2]")]
    answers = spark.createDataFrame(rows, "answer_id long, answer string")
    sources = spark.createDataFrame([(i, r) for i in (1, 2, 3) for r in (1, 2)], "answer_id long, ref int")
    got = {r.answer_id: tuple(r)[1:] for r in A.verify_citations(answers, sources).collect()}
    assert got == {1: (5, 2, 1, "unverified"), 2: (0, 0, 0, "unverified"), 3: (1, 1, 0, "verified")}
    assert one(spark, A.gate_decision(F.col("t")), t='{"decision": "supported"}') == "supported" and one(spark, A.gate_decision(F.col("t")), t="yes") == "gate_error"
    odd = {' {"decision": " Unsupported "} ': "unsupported", '{"decision": "supported", "why": 1}': "supported", '{"decision": "supported"} and more': "gate_error", '{"decision": "supported"} {}': "gate_error", '{"decision": "maybe"}': "gate_error", '["supported"]': "gate_error", "{}": "gate_error", "": "gate_error"}
    assert {t: one(spark, A.gate_decision(F.col("t")), t=t) for t in odd} == odd
    assert one(spark, A.attempted_decision(F.lit("?"), F.col("t")), t='{"decision": "supported"}') == "supported" and one(spark, A.attempted_decision(F.col("t"), F.lit("!")), t="?") == "gate_error"
    assert [one(spark, A.lower_median_decision(F.split(F.col("t"), " ")), t=t) for t in ("supported", "gate_error supported", "unsupported gate_error gate_error", "gate_error unsupported supported")] == ["supported", "supported", "gate_error", "unsupported"]


def test_diff_is_idempotent_and_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "point_id long, signature string")
    new = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "point_id long, signature string")
    assert {tuple(r) for r in I.diff_plan(old, new).collect()} == {(1, "deleted"), (2, "modified"), (3, "unchanged"), (4, "new")}
    merged = I.upsert(old, new, "point_id")
    assert {r.action for r in I.diff_plan(merged, merged).collect()} == {"unchanged"} and merged.count() == 4


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in I.reachable(edges, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    ring = spark.createDataFrame([(k, (k + 1) % 14) for k in range(14)] + [(k, 0) for k in range(14)], "src long, dst long")
    found = I.reachable(ring, spark.createDataFrame([(0,), (0,)], "node long"), 10)
    assert {tuple(r) for r in found.collect()} == {(k, k) for k in range(11)}
    assert "Join" not in found._jdf.queryExecution().toString()  # the plan does not grow with depth
    ev = spark.createDataFrame([("n", 1, 1, 0.9), ("n", 1, 2, 0.8), ("m", 2, 5, 0.9)], "node_id string, document_id long, chunk_id long, score double")
    assert sorted(map(tuple, I.merge_evidence(ev, ev.withColumn("score", F.lit(0.5))).collect())) == sorted(map(tuple, ev.collect()))
    assert {r.node_id for r in I.node_view(I.forget_document(ev, spark.createDataFrame([(2,)], "document_id long"))).collect()} == {"n"}


MARKDOWN = """intro text
# One
para a

para b
<!-- page: 3 -->
## Two
```py
# not a heading
```
| a | b |
| 1 | 2 |
- item
$$
x

y
$$
#### Deep
![pic](a.png)
# Next
tail [Smith et al., 2020]"""


def test_structure(spark):
    docs = spark.createDataFrame([(1, MARKDOWN), (2, ""), (3, "é\nx")], "id long, t string")
    rows = S.lines(docs, "id", F.col("t"))
    assert [r.start for r in rows.where("document_id = 3").orderBy("ord").collect()] == [0, 3]
    tree = {r.heading: r for r in S.sections(rows.where("line <> '# not a heading'")).collect()}
    assert tree["Deep"].section_path == "One > Two > Deep" and tree["Next"].section_path == "Next" and tree["Next"].parent_ord is None
    blocks = S.blocks(docs, "id", "t").where("document_id = 1").orderBy("block_ord").collect()
    assert [b.kind for b in blocks] == ["paragraph", "paragraph", "paragraph", "code", "table", "list", "equation", "figure", "paragraph"]
    assert all(MARKDOWN.encode()[b.start_offset : b.end_offset].decode().strip() == b.content.strip() for b in blocks)
    assert blocks[3].page == 3 and blocks[3].section_path == "One > Two"
    chunks = S.chunks(S.blocks(docs, "id", "t")).where("document_id = 1").orderBy("chunk_order").collect()
    ids = [c.chunk_id for c in chunks]
    assert len(set(ids)) == len(ids) and [c.previous_id for c in chunks[1:]] == ids[:-1] and [c.next_id for c in chunks[:-1]] == ids[1:]
    assert [c.is_parent for c in chunks if c.section_path == "One > Two"] == [True, False, False, False, False]
    assert [c.content for c in chunks if c.section_path == "One"] == ["para a\n\npara b"]


def test_greedy_groups_and_overlaps(spark):
    df = spark.createDataFrame([([100, 50, 60, 300, 10],)], "n array<bigint>")
    assert df.select(S.greedy_groups(F.col("n"), 150)).first()[0] == [1, 1, 2, 3, 4]
    a = spark.createDataFrame([(1, 0, 9000), (1, 9001, 9001), (2, 5, 6)], "d long, l_start long, l_end long")
    b = spark.createDataFrame([(1, 9000, 9001), (1, 20_000, 30_000), (2, 0, 4)], "d long, r_start long, r_end long")
    assert sorted((r.l_start, r.r_start) for r in S.overlaps(a, b, "d").collect()) == [(0, 9000), (9001, 9000)]


def test_enrichment(spark):
    docs = spark.createDataFrame([(1, "Def Jam Recordings was founded by Rick Rubin in New York"), (2, "Acme Corp at Ankara, Acme Corp"), (3, None)], "chunk_id long, text string")
    found = N.mentions(docs, "chunk_id", "text")
    assert {(r.chunk_id, r.text) for r in found.collect()} == {(1, "Def Jam Recordings"), (1, "Rick Rubin"), (1, "New York"), (2, "Acme Corp"), (2, "Ankara")}
    assert {(r.subject, r.predicate, r.object) for r in N.relations(found, docs, "chunk_id", "text").collect()} == {
        ("organization:def jam recordings", "founded_by", "person:rick rubin"), ("organization:def jam recordings", "located_in", "location:new york"), ("organization:acme corp", "located_in", "location:ankara")}
    state, skipped = N.run_passes([N.Pass("a", (), ("x",), lambda s: {"x": 1}), N.Pass("b", ("y",), ("z",), lambda s: {"z": 2})], {})
    assert state == {"x": 1} and skipped == ["b"]


def test_sources(spark, tmp_path):
    for name, data in {"a": b"%PDF-1.7 x", "c": b"no", "d": b"%PDF-1.4 /Encrypt /Standard"}.items():
        (tmp_path / name).write_bytes(data)
    assert {r.path[-1]: r.status for r in T.pdf_files(spark, str(tmp_path)).collect()} == {"a": "ok", "c": "not_pdf", "d": "encrypted"}
    raw = spark.createDataFrame([(1, '{"pages": [{"text": "t"}, {"page_number": 7, "markdown": "m"}]}', "all"), (2, "{}", "whole")], "document_id long, json_layout string, markdown string")
    assert sorted(map(tuple, T.pages_from_layout(raw).collect())) == [(1, 1, "t"), (1, 7, "m"), (2, 1, "whole")]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "gold.json").write_text('{"schema_version": "1", "queries": [{"id": "q", "intent": "concept", "query": "x", "expected_chunk_ids": ["c"]}, {"id": "q", "intent": "abstention", "query": " ", "expected_no_evidence": true}]}')
    gold = T.gold_set(spark, str(tmp_path / "g"))
    assert sorted(r.problem for r in T.gold_set_violations(gold).collect()) == ["empty query", "repeated id", "repeated id"]
    T.write_result(gold, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_dense_search_skips_cells_and_stays_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    rows = [(k, [float(x) for x in centres[k % 20] + 0.1 * rng.standard_normal(16)]) for k in range(2000)]
    rows += [(3000 + k, rows[0][1]) for k in range(700)]  # one cell of many copies
    rows += [(5000, [0.0] * 16), (5001, None), (5002, [1.0, 2.0]), (5003, [])]
    points = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = points.where("id % 50 = 0 OR id >= 5000").selectExpr("id AS query_id", "vector AS query_vector")
    for least in (0.0, 0.9):
        whole = R.dense_search(queries, points, 5, least, block_rows=10_000).collect()
        assert sorted(R.dense_search(queries, points, 5, least, block_rows=300, query_rows=40, pivots=40).collect()) == sorted(whole)
    q = queries.selectExpr("true AS is_query", "query_id AS key", "query_vector AS v")
    p = points.selectExpr("false AS is_query", "id AS key", "vector AS v")
    _, visits = R.dense_cells(q, p, 5, 0.0, 6, 40, 300, 16, 40)
    per_query = visits.where("query_id < 5000").groupBy("query_id").count().agg({"count": "avg"}).first()[0]
    assert per_query < 15  # of 40 cells
    assert R.dense_cells(q, p.where("false"), 5, 0.0, 6, 40, 300, 16, 40)[0].count() == 0


def test_partitions_do_not_matter(spark):
    from tessera.plans import search

    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = search.bm25_topk(spark, "/root/testdata/sf0.001").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    b = search.bm25_topk(spark, "/root/testdata/sf0.001").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(a) == sorted(b)
