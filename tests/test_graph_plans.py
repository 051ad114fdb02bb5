"""Joins of the graph's tables, all of which grow, send no side through the driver."""

from pyspark.sql import functions as F

from tessera.operators import enrichment as N
from tessera.operators import retrieval as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_graph_search_broadcasts_nothing(spark):
    chunks = spark.range(40).select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 4 < 3, "rick rubin").otherwise("anton7 holding").alias("name"))
    nodes = chunks.groupBy("name").agg(F.lit(1.0).alias("score"), F.count("*").alias("evidence"))
    queries = spark.createDataFrame([(1, "What about anton7 and rubin?"), (2, "rubin?"), (3, "nobody?")], "query_id bigint, q string")
    got = R.graph_search(queries, nodes, chunks, 3)
    assert "BroadcastExchange" not in plan(got)
    ids = {q: [r.id for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 2, 3)}
    assert ids == {1: [0, 1, 2], 2: [0, 1, 2], 3: []}


def test_graph_search_finds_nodes_once(spark, monkeypatch):
    chunks = spark.range(400).select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 4 < 3, "rick rubin").otherwise(F.concat(F.lit("anton"), (F.col("id") % 40).cast("string"), F.lit(" holding"))).alias("name"))
    nodes = chunks.groupBy("name").agg(F.lit(1.0).alias("score"), F.count("*").alias("evidence"))
    queries = spark.range(0, 40).select(F.col("id").alias("query_id"), F.concat(F.lit("What about anton"), F.col("id").cast("string"), F.lit(" and rubin?")).alias("q"))
    calls, names = [], N.named_in
    monkeypatch.setattr(N, "named_in", lambda *a: calls.append(1) or names(*a))
    got = R.graph_search(queries, nodes, chunks, 5)
    # the nodes of the questions lie in a table: their search and its Python are in no branch of the plan
    assert "ArrowEvalPython" not in plan(got) and len(calls) == 1
    where = {}
    for r in chunks.collect():
        where.setdefault(r["name"], set()).add(r.chunk_id)
    want = set()
    for q in range(40):
        score = {}
        for name, ids in where.items():
            met = (f"anton{q}" in name) + ("rubin" in name)
            for i in ids if met else ():
                score[i] = score.get(i, 0) + met / 2
        want |= {(q, i, k) for k, (i, _) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5], 1)}
    assert {(r.query_id, r.id, r["rank"]) for r in got.collect()} == want


def test_names_meet_texts_without_a_broadcast(spark):
    docs = spark.createDataFrame([(1, "Alpha beta"), (2, "betamax"), (3, None)], "id bigint, t string")
    names = spark.createDataFrame([("beta",), ("be",), ("gamma",)], "name string")
    got = N.named_in(docs, names, "id", "t")
    assert "BroadcastExchange" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, "be"), (1, "beta"), (2, "be"), (2, "beta")]


def test_names_are_found_where_the_texts_lie(spark):
    docs = spark.createDataFrame([(k, f"Straße {k} Önder beta") for k in range(30)], "id bigint, t string")
    names = spark.createDataFrame([("straße 1",), ("ÖNDER",), ("r b",), ("beta straße",), ("e",), ("önder beta and more",)], "name string")
    got = N.named_in(docs, names, "id", "t")
    # what is found and the names are shuffled once each, and no text is
    assert plan(got).count("Exchange hashpartitioning") == 2 and "Contains(" not in plan(got) and "contains(" not in plan(got)
    want = {(k, n) for k in range(30) for n in ("straße 1", "ÖNDER", "r b", "e") if n.lower() in f"straße {k} önder beta"}
    assert {tuple(r) for r in got.collect()} == want


def test_spelled_strings_over_windows(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from tessera.functions import arrays as A

    names = ["a", "ab", "abc", "abcd", "abcdefgh", "bcdefghij" * 30, "zz", "é"]
    hashes = A.spelling.func(pa.array(names)).flatten().to_numpy()
    bits = np.zeros(1 << (A.BITMAP - 6), np.uint64)
    at = A._places(hashes).astype(np.int64)
    np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    monkeypatch.setattr(A, "WINDOW", 7)
    texts = ["", "xabcdefgh" * 200, "ab", "c", "z", "zé", "bcdefghij" * 29, "bcdefghij" * 400]
    got = A.spelled(sorted({len(n.encode()) for n in names}), bits).func(pa.array(texts).cast(pa.string()))
    for text, found in zip(texts, got.to_pylist(), strict=True):
        assert {n for n in names if n in text} == {n for n in names if n.encode() in found}
        assert all(f in text.encode() for f in found) and len(set(found)) == len(found)
