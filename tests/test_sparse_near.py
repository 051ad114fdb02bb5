"""Sparse search by kinds of near texts, its tokens and postings as bytes, and the signals made of its blocks."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import retrieval as R
from tessera.plans import search


def texts(spark, n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = i % 3
        words = [f"{'abc'[kind]}{w}" for w in range(50)] + ["the", "of", f"only{i // 2}"]
        rows.append((i, " ".join(rng.choices(words, weights=[1 / (w + 1) for w in range(len(words) - 3)] + [1, 1, 0.2], k=rng.randint(0, 60))), ("x", "y", None)[kind]))
    return spark.createDataFrame([*rows, (n, None, "x"), (n + 1, rows[5][1], "y"), (n + 2, "the of " * 300, "x")], "doc_id bigint, text string, lang string")


def as_rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "id", "score", "rank").collect())


def test_kinds_and_small_matrices_change_no_result(spark, monkeypatch):
    docs = texts(spark, 240).repartition(3)
    terms = R.term_counts(docs, "doc_id", F.col("text")).cache()
    index = R.postings(terms, R.document_frequencies(terms), R.stats_of_terms(terms))
    plain = as_rows(R.sparse_search(index.where("id % 4 = 0"), index, 6))
    for common, dense, tile in ((R.COMMON, R.DENSE_TERMS, R.TILE), (4, 3, 5)):
        for name, value in (("COMMON", common), ("DENSE_TERMS", dense), ("TILE", tile)):
            monkeypatch.setattr(R, name, value)
        got = R.sparse_text_search(docs, "doc_id", F.col("text"), F.col("doc_id") % 4 == 0, 6, query_rows=9, block_rows=17, near=F.col("lang"))
        assert as_rows(got) == plain


def test_a_block_has_texts_of_one_kind(spark):
    docs = texts(spark, 90).repartition(2)
    blocks = R.text_blocks(docs, "doc_id", F.col("text"), F.col("doc_id") % 4 == 0, near=F.col("lang")).collect()
    kind = {r.doc_id: r.lang for r in docs.collect()}
    held = [np.frombuffer(b.ids, np.int64).tolist() for b in blocks]
    assert all(len({kind[i] for i in ids}) == 1 for ids in held)
    assert sorted(sum(held, [])) == sorted(r.doc_id for r in docs.collect() if r.text and re.search("[a-z0-9]", r.text))


def test_a_later_block_of_nearer_texts_gives_few_candidates(spark):
    """Texts of the query's own kind that come after others all beat the best so far; only the best are scored again."""
    scored = []
    real = np.einsum

    def counted(*args):
        scored.append(len(args[1]))
        return real(*args)

    def block(ids, tf):
        n = len(ids)
        return R._text_block(0, ids=np.array(ids), lengths=np.full(n, 9), asks=np.zeros(n, bool), terms=np.array([1, 2]), counts=np.array([n, n]), places=np.tile(np.arange(n), 2), values=np.tile(tf, 2))

    ask = {"query_block": [0], "query_ids": [7], "query_terms": [1, 2], "query_counts": [1, 1], "factors": [1.0, 1.0], "query_sizes": [2], "query_at": [0, 1], "query_weights": [1.0, 1.0], "mean": [9.0]}
    row = {c: v if c in ("query_block", "mean") else pa.array([R._packed(c, np.array(v))], pa.binary()) for c, v in ask.items()}
    blocks = [block(range(100), np.ones(100)), block(range(100, 400), np.arange(300) + 2)]
    np.einsum = counted
    try:
        out = list(R._block_products(5, 6, R._bm25_values)(pa.RecordBatch.from_pydict(row | b) for b in blocks))
    finally:
        np.einsum = real
    assert out[0].column("id").to_pylist() == [399, 398, 397, 396, 395]
    assert scored[0] == 100 and scored[1] < 60  # all of the first block are equal


def test_tokens_are_hashed_together_as_one_by_one():
    rng = random.Random(1)
    words = ["".join(rng.choices("ab0", k=rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 200]))) for _ in range(400)]
    given = [None, "", " ..", "İx KK été", *(" ".join(rng.choices(words, k=30)).replace(" ", rng.choice([" ", "-", "ß\n"])) for _ in range(50))]
    lengths, hashes = A.hashed_tokens(given)
    found = [re.findall("[a-z0-9]+", (t or "").lower()) for t in given]
    assert lengths.tolist() == [len(x) for x in found]
    pairs = set(zip(sum(found, []), hashes.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})


def test_distinct_numbers_that_differ_in_low_bits():
    rng = np.random.default_rng(2)
    for values in (rng.integers(-(1 << 62), 1 << 62, 500).repeat(3), rng.integers(0, 9, 700), np.zeros(0, np.int64), np.array([-(1 << 63), (1 << 63) - 1, -1, 0])):
        for got, known in zip(A.distinct(values), np.unique(values, return_inverse=True), strict=True):
            assert got.tolist() == known.tolist()


def test_abstention_signals_come_from_the_blocks_of_the_search(spark, tmp_path, monkeypatch):
    texts(spark, 400).write.parquet(f"{tmp_path}/documents.parquet")

    def unused(*_):
        raise AssertionError("texts are cut into tokens again")

    monkeypatch.setattr(R, "term_counts", unused)
    got = {r.query_id: tuple(r)[1:] for r in search.abstention_signals(spark, f"{tmp_path}").collect()}
    words = {r.doc_id: re.findall("[a-z0-9]+", r.text or "") for r in texts(spark, 400).collect()}
    hits: dict = {}
    for r in search._bm25(spark, f"{tmp_path}").where("query_id <> id").orderBy("rank").collect():
        hits.setdefault(r.query_id, []).append((r.id, r.score))
    assert set(got) == set(hits)
    for q, found in hits.items():
        rare = [w for w in words[q] if sum(w in x for x in map(set, words.values())) <= 3]
        cover = sum(any(w in words[i] for i, _ in found) for w in rare) / len(rare) if rare else 1.0
        gap = 1.0 if len(found) == 1 else found[0][1] / found[1][1]
        assert got[q] == (round(cover, 6), round(gap, 5))
