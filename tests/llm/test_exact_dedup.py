import hashlib
import random

import numpy as np
import pytest

from tessera.llm import exact_dedup as M

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out, stays = [], set()
    for i, t in rows:
        n = (t or "").translate(LOWER)
        keep = max((x for x in groups[n] if x is not None), default=None)
        kept = i == keep and n not in stays  # of rows that tie, one
        stays |= {n} if kept else set()
        out.append((i, keep, len(groups[n]), kept, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(make_docs, odd_rows):
    got = M.exact_dedup(make_docs(odd_rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(odd_rows)


def test_empty_table(make_docs):
    assert M.exact_dedup(make_docs([])).collect() == []


@pytest.mark.parametrize("rows", [
    [(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb"), (5, "cc")],
    [(None, "aa"), (None, "bb")],
    [(None, "aa"), (1, "bb")],
    [(None, "aa"), (None, "aa"), (3, "bb"), (3, "bb"), (3, "cc"), (None, "dd")],
    [(k % 7, "abc"[k % 3] * 2) for k in range(400)],
])
def test_a_collision_of_fingerprints_is_split_by_the_comparison(make_docs, monkeypatch, rows):
    monkeypatch.setattr(M, "fingerprint", constant)
    monkeypatch.setattr(M, "SLOT", 8)
    got = M.exact_dedup(make_docs(rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_repeated_and_null_ids(make_docs):
    rows = [(5, "same"), (5, "same"), (5, "Other"), (7, "other"), (None, "SAME"), (None, "only"), (None, "only"), (None, None), (8, "")]
    got = M.exact_dedup(make_docs(rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def constant(text):
    from pyspark.sql import functions as F

    return F.struct(F.lit(1).cast("long").alias("lane0"), F.lit(1).cast("long").alias("lane1"), F.lit(2).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def test_fingerprints_combine_at_any_cut():
    rng = random.Random(1)
    data = np.frombuffer(rng.randbytes(20_000), np.uint8)
    whole = [int(x[0]) for x in M.fingerprints(data, np.array([0, len(data)]))]
    for cut in (1, 4095, 4096, 4097, 12_345):
        left, right = (M.fingerprints(p, np.array([0, len(p)])) for p in (data[:cut], data[cut:]))
        assert [M.combine(int(left[k][0]), int(right[k][0]), len(data) - cut, k) for k in range(2)] == whole


def test_same_text_sees_a_difference_in_any_chunk(spark):
    long = "a" * (M.COMPARE * 2 + 5)
    rows = [(long, long), (long, long[:-1] + "b"), ("", ""), ("a", "")]
    got = spark.createDataFrame(rows, "x string, y string").select(M.same_text("x", "y").alias("s")).collect()
    assert [r.s for r in got] == [True, False, True, False]
