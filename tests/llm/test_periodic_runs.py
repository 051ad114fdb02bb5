"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import periodic_runs as m
from tessera.llm.wordscan import U, mix


def plain_runs(words, least=12):
    out = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                out.setdefault((i, length), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, length, q) for (s, length), q in out.items())


def plain_rows(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    told = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(told.encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def tiled_runs(words):
    """Runs by the module's tiles, their intervals stitched in Python."""
    _, codes = np.unique(np.array(words), return_inverse=True)
    names = mix(codes.astype(U) + U(99))
    tiles = [(names[s:e], s, c, lo, hi) for s, e, c, lo, hi in m.tile_bounds(len(words))]
    parts = sorted((p, i, j) for _, p, i, j in m.solve(tiles))
    out = []
    for p, i, j in parts:
        if out and out[-1][0] == p and i <= out[-1][2]:
            out[-1][2] = max(j, out[-1][2])
        else:
            out.append([p, i, j])
    return sorted((i, j - i + p, p) for p, i, j in out if j - i >= p and j - i + p >= 12)


def periodic(rng, n, letters):
    """Words with stretches of many periods, nested and next to each other."""
    out = []
    while len(out) < n:
        unit = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 11, 12, 16, 31, 60, 130]))]
        if rng.random() < 0.3:
            unit = unit * rng.randint(2, 3) + [rng.choice(letters)]
        out += (unit * rng.randint(1, 5))[: rng.randint(1, 5 * len(unit))]
    return out[:n]


@pytest.mark.parametrize("seed", range(40))
def test_tiles_find_what_a_plain_search_finds(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(m, "TILE", 48)
        monkeypatch.setattr(m, "PERIOD", 4)
        monkeypatch.setattr(m, "GROW", 4)
    words = periodic(rng, rng.choice([0, 1, 11, 12, 13, 40, 150, 600, 900]), "ab" if seed % 3 == 0 else "abcdefgh")
    assert tiled_runs(words) == plain_runs(words)


@pytest.mark.parametrize("unit", [1, 2, 12, 500, 4000])
def test_one_long_run(unit):
    rng = random.Random(unit)
    base = [str(rng.random()) for _ in range(unit)]
    words = (base * (12_000 // unit + 1))[:12_000]
    assert tiled_runs(words) == [(0, 12_000, unit)]


def test_words_of_fibonacci_and_thue_morse():
    a, b = "a", "ab"
    while len(b) < 700:
        a, b = b, b + a
    thue = ["ab"[bin(i).count("1") % 2] for i in range(700)]
    assert tiled_runs(list(b)) == plain_runs(list(b))
    assert tiled_runs(thue) == plain_runs(thue)


def test_query_on_odd_rows(spark, make_docs, odd_rows, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = odd_rows + [(100 + k, " \x0b".join(periodic(rng, rng.randint(0, 300), "abc"))) for k in range(60)]
    rows += [(7, "a " * 50), (7, "a " * 50), (None, "b c " * 20), (8, "A a " * 9), (9, "x y x y " * 8)]
    monkeypatch.setattr(m, "TILE", 4_096)
    rows = [(i, t if t is None or len(t.split()) < 5000 else " ".join(t.split()[:1500])) for i, t in rows]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = m.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((plain_rows(i, t) for i, t in rows), key=str)


def test_texts_of_several_tiles_and_texts_themselves(spark, make_docs):
    rng = random.Random(8)
    unit = [str(k) for k in range(900)]
    words = [str(rng.random()) for _ in range(3000)] + unit * 9 + ["z"] * 5000 + [str(rng.random()) for _ in range(100)] + ["u", "v"] * 7000
    got = {r.doc_id: r for r in m.periodic_runs(make_docs([(1, " ".join(words)), (2, "one two"), (3, None), (4, " ".join(words[:3900] + words[:3500]))])).collect()}
    assert [tuple(r) for r in got[1].runs] == [(3000, 8100, 900), (11_100, 5000, 1), (16_200, 14_000, 2)]
    assert got[1].kept.split() == words[:3900] + ["z"] + words[16_100:16_202]
    assert (got[4].runs, got[4].kept.split()) == ([], words[:3900] + words[:3500])
    assert (got[2].kept, got[2].runs, got[3].kept, got[3].n_words) == ("one two", [], "", 0)


def test_empty_table(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert m.op11_periodic_runs(spark, str(tmp_path)).count() == 0
