import hashlib
import random

import numpy as np

from tessera.llm import suffix_dedup as M
from tests.llm.conftest import words


def brute(rows, least=50):
    first, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - least + 1):
            first.setdefault(b[k : k + least], i)
    for i, t in rows:
        b, mine = (t or "").encode(), set()
        for k in range(len(b) - least + 1):
            if i is not None and first[b[k : k + least]] < i:
                mine.update(range(k, k + least))
        spans = sum(1 for k in mine if k - 1 not in mine)
        out.append((i, len(b), len(mine), spans, hashlib.sha256(bytes(x for k, x in enumerate(b) if k not in mine)).hexdigest()))
    return sorted(out, key=str)


def got(docs, **more):
    return sorted(map(tuple, M.suffix_dedup(docs, **more).collect()), key=str)


def test_matches_brute_force(make_docs, odd_rows):
    rows = [r for r in odd_rows if r[0] != 40]
    assert got(make_docs(rows)) == brute(rows)


def test_shared_passages_at_all_lengths_near_the_bound(make_docs):
    rng = random.Random(8)
    passage = words(rng, 60)
    rows = []
    for k in range(40):
        at, size = rng.randint(0, 200), rng.choice((16, 33, 48, 49, 50, 51, 52, 66, 83, 84, 100, 200))
        rows.append((k * 11 % 41, words(rng, 5) + passage[at : at + size] + words(rng, 5) + passage[at : at + size // 2]))
    rows += [(50, "a" * 120), (51, "a" * 49), (52, "a" * 50 + "b"), (53, "ab" * 60), (54, "b" + "ab" * 30)]
    assert got(make_docs(rows)) == brute(rows)


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(make_docs):
    rng = random.Random(4)
    x, y, z = (words(rng, 40) for _ in range(3))
    rows = [(1, x), (5, x), (5, y), (7, y), (7, y), (7, z + y[20:150]), (9, z), (9, z)]
    assert got(make_docs(rows)) == brute(rows)


def test_repetitive_texts(make_docs):
    rows = [(1, "ab" * 3000), (2, "ba" * 2000 + "c"), (3, "a" * 5000), (4, "a" * 5000 + "b" * 60), (5, ("line of text\n" * 400)), (6, "x" + "line of text\n" * 300)]
    assert got(make_docs(rows)) == brute(rows)


def test_runs_equal_their_definition_and_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    data[1000:1400] = 97
    off = np.array([0, 2000, 2030, 2030, 5000])
    hashes, plain = M.order_hash(data), {}
    for a, b in zip(off[:-1], off[1:], strict=True):
        for p in range(a, b - 49):
            plain[p] = p + int(np.argmin(hashes[p : p + 35]))
    for piece in (64, 1 << 10, 1 << 16):
        monkeypatch.setattr(M, "PIECE", piece)
        r = M.Runs(data, off, 50)
        assert {int(s) + k: int(p) for s, n, p in zip(r.start, r.size, r.place, strict=True) for k in range(n)} == plain
        assert len(r.row) == 1 + sum(plain[p] != plain.get(p - 1) for p in sorted(plain)[1:])


def test_empty_table(make_docs):
    assert got(make_docs([])) == []
