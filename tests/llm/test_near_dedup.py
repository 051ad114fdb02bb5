import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import near_dedup as M
from tessera.llm.components import connected_components
from tessera.llm.shared import slices
from tests.llm.conftest import words


def shingles(text, size):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) or (rows[a][0] == rows[b][0] and rows[a][0] is not None):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        mates = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        label = (min(mates) if mates else None) if sets[k] else i
        out.append((i, len(sets[k]), label, label == i if sets[k] else True))
    return sorted(out, key=str)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_matches_brute_force(make_docs, odd_rows, size, percent):
    got = M.near_duplicates(make_docs(odd_rows), shingle=size, percent=percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
    expected = brute(odd_rows, size, percent)
    assert [x[:3] for x in sorted(map(tuple, got), key=str)] == [x[:3] for x in expected]


def test_a_family_of_edits_keeps_every_link(make_docs):
    """Copies with few and with many edits: some hang together only through others, some do not."""
    rng = random.Random(3)
    base = words(rng, 150).split()
    rows = []
    for k in range(330):
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 40)}"
        rows.append((k * 7 % 331, " ".join(copy)))
    got = M.near_duplicates(make_docs(rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 85)


def test_groups_of_many_blocks_and_parts_keep_every_link(make_docs, monkeypatch):
    """Families whose copies lie about the threshold, compared in blocks and parts of a few nodes, some texts longer."""
    monkeypatch.setattr(M, "BLOCK", 32)
    monkeypatch.setattr(M, "PART", 7)
    monkeypatch.setattr(M, "PART_BYTES", 6000)
    rng = random.Random(11)
    rows = []
    for family in range(3):
        base = words(rng, (60, 150, 400)[family]).split()
        for k in range(140):
            copy = list(base)
            for _ in range(rng.randint(2, len(base) // 25 + 2)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 400)}"
            rows.append((1000 * family + k * 3 % 141, " ".join(copy)))
    got = M.near_duplicates(make_docs(rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 85)


def sketched(texts):
    column = pa.array(texts)
    (_, buf, off), = slices(column)
    key, row = M.shingle_sets(buf, off, 3)
    return M.sketches(key, row, len(texts)), np.bincount(row, minlength=len(texts)), np.diff(off)


@pytest.mark.parametrize("same_block", [False, True])
def test_parts_hold_every_pair_at_the_threshold(monkeypatch, same_block):
    monkeypatch.setattr(M, "PART", 9)
    monkeypatch.setattr(M, "PART_BYTES", 20_000)
    rng = random.Random(12)
    base, texts = words(rng, 200).split(), []
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randint(3, 9)):
            copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 99)}"
        texts.append(" ".join(copy))
    regs, n, size = sketched(texts)
    block = [0 if same_block else k % 2 for k in range(120)]
    label = [k // 2 for k in range(120)]
    group = pa.table({"hub": [5] * 120, "low": [0] * 120, "high": [0 if same_block else 1] * 120, "node": list(range(120)), "label": label, "part": block, "n": n, "n_bytes": size, "registers": [r.tobytes() for r in regs]})
    got = M.promising(0.85, 85)(group)
    tasks = {}
    for part, node in zip(got.column("part").to_pylist(), got.column("node").to_pylist(), strict=True):
        tasks.setdefault(part, set()).add(node)
    assert all(len(t) <= 18 for t in tasks.values())
    sets = [shingles(t, 3) for t in texts]
    links = {(a, b) for a in range(120) for b in range(a + 1, 120) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b] and (same_block or block[a] != block[b])}
    assert len(links) > 20 and all(any({a, b} <= t for t in tasks.values()) for a, b in links)
    found = set()
    for t in tasks.values():
        t = sorted(t)
        x = M.compared(3, 85)(pa.table({"node": t, "label": [label[k] for k in t], "text": [texts[k] for k in t]}))
        found |= set(zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True))
    assert links <= found


def test_parts_are_bounded_by_nodes_and_bytes():
    assert M.parts_of(np.array([1] * (M.PART + 1))).tolist() == [0] * M.PART + [1]
    assert M.parts_of(np.array([M.PART_BYTES, 1, M.PART_BYTES * 3, 2, 2])).tolist() == [0, 1, 2, 3, 3]


def test_empty_table(make_docs):
    assert M.near_duplicates(make_docs([])).collect() == []


def test_registers_hold_leading_zeros_and_mantissa():
    values = np.array([0, 1, (1 << 56) - 1, 1 << 55, (1 << 20) + (1 << 19)], np.uint64)
    got = M.register(values)
    assert [int(x) >> M.MANTISSA for x in got] == [56, 55, 0, 0, 35]
    assert [int(x) & 1023 for x in got] == [0, 0, 1023, 0, 512]


def test_estimate_is_near_and_corrected():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.85):
        n, found = 2000, []
        for _ in range(20):
            both = rng.integers(0, 2**63, int(2 * n * share / (1 + share)), dtype=np.uint64) * 2
            sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64) * 2])) for _ in range(2)]
            regs = [M.sketches(s, np.zeros(len(s), np.int64), 1) for s in sets]
            found.append(M.jaccard_estimate(*regs, np.array([n]), np.array([n]))[0])
        assert abs(np.mean(found) - share) < 0.03


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.label for r in got} == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_components_of_a_long_chain_of_shuffled_ids(spark):
    ids = list(range(600))
    random.Random(3).shuffle(ids)
    edges = [(a, b) if k % 3 else (b, a) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False))] + [(1000, 1001), (1002, 1001), (1003, 1003)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted((r.node, r.label) for r in got) == [(k, 0) for k in range(600)] + [(k, 1000) for k in (1000, 1001, 1002)]
