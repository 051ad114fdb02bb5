import random
import re

import pytest

from tessera.llm import mixing as M
from tests.llm.conftest import words


def plain_targets(sizes):
    """Targets by raising the level one cap at a time."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, free, target = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def rows_of(seed, n=400):
    rng = random.Random(seed)
    names = ["hot"] * 12 + ["a", "b", "Z", "é", "tiny", None]
    rows = [(k, words(rng, rng.randint(0, 90)), rng.choice(names)) for k in range(n)]
    return rows + [(9000, None, "a"), (9001, "", None), (9002, "  ", "b"), (9003, words(rng, 9000), "hot"), (9004, "x y", "alone"), (None, "one two three", "a"), (7, "again here", "b"), (7, "again here", "b")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, 2, 3, "x") for i, t, s in rows], "doc_id long, text string, source string, sid long, row long, size long, block string")


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_sizes_and_bounds(spark, seed):
    rows = rows_of(seed)
    got = M.mix_sources(table(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = plain_targets(sizes)
    assert sorted(((r.doc_id, r["source"], r["size"]) for r in got), key=str) == sorted(((i, s, size(t)) for i, t, s in rows), key=str)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r["source"]] and r.target == pytest.approx(target[r["source"]])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r.taken
    for s, n in taken.items():
        assert abs(n - target[s]) <= max(M.BLOCK, sizes[s] / 64) + 1
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, M.mix_sources(table(spark, rows).repartition(7)).collect()), key=str)


def test_empty_and_wordless_tables(spark):
    assert M.mix_sources(table(spark, [])).collect() == []
    got = M.mix_sources(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_running_total_does_not_depend_on_parts(spark):
    from tessera.llm.shared import running_total

    rows = [("g" if k % 3 else "h", (k * 7919) % 2**62 * (1 if k % 2 else -1), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, h long, v long")
    got = {(r.g, r.h): r.before for r in running_total(df, "g", "h", "v", "before", part_rows=8).collect()}
    for g in "gh":
        total = 0
        for _, h, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            assert got[g, h] == total
            total += v
