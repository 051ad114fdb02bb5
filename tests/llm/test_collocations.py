"""Collocations and the graph behind them against plain counting of all phrases."""

import random
import re
from collections import Counter

import pytest

from tessera.llm import collocations as m

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        n[lang] += 0
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOW)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    return f, n


def plain_rows(rows, least, first=2000):
    f, n = plain_counts(rows)
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    over = Counter()
    for (lang, g), a in cand.items():
        for size in range(2, len(g)):
            for i in range(len(g) - size + 1):
                over[lang, g[i : i + size]] = max(over[lang, g[i : i + size]], a)
    out = []
    for (lang, g), a in cand.items():
        if 100 * over[lang, g] >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
        out.append((lang, score, a, " ".join(g), f[lang, g[:k]], f[lang, g[k:]], n[lang]))
    out.sort(key=lambda r: (r[0], -r[1], -r[2], r[3].encode()))
    seen, ranked = Counter(), []
    for lang, score, a, phrase, left, right, total in out:
        seen[lang] += 1
        if seen[lang] <= first:
            ranked.append((lang, seen[lang], phrase, a, left, right, total, score))
    return sorted(ranked)


def corpus(seed, n=400):
    """Texts with frequent words and pairs, repeated sentences, loops, and every kind of blank and stop."""
    rng = random.Random(seed)
    common = [f"w{k}" for k in range(12)]
    lines = [" ".join(rng.choice(common + ["É", "日本", "x y"]) for _ in range(rng.randint(3, 25))) for _ in range(8)]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            what = rng.random()
            parts.append(rng.choice(lines) if what < 0.35 else "ab ab cd " * rng.randint(1, 9) if what < 0.45 else " ".join(rng.choice(common) if rng.random() < 0.8 else f"rare{rng.random()}" for _ in range(rng.randint(1, 20))))
        text = "".join(p.upper() + rng.choice([" ", ". ", ",", "\t", "\n", " \x0b", "!?", ";:", "  "]) for p in parts)
        rows.append((rng.choice(["en", "fr", None, "und"]), text))
    return [*rows, ("de", None), ("de", ""), ("de", " \t\n.,"), ("de", "one"), ("x" * 30, "only rare words here")]


@pytest.fixture
def write(spark, tmp_path):
    def put(rows):
        spark.createDataFrame([(k, t, lang, "s", 0, "g", "u") for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n long, gram string, up string").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return put


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_plain_counting(spark, write, seed, monkeypatch):
    rows = corpus(seed)
    monkeypatch.setattr(m, "FIRST", 25)
    got = m.op13_collocations(spark, write(rows))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_rows(rows, 30, 25)


def test_counts_and_paths(spark, write):
    rows = corpus(5, 150)
    f, n = plain_counts(rows)
    docs = spark.read.parquet(f"{write(rows)}/documents.parquet")
    totals, paths, counts = m.phrase_counts(docs, 7)
    assert {r.lang: r.total for r in totals.collect()} == dict(n)
    got = {(r.lang, tuple(r.gram.split(" "))): r.n for r in counts.collect()}
    assert got == {k: a for k, a in f.items() if a >= 7}
    lists = paths.collect()
    assert max(len(p.words) for p in lists) > 8  # sentences are one path
    edges = [(p.lang, tuple(p.words[i : i + 4]), p.n) for p in lists for i in range(len(p.words) - 3)]
    assert len(edges) == len(set(edges)) and {(lang, g): a for lang, g, a in edges} == {k: a for k, a in f.items() if a >= 7 and len(k[1]) == 4}


def test_every_word_is_let_through_by_a_full_bitmap(spark, write, monkeypatch):
    rows = corpus(6, 120)
    monkeypatch.setattr(m, "marked", lambda bits, key: key == key)
    got = m.op13_collocations(spark, write(rows))
    assert sorted(map(tuple, got.collect())) == plain_rows(rows, 30)


def test_long_text_and_counts_beyond_64_bits(spark, write, monkeypatch):
    monkeypatch.setattr(m, "SCALE", 2_000_000)
    rows = [("en", "to be or not to be " * 30_000), ("en", "x" * 300_000), ("en", "to be")]
    assert sorted(map(tuple, m.op13_collocations(spark, write(rows)).collect())) == plain_rows(rows, 30)
    found = spark.createDataFrame([(9 * 10**18,)], "a long").selectExpr(f"CAST({m.SCALE} AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0)) div (CAST(a AS DECIMAL(20, 0)) + CAST(a AS DECIMAL(20, 0))) AS s")
    assert found.collect()[0].s == 1_000_000


def test_empty_table(spark, write):
    assert m.op13_collocations(spark, write([])).count() == 0
