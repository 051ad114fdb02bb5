import pytest

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from tessera.llm import token_counts as M  # noqa: E402

TEXTS = ["", "The cat sat.", "  two   spaces \n\n\n and lines\t\t", "don't we'll I'M", "a<|endoftext|>b<|endoftext|>", "é日本 \U0001f600 ½ 12345", "x" * 3000, "\x1c a\x85b  ", "ab " * 4000, " \n \n x"]


@pytest.fixture(scope="module")
def both():
    return M.Merges(P.path("byte_bpe_50k.json"), P.PATTERN), tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def library(tokenizer, text):
    return len(tokenizer.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_librarys(both):
    merges, tokenizer = both
    assert [merges.count(t) for t in TEXTS] == [library(tokenizer, t) for t in TEXTS]


def longest(exact, budget):
    return max(c for c, n in enumerate(exact) if n <= budget)


def test_every_prefix_and_budget_without_encoding_again(both, monkeypatch):
    merges, tokenizer = both
    texts = [TEXTS[2] + TEXTS[3] + TEXTS[5], TEXTS[4] * 2, "unbelievable straightforwardness  ", "a \n\t \n\t b  \r\n\r\n'll 'l we'll?!<|endoftext|>  x", TEXTS[7], "?!<|endoftext|", "  \t<|endoftext|>  y", ""]
    calls = []
    monkeypatch.setattr(M.Merges, "count", lambda self, text: calls.append(text))
    for text in texts:
        prefix = M.PrefixCounts(merges, text)
        exact = [library(tokenizer, text[:k]) for k in range(len(text) + 1)]
        assert [prefix.at(k) for k in range(len(text) + 1)] == exact
        for budget in (0, 1, 2, 3, 4, 5, 7, 11, 1000):
            cut = prefix.within(budget)
            assert cut == longest(exact, budget)
            assert merges.truncated(text, budget) == (exact[-1], cut)
    assert not calls


def test_counts_inside_remembered_pieces_are_looked_up(both, monkeypatch):
    merges, tokenizer = both
    text = "unbelievable straightforwardness of internationalisation"
    prefix = M.PrefixCounts(merges, text)
    exact = [library(tokenizer, text[:k]) for k in range(len(text) + 1)]
    monkeypatch.setattr(M.Merges, "prefix_counts", lambda self, data: pytest.fail("encoded again"))
    assert [prefix.at(k) for k in range(len(text) + 1)] == exact
    assert prefix.within(3) == longest(exact, 3)


def test_table(spark, make_docs, both):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "id"), (99, None), (5, TEXTS[5])]
    got = M.token_counts(make_docs(rows), P.path("byte_bpe_50k.json"), P.PATTERN, 30).collect()
    cut = lambda t: longest([library(both[1], t[:k]) for k in range(min(len(t), 400) + 1)], 30)
    expected = [(i, len((t or "").encode()), n := library(both[1], t or ""), n > 30, cut(t) if n > 30 else len(t or "")) for i, t in rows]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert M.token_counts(make_docs([]), P.path("byte_bpe_50k.json"), P.PATTERN, 1024).collect() == []


@pytest.mark.parametrize("letters, n", [("acgt", 1_000_000), ("aé日x", 100_000), ("01", 50_000), (" ", 50_000), ("?!-", 50_000)])
def test_one_long_run_is_encoded_once(both, monkeypatch, letters, n):
    """The cut is right next to it, and nothing above it fits: counts fall by a few tokens at most from one prefix on."""
    import random
    import time

    merges, tokenizer = both
    rng = random.Random(7)
    text = "A start. " + "".join(rng.choice(letters) for _ in range(n)) + " end"
    calls, once = [], M.Merges.prefix_counts
    monkeypatch.setattr(M.Merges, "prefix_counts", lambda self, data: calls.append(data) or once(self, data))
    began = time.perf_counter()
    total, cut = merges.truncated(text, 1024)
    assert time.perf_counter() - began < 8  # 2 s on a machine of its own
    assert len(calls) == len(set(calls))
    assert total == library(tokenizer, text)
    near = [library(tokenizer, text[:c]) for c in range(cut, min(len(text), cut + 40) + 1)]
    assert near[0] <= 1024 and all(x > 1024 for x in near[1:])


def test_odd_rows_have_the_librarys_counts_and_cuts(spark, make_docs, odd_rows, both):
    got = M.token_counts(make_docs(odd_rows), P.path("byte_bpe_50k.json"), P.PATTERN, 64).collect()
    want = []
    for i, t in odd_rows:
        n = library(both[1], t or "")
        cut = len(t or "")
        if n > 64:
            cut = longest([library(both[1], t[:c]) for c in range(min(len(t), 700) + 1)], 64)
        want.append((i, len((t or "").encode()), n, n > 64, cut))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_the_table_of_pieces_is_bounded(both, monkeypatch):
    monkeypatch.setattr(M, "PIECES", 3)
    merges = M.Merges(P.path("byte_bpe_50k.json"), P.PATTERN)
    assert merges.count("a b c d e f g a b") == library(both[1], "a b c d e f g a b") and len(merges) <= 3
    monkeypatch.setattr(M, "REMEMBERED", 100)
    assert all(merges.count("z" * k) == library(both[1], "z" * k) and sum(map(len, merges)) < 400 for k in range(90, 200))
    assert set(merges) == set(merges.inside)


def test_seams_of_tokens_equal_the_merges_of_their_bytes(both):
    import random

    merges, rng = both[0], random.Random(4)
    usable = [t for t in merges.number if merges.token(t) >= 0]
    assert len(usable) > 40_000
    short = [t for t in usable if len(t) < 4]
    seen = set()
    for k in range(6000):
        left, right = rng.choice(usable if k % 2 else short), rng.choice(short)
        want = merges.merge(left + right) == [left, right]
        seen.add(want)
        assert merges.compatible(merges.token(left), merges.token(right)) == want
    assert seen == {True, False}
