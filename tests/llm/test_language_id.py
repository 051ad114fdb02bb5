import itertools
import random
import zlib

import numpy as np

from tessera.llm import language_id as M


def test_forward_backward_matches_all_paths():
    rng = np.random.default_rng(6)
    length = np.array([1, 4, 3])
    start = np.array([0, 1, 5])
    emit, move = rng.random((8, 3)) + 0.1, rng.random((3, 3)) + 0.1
    gamma, expected = M.forward_backward(emit, start, length, move, True)
    pairs = np.zeros((3, 3))
    for s, n in zip(start, length, strict=True):
        mass, seen, moves = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.prod([emit[s + k, y] for k, y in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])  # noqa: B905
            mass += p
            for k, y in enumerate(path):
                seen[k, y] += p
            for a, b in zip(path, path[1:]):  # noqa: B905
                moves[a, b] += p
        assert np.allclose(gamma[s : s + n], seen / mass)
        pairs += moves / mass
    assert np.allclose(expected, pairs)


STEMS = {"xx": ("ka", "lo", "mi", "shi"), "yy": ("ter", "ung", "sch", "ein"), "zz": ("eau", "oux", "tion", "é")}


def text_of(rng, lang, n=40):
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randint(1, 3))) + rng.choice(("", ",", ".\n", "!!")) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z") for i, t, lang in rows], "doc_id long, text string, lang string, score string, held_out string, lang_pred string")


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(k, text_of(rng, lang), lang) for k in range(300) for lang in [("xx", "yy", "zz")[k % 3]]]
    odd = [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 %%% ...", None), (None, text_of(rng, "yy"), "yy"), (1003, text_of(rng, "zz", 20_000), None), (1004, "\u00bd \u00b2 \u2163 \u2460 \u0663 _", "xx"), (1005, "\u0301\u0327", "xx"), (0, rows[0][1], "xx")]
    got = M.identify(docs_of(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    truth = dict((i, lang) for i, _, lang in rows)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[k].lang_pred, by_id[k].score) == ("und", 0.0) for k in (1000, 1001, 1002, 1004, 1005))
    assert by_id[1003].lang_pred == "zz" and by_id[None].lang_pred == "yy" and not by_id[None].held_out
    assert all(0 <= r.score <= 1 for r in got)


def test_code_switched_words_are_labelled_apart():
    rng = random.Random(2)
    langs = sorted(STEMS)
    runs = [(langs.index(x), text_of(rng, x, 24).replace(",", "").replace(".\n", "").replace("!!", "").split()) for x in langs for _ in range(60)]
    weights, move = M.fit(runs, 3)
    text, gamma = M.label_words([text_of(rng, "xx", 15).replace("\n", " ") + " " + text_of(rng, "yy", 15).replace("\n", " ")], M.Remembered(weights), move)
    truth = np.repeat([0, 1], 15)
    assert len(text) == 30 and np.mean(gamma.argmax(1) == truth) > 0.9


def test_labels_are_no_input_and_nothing_to_learn_from(spark):
    rows = [(k, "some words here", None) for k in range(5)]
    assert {(r.lang_pred, r.score) for r in M.identify(docs_of(spark, rows)).collect()} == {("und", 0.0)}
    assert M.identify(docs_of(spark, [])).collect() == []


def test_tokens_are_runs_of_letters():
    import regex

    text = "".join(chr(c) for c in range(1, 0x3000) if c not in range(0xD800, 0xE000))
    # characters that one Unicode version knows and another does not aside
    ours, theirs = set("".join(M.TOKENS.findall(text))) - {"\n"}, set("".join(regex.findall(r"\p{L}", text)))
    assert len(ours ^ theirs) < 20 and not ours & set("\u00bd\u00b2\u2163\u2460")
