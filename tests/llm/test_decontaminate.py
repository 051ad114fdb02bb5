import random

import numpy as np

from tessera.llm import decontaminate as M
from tests.llm.conftest import words


def plain_alignment(item, passage):
    best, end, score = 0, 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (M.MATCH if a == b else M.MISMATCH), score[i - 1][j] + M.GAP, score[i][j - 1] + M.GAP)
            if score[i][j] > best:
                best, end = score[i][j], j
    return best, end


def test_alignment_matches_the_plain_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 20))
        got = M.local_alignment(a, b)
        assert got[0] == plain_alignment(list(a), list(b))[0]


def test_leaks_are_found_and_clean_documents_left(spark, make_docs):
    rng = random.Random(9)
    items = [(k, words(rng, rng.randint(18, 60)).capitalize() + ".") for k in range(12)]
    rows, leaks = [], set()
    for d in range(60):
        body = words(rng, 200)
        if d % 4 == 0:
            k = d // 4 % 12
            w = items[k][1].split()
            if d % 8 == 0:  # an edited copy: a word in seven changed, one lost, one added
                w = [x if i % 7 else "other" for i, x in enumerate(w)]
                del w[len(w) // 2]
                w.insert(3, "more")
            body = body[: len(body) // 2] + " " + ("*** ".join(w) if d % 12 == 0 else " ".join(w).upper()) + " " + body[len(body) // 2 :]
            leaks.add((d, k))
        rows.append((d, body))
    rows += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[1][1])]
    leaks |= {(102, 0), (None, 1)}
    table = spark.createDataFrame([(i, t, "x") for i, t in [*items, (50, None), (51, ""), (52, "..."), (53, "two words")]], "item_id long, text string, words string")
    found = M.contamination(make_docs(rows), table).collect()
    assert {(r.doc_id, r.item_id) for r in found} == leaks and len(found) == len(leaks)
    whole = next(r for r in found if r.doc_id == 102)
    assert whole.score == 1.0 and whole.first_word == 0 and whole.end_word == len(items[0][1].split())


def test_an_item_that_many_documents_hold_keeps_its_seeds(spark, make_docs):
    rng = random.Random(2)
    item = words(rng, 40)
    rows = [(d, words(rng, 30) + " " + item + " " + words(rng, 30)) for d in range(80)]
    table = spark.createDataFrame([(0, item), (1, words(rng, 40))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in M.contamination(make_docs(rows), table).collect()} == {(d, 0) for d in range(80)}


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    assert M.contamination(make_docs([]), one).collect() == []
    assert M.contamination(make_docs([(1, "some words of an item")]), none).collect() == []


def test_leaks_equal_those_of_the_full_comparison(spark, make_docs):
    """Every document and item aligned word by word: what is found is a leak there, and hardly any leak is missed."""
    rng = random.Random(21)
    lexicon = [words(rng, 1) for _ in range(400)]
    text = lambda n: [rng.choice(lexicon) for _ in range(n)]
    items = [(k, text(rng.randint(15, 40))) for k in range(14)] + [(20, text(2)), (21, ["alone"]), (22, [])]
    rows = []
    for d in range(70):
        body = text(rng.randint(20, 90))
        if d % 2:
            copy, rate = list(items[d % 14][1]), rng.choice((0, 0.05, 0.1, 0.2, 0.3))
            copy = [rng.choice(lexicon) if rng.random() < rate else w for w in copy if rng.random() > rate / 3]
            at = rng.randint(0, len(body))
            body = body[:at] + copy + body[at:]
        rows.append((d, body))
    rows += [(100, items[14][1]), (101, ["alone"]), (102, ["alone", "alone"]), (103, []), (104, items[0][1]), (104, items[0][1])]
    table = spark.createDataFrame([(k, " ".join(w).upper()) for k, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in M.contamination(make_docs([(d, " ".join(w)) for d, w in rows]), table).collect()}
    truth = {}
    for d, body in rows:
        for k, item in items:
            if item and (len(item) >= M.SEED or body == item):
                score = plain_alignment(item, body)[0] / (M.MATCH * len(item))
                if score >= M.LEAST:
                    truth[d, k] = max(score, truth.get((d, k), 0))
    assert len(truth) > 30 and set(got) <= set(truth)
    assert len(got) >= 0.97 * len(truth) and all(abs(got[x] - truth[x]) < 1e-9 for x in got)
    assert {(100, 20), (101, 21), (104, 0)} <= set(got)
