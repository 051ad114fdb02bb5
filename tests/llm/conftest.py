"""Tables for the training-data operators: small, with nulls, ties, repeats, long texts and clashing columns."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["anchor", "node", "band", "label", "part", "sid", "row", "keep_id", "payload", "digest", "doc", "cuts", "start"]


def words(rng, n):
    return " ".join("".join(rng.choice(("ka", "lo", "mi", "ne", "ru", "ta", "shi")) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) as a table with all columns of documents and some whose names operators use themselves."""

    def make(rows):
        full = [(i, t, None, None, None, *["x"] * len(CLASH)) for i, t in rows]
        return spark.createDataFrame(full, DOCS + "".join(f", {c} string" for c in CLASH))

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Texts of all the odd kinds, with copies of each."""
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(8)]
    rows = [(k + 1, t) for k, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0].upper()), (22, base[1] + " extra"), (23, " ".join(w if i % 60 else "changed" for i, w in enumerate(base[2].split())))]
    rows += [(30, None), (31, ""), (32, "   \n\t"), (33, "one"), (34, "one"), (35, "one two"), (36, None), (37, "É è ß 日本 \U0001f600 " * 9), (38, "é è ß 日本 \U0001f600 " * 9)]
    rows += [(40, words(rng, 30_000)), (41, "x" * 20_000), (42, base[3] + "\n" + base[4]), (42, base[3] + "\n" + base[4]), (None, base[5]), (None, "nameless text")]
    return rows
