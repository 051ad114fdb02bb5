"""Language identification by a linear-chain conditional random field.

Words are runs of letters in lower case; a line of the text is a chain. The score of a language at a word is the sum
of learned weights of the word's affixes (1 to 4 characters), character n-grams (2 and 3, with word ends) and of the
word itself (the lexicon); learned transitions tie neighbours. Forward-backward gives each word its distribution over
languages, so code-switched text is labelled word by word; a document's language is the one with the most of that
mass, and the score is its share.

Fitting takes a bounded sample: about ROWS rows a language (chosen by a hash of the id, at a rate that follows from
the counts of all rows), of each row RUNS runs of WORDS neighbouring words spread over its whole text. Runs of
different rows and languages are joined into training chains, so that transitions are learned from switches, too. The
weights are 2^16 numbers a language however large the corpus is. Everything else covers all rows and whole texts.

Defined cases: a null text or one without letters is `und` with score 0; without labelled rows to learn from, every
row is; a null id is never learned from and not held out; rows that repeat are predicted each; ties go to the first
language by code point; columns other than those named are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import table
from tessera.llm.wordscan import STEP, U, mix, powers

ROWS, RUNS, WORDS = 300, 6, 24
WIDTH = 1 << 16
EPOCHS, CHAINS, RATE, SWITCH = 4, 128, 0.4, 0.35
#: Words that a worker remembers before it starts anew, and bytes of text that are labelled together.
REMEMBERED, TOGETHER = 400_000, 2 << 20
#: New words whose features are listed together.
LEARNED = 1 << 14
LETTER = r"\p{L}"
#: Word characters that are neither letters nor decimal digits: fractions, superscripts, Roman and circled numerals.
NUMERALS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
TOKENS = re.compile(rf"[^\W\d_{NUMERALS}]+|\n+")
#: The same for texts without such numerals, twice as fast; a token of it that is not all letters says that a text has some.
QUICK = re.compile(r"[^\W\d_]+|\n+")
PREDICTED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(column of the weights, index of the word) of every feature of the words: affixes, character n-grams, lexicon."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    end = np.cumsum(sizes)
    start = end - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    columns, owners = [], []

    def add(kind: int, keys: np.ndarray, owner: np.ndarray) -> None:
        columns.append((mix(keys + U(kind << 40)) & U(WIDTH - 1)).astype(np.int64))
        owners.append(owner)

    gram = code.copy()
    for n in range(1, 5):
        if n > 1:
            gram = gram[:-1] * STEP + code[n - 1 :]
        if n in (2, 3):
            inside = np.flatnonzero(of[: len(gram)] == of[n - 1 :])
            add(n, gram[inside], of[inside])
        long = np.flatnonzero(sizes - 2 >= n)
        add(10 + n, gram[start[long] + 1], long)
        add(20 + n, gram[end[long] - 1 - n], long)
    whole = np.add.reduceat(mix(code + U(7)) * powers(int(sizes.max()))[np.arange(len(code)) - start[of]], start)
    add(30, whole, np.arange(len(words)))
    return np.concatenate(columns), np.concatenate(owners)


def forward_backward(emit: np.ndarray, start: np.ndarray, length: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Distributions of every position of many chains, and the expected transitions if pairs are wanted.

    emit has the exponentials of the scores, a row for each position; chain c is rows start[c] to start[c] + length[c].
    Step t is taken for all chains that are longer than t at once.
    """
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    ahead, back = np.empty_like(emit), np.ones_like(emit)
    expected = np.zeros_like(move)
    a = None
    for t, n in enumerate(live):
        at = start[:n] + t
        a = emit[at] if a is None else (a[:n] @ move) * emit[at]
        a /= a.sum(1, keepdims=True)
        ahead[at] = a
    b = np.ones((len(start), emit.shape[1]))
    for t in range(len(live) - 1, 0, -1):
        n = live[t]
        at = start[:n] + t
        m = emit[at] * b[:n]
        if pairs:
            both = ahead[at - 1][:, :, None] * move[None] * m[:, None, :]
            expected += (both / both.sum((1, 2), keepdims=True)).sum(0)
        b[:n] = m @ move.T
        b[:n] /= b[:n].sum(1, keepdims=True)
        back[at - 1] = b[:n]
    gamma = ahead * back
    return gamma / gamma.sum(1, keepdims=True), expected


def fit(runs: list[tuple[int, list[str]]], n_langs: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(weights, log transitions) from labelled runs of words, by AdaGrad on the chains' log likelihood."""
    rng = np.random.default_rng(seed)
    vocabulary = sorted({w for _, words in runs for w in words})
    columns, owners = features(vocabulary)
    order = np.argsort(owners, kind="stable")
    known = dict(zip(vocabulary, np.split(columns[order], np.flatnonzero(np.diff(owners[order])) + 1), strict=True))
    weights, squares = np.zeros((WIDTH, n_langs)), np.full((WIDTH, n_langs), 1e-6)
    move, move_squares = np.zeros((n_langs, n_langs)), np.full((n_langs, n_langs), 1e-6)
    by_lang = [[k for k, (lang, _) in enumerate(runs) if lang == x] for x in range(n_langs)]
    by_lang = [x for x in by_lang if x]
    for _ in range(EPOCHS):
        for _ in range(max(1, len(runs) // (2 * CHAINS))):
            words, labels, start, length = [], [], [], []
            for _ in range(CHAINS):
                start.append(len(words))
                lang = rng.integers(len(by_lang))
                for _ in range(rng.integers(1, 4)):
                    if rng.random() < SWITCH:
                        lang = rng.integers(len(by_lang))
                    label, run = runs[by_lang[lang][rng.integers(len(by_lang[lang]))]]
                    words += run
                    labels += [label] * len(run)
                length.append(len(words) - start[-1])
            cols = [known[w] for w in words]
            flat, of = np.concatenate(cols), np.repeat(np.arange(len(words)), [len(c) for c in cols])
            first = np.append(0, np.cumsum([len(c) for c in cols]))[:-1]
            scores = np.add.reduceat(weights[flat], first, axis=0)
            gamma, expected = forward_backward(np.exp(scores - scores.max(1, keepdims=True)), np.array(start), np.array(length), np.exp(move), True)
            labels = np.array(labels)
            gap = -gamma
            gap[np.arange(len(words)), labels] += 1
            slope = np.zeros_like(weights)
            for x in range(n_langs):
                slope[:, x] = np.bincount(flat, gap[of, x], WIDTH)
            slope = slope / CHAINS - 1e-5 * weights
            squares += slope**2
            weights += RATE * slope / np.sqrt(squares)
            seen = np.zeros_like(move)
            inner = np.ones(len(words), bool)
            inner[start] = False
            at = np.flatnonzero(inner)
            np.add.at(seen, (labels[at - 1], labels[at]), 1)
            slope = (seen - expected) / CHAINS
            move_squares += slope**2
            move += RATE * slope / np.sqrt(move_squares)
    return weights.astype(np.float32), move


class Remembered(dict):
    """Word to its row in scores; line breaks have row 0."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights, self.scores = weights, np.zeros((1, weights.shape[1]), np.float32)

    def unknown(self, tokens: list[str]) -> set[str]:
        """The words among tokens that have no scores yet; starts anew where the table has grown too long."""
        if len(self) > REMEMBERED:
            self.clear()
            self.scores = self.scores[:1]
        return {t for t in set(tokens).difference(self) if t[0] != "\n" or self.setdefault(t, 0)}

    def learn(self, words: set[str]) -> None:
        """Scores for new words, so many at once that the lists of their features stay small."""
        new = list(words)
        self.update(zip(new, range(len(self.scores), len(self.scores) + len(new)), strict=True))
        scores = [self.scores]
        for k in range(0, len(new), LEARNED):
            some = new[k : k + LEARNED]
            columns, owners = features(some)
            scores.append(np.stack([np.bincount(owners, self.weights[columns, x], len(some)) for x in range(self.weights.shape[1])], 1).astype(np.float32))
        self.scores = np.concatenate(scores)


def tokenised(texts: list[str], pattern: re.Pattern) -> tuple[list[str], list[int]]:
    """The tokens of all texts, and how many each has."""
    tokens, sizes = [], []
    for t in texts:
        found = pattern.findall(t.lower())
        sizes.append(len(found))
        tokens += found
    return tokens, sizes


def label_words(texts: list[str], known: Remembered, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each word, its distribution over languages) for all words of the texts, in order."""
    tokens, sizes = tokenised(texts, QUICK)
    new = known.unknown(tokens)
    if not all(map(str.isalpha, new)):
        tokens, sizes = tokenised(texts, TOKENS)
        new = known.unknown(tokens)
    known.learn(new)
    rows = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    text = np.repeat(np.arange(len(texts)), sizes)
    word = rows > 0
    line = np.cumsum(~word)[word]
    text, rows = text[word], rows[word]
    if not len(rows):
        return text, np.zeros((0, len(move)))
    new = np.ones(len(rows), bool)
    new[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    scores = known.scores[rows].astype(np.float64)
    gamma, _ = forward_backward(np.exp(scores - scores.max(1, keepdims=True)), start, np.diff(np.append(start, len(rows))), np.exp(move))
    return text, gamma


def training_runs(docs: DataFrame, rows: int = ROWS) -> tuple[list[str], list[tuple[int, list[str]]]]:
    """The languages, and labelled runs of words of a sample of about rows rows of each."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return [], []
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, rows / n))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(drawn < rate[F.col("lang")]).select("doc_id", "lang", "text")

    def cut(batches):
        for batch in batches:
            for _, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = [w for w in TOKENS.findall(text.lower()) if w[0] != "\n"]
                runs = [" ".join(words[k : k + WORDS]) for k in np.unique(np.linspace(0, max(0, len(words) - WORDS), RUNS).astype(int))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(runs)), pa.array(runs)], ["lang", "run"])

    got = sample.mapInArrow(cut, "lang string, run string").toArrow()
    runs = sorted(zip(got.column("lang").to_pylist(), got.column("run").to_pylist(), strict=True))  # the same order whatever the partitions
    return langs, [(langs.index(lang), run.split(" ")) for lang, run in runs if run]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, and the columns of docs named in keep."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    langs, runs = training_runs(rows)
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    plain = [F.col(id_col).alias("doc_id"), held.alias("held_out"), *[F.col(c) for c in keep or []]]
    if not langs:
        return docs.select(*plain, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    weights, move = fit(runs, len(langs))
    model = docs.sparkSession.sparkContext.broadcast((weights, move))  # WIDTH numbers a language
    state: dict = {}

    @F.arrow_udf(PREDICTED)
    def predicted(text: pa.Array) -> pa.Array:
        weights, move = model.value
        if "known" not in state:
            state["known"] = Remembered(weights)
        known = state["known"]
        total = np.zeros((len(text), len(langs)))
        at, held, size = 0, [], 0
        values = text.to_pylist()
        for k, t in enumerate(values):
            held.append(t or "")
            size += len(held[-1])
            if size >= TOGETHER or k == len(values) - 1:
                of, gamma = label_words(held, known, move)
                for x in range(len(langs)):
                    total[at : k + 1, x] = np.bincount(of, gamma[:, x], len(held))
                at, held, size = k + 1, [], 0
        mass = total.sum(1)
        best = total.argmax(1)
        score = np.divide(total[np.arange(len(total)), best], mass, out=np.zeros(len(total)), where=mass > 0)
        names = [langs[b] if m > 0 else "und" for b, m in zip(best.tolist(), mass.tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], ["lang_pred", "score"])

    return docs.select(*plain, predicted(F.col(text_col)).alias("_p")).select("doc_id", "held_out", *(keep or []), "_p.lang_pred", "_p.score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
