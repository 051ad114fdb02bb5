"""Phrase collocations from a weighted de Bruijn graph of the longest grams.

Nodes are runs of three words, an edge is a run of four, from its first three words to its last three. Only edges are
counted in the texts, and with them what no edge starts from, as at the end of each piece its last three, two and one
words. All shorter counts follow from the flow: a node's count is the sum of the edges that leave it plus the ends in it,
a pair's that of the nodes that it begins plus its own ends, and a word's likewise.

1. Words are counted by hash and language. Those of at least `least` occurrences set bits of a bitmap of fixed size; a
   word whose bit is not set is in no candidate. Of the pairs of neighbours that are left those are counted, and of the
   runs of three whose pairs are left those, each with a bitmap. False positives cost rows and not results.
2. Each word gives the longest run of up to four words from it on that the bitmaps let through: an edge, or an end. Equal
   ones of a slice are summed before they are shuffled.
3. A node that one edge enters and one edge leaves, each as often as the node itself occurs, is unary. Unary paths are
   compacted by pointer doubling into words and one weight, and the counts of their inner nodes are read from them. Such
   a node is no candidate: the edge through it is a longer one with the same count.
4. Candidates are cut in all ways; the parts' counts are joined; the lowest score holds. Candidates inside a longer one
   that is nearly as frequent go.

Defined cases: A-Z become lower case; pieces are cut at `.,;:!?` and 0x0A-0x0D, words at blanks and tabs; null and empty
texts have no words; a null language counts as `und` and is one with it; rows that repeat count each; ids and other
columns are not read; an empty table gives no rows. Arithmetic is exact. Two words of a slice count as equal if 64-bit
hashes of them do; everything after that goes by the words themselves.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.decontaminate import bitmap, marked
from tessera.llm.shared import materialise, slices, table
from tessera.llm.wordscan import LOWER, STEP, U, mix, word_hashes

#: Occurrences of a candidate; longest gram; phrases of each language; percent of its count that drops what a longer one holds.
LEAST, LONGEST, FIRST, INSIDE = 30, 4, 2_000, 80
SCALE = 2_000_000
#: Bytes of text that are read together, and of phrases in one batch; keys that are summed together.
SLICE, STRINGS, KEYS = 1 << 21, 1 << 22, 1 << 22

CUTS = np.zeros(256, bool)
CUTS[[*b".,;:!?\n\x0b\x0c\r"]] = True
SEPARATORS = CUTS.copy()
SEPARATORS[[9, 32]] = True


def by_language(lang: pa.Array, text: pa.Array) -> Iterator[tuple[str, pa.Array]]:
    """The texts of each language of a batch."""
    known = lang.fill_null("und").dictionary_encode()
    codes = known.indices.to_numpy(zero_copy_only=False)
    for k, name in enumerate(known.dictionary.to_pylist()):
        yield name, text.take(pa.array(np.flatnonzero(codes == k)))


def _summed(keys: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The keys in order and how often each comes, for about KEYS of them at a time."""
    held: list[np.ndarray] = []
    for key in itertools.chain(keys, [None]):
        if key is not None:
            held.append(key)
        if held and (key is None or sum(map(len, held)) >= KEYS):
            found = np.unique(np.concatenate(held), return_counts=True)
            held = []
            if len(found[0]):
                yield found


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, word, n): hashes of the words in their language that occur so often; a row with a lang counts all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def keys() -> Iterator[np.ndarray]:
            for lang, buf, off in read_texts(batches):
                words = word_hashes(buf, off, SEPARATORS)[0]
                total[lang] += len(words)
                yield in_language(words, lang)

        for words, n in _summed(keys()):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.string()), pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["lang", "word", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("word").isNull() | (F.col("n") >= least))


def gram_counts(docs: DataFrame, maps: list[np.ndarray], least: int = LEAST) -> DataFrame:
    """(word): hashes of the runs of one word more than maps has bitmaps, that these let through and that occur so often.

    There are many and each is rare, so they are shuffled in blocks: the keys of a range of hashes as 32 bits each with
    their counts, which need no more than least to be told apart. 46 bits of a hash are enough for a bitmap.
    """
    shared = docs.sparkSession.sparkContext.broadcast(maps)  # of fixed size
    kind = np.uint8 if least < 256 else np.uint32

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[np.ndarray]:
            for lang, buf, off in read_texts(batches):
                words, _, allowed = allowed_runs(buf, off, lang, shared.value, len(shared.value) + 1)
                yield run_keys(words, lang, len(allowed))[allowed[-1]] >> U(18)

        for key, n in _summed(keys()):
            ends = np.append(np.flatnonzero(np.diff(key >> U(32))) + 1, len(key))
            starts = np.append(0, ends[:-1])
            low, few = (key & U(0xFFFFFFFF)).astype(np.uint32), np.minimum(n, least).astype(kind)
            blocks = [[part.tobytes() for part in np.split(x, ends[:-1])] for x in (low, few)]
            yield pa.RecordBatch.from_arrays([pa.array((key[starts] >> U(32)).astype(np.int32)), *(pa.array(x, pa.binary()) for x in blocks)], ["part", "low", "n"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frequent(part: int, low: list[bytes], n: list[bytes]) -> np.ndarray:
            keys, at = np.unique(np.frombuffer(b"".join(low), np.uint32), return_inverse=True)
            many = np.bincount(at, np.frombuffer(b"".join(n), kind), len(keys)) >= least
            return ((keys[many].astype(U) + (U(part) << U(32))) << U(18)).view(np.int64)

        rows = ((r["part"], r["low"], r["n"]) for batch in batches for k in range(0, batch.num_rows, 1024) for r in batch.slice(k, 1024).to_pylist())
        for part, held in itertools.groupby(rows, key=lambda r: r[0]):
            _, low, n = zip(*held, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(frequent(part, low, n))], ["word"])

    blocks = docs.select("lang", "text").mapInArrow(cut, "part int, low binary, n binary")
    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(total, "word long")


def read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, bytes, offsets) of slices of the texts (lang, text)."""
    for batch in batches:
        for lang, text in by_language(batch.column(0), batch.column(1)):
            for _, buf, off in slices(text, SLICE):
                yield lang, buf, off


def in_language(words: np.ndarray, lang: str) -> np.ndarray:
    """Hashes of words in a language; languages that share one only let more words through the bitmap."""
    return mix(words ^ U(int.from_bytes(lang.encode()[:8].ljust(8), "big")))


def run_keys(words: np.ndarray, lang: str, size: int) -> np.ndarray:
    """The hash of the run of size words from each word on; near the end it means nothing."""
    key = words
    for k in range(1, size):
        key = key * STEP + np.append(words[k:], np.zeros(min(k, len(words)), U))
    return in_language(key, lang)


def allowed_runs(buf: np.ndarray, off: np.ndarray, lang: str, maps: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(words, starts, for each size up to most: at which words such a run begins inside a piece, of which the bitmaps, one
    for each size from 1 on, let every part through)."""
    words, rows, start = word_hashes(buf, off, SEPARATORS)
    piece = np.cumsum(CUTS[buf])[start] if len(words) else start
    together = np.append((rows[1:] == rows[:-1]) & (piece[1:] == piece[:-1]), np.zeros(min(1, len(words)), bool))
    allowed = []
    for size in range(1, most + 1):
        now = np.ones(len(words), bool) if size == 1 else allowed[-1] & np.append(allowed[-1][1:], np.zeros(min(1, len(words)), bool))
        if size == 2:
            now &= together
        if size <= len(maps):
            now &= marked(maps[size - 1], run_keys(words, lang, size))
        allowed.append(now)
    return words, start, allowed


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the given stretches one after another, and the offsets of the stretches."""
    off = np.concatenate([[0], np.cumsum(size)])
    kind = np.int32 if max(off[-1], len(data)) < 1 << 31 else np.int64
    at = np.repeat((start - off[:-1]).astype(kind), size)
    at += np.arange(off[-1], dtype=kind)
    return data[at], off


def grams_of(buf: np.ndarray, off: np.ndarray, lang: str, maps: list[np.ndarray]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(size, phrases, occurrences): from each word that the bitmaps let through, the longest run of up to LONGEST words
    that they let through: an edge, or the end of what can be in a candidate."""
    words, start, allowed = allowed_runs(buf, off, lang, maps, LONGEST)
    held = np.flatnonzero(allowed[0])
    if not len(held):
        return
    low = LOWER[buf]
    after = np.append(start[1:], len(buf))
    outside = np.concatenate([[0], np.cumsum(SEPARATORS[low], dtype=np.int64)])
    size = after - start - (outside[after] - outside[start])  # a word ends at the first separator or with its text
    words, allowed = words[held], [x[held] for x in allowed]
    text, at = _gather(np.append(low, np.uint8(32)), start[held], size[held] + 1)
    text[at[1:] - 1] = 32  # single spaces, whatever stood there
    for k in range(1, LONGEST + 1):
        first = np.flatnonzero(allowed[k - 1] & ~allowed[k] if k < LONGEST else allowed[k - 1])
        if not len(first):
            continue
        key = run_keys(words, lang, k)
        _, which, inverse, count = np.unique(key[first], return_index=True, return_inverse=True, return_counts=True)
        model = first[which]
        wrong = np.zeros(len(first), bool)  # another gram with the same hash is a row of its own
        for j in range(k):
            wrong |= words[first + j] != words[model[inverse] + j]
        if wrong.any():
            count = count - np.bincount(inverse[wrong], minlength=len(count))
            model, count = np.concatenate([model, first[wrong]]), np.concatenate([count, np.ones(wrong.sum(), np.int64)])
        long = at[model + k] - 1 - at[model]
        part = np.cumsum(long) // STRINGS
        for cut in np.split(np.arange(len(model)), np.flatnonzero(np.diff(part)) + 1):
            data, ends = _gather(text, at[model[cut]], long[cut])
            yield k, pa.StringArray.from_buffers(len(cut), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)), count[cut]


def edges_and_ends(docs: DataFrame, maps: list[np.ndarray]) -> DataFrame:
    """(lang, size, gram, n): edges (size LONGEST) and ends of fewer words, summed."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, buf, off in read_texts(batches):
            for size, grams, n in grams_of(buf, off, lang, shared.value):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), size, np.int32)), grams, pa.array(n.astype(np.int64))], ["lang", "size", "gram", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


def first(gram: str, k: int) -> Column:
    return F.substring_index(gram, " ", k)


def last(gram: str, k: int) -> Column:
    return F.substring_index(gram, " ", -k)


def flow(grams: DataFrame, size: int, least: int) -> DataFrame:
    """(lang, gram, n, out): counts of the grams of size words: what leaves them as edges and what ends in them. out is
    the most frequent of those edges, 0 if all ends."""
    rows = grams.where(F.col("size") >= size).select("lang", first("gram", size).alias("gram"), "n", F.when(F.col("size") > size, F.col("n")).otherwise(0).alias("out"))
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.max("out").alias("out")).where(F.col("n") >= least)


def compact(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(lang, words, n): maximal paths of edges whose inner nodes are unary, each with its one weight.

    An edge whose first node is unary points to the edge before it; pointers double until all reach the first edge of
    their path. At every round each edge is pointed to once at most, so no key is hot. A text has a start, so unary
    nodes alone make no cycle. A path lies in one piece, so its list is no longer than a text.
    """
    entering = edges.groupBy("lang", last("gram", LONGEST - 1).alias("gram")).agg(F.max("n").alias("into"), F.max_by("gram", "n").alias("before"))
    unary = nodes.join(entering, ["lang", "gram"]).where((F.col("into") == F.col("n")) & (F.col("out") == F.col("n"))).select("lang", F.col("gram").alias("head"), "before")
    state = edges.withColumn("head", first("gram", LONGEST - 1)).join(unary, ["lang", "head"], "left")
    state = state.select("lang", "gram", "n", F.coalesce("before", "gram").alias("up"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("long").alias("at"), F.col("before").isNull().alias("done"))
    state = materialise(state, "path-edges")
    while not state.where("NOT done").isEmpty():
        above = state.select("lang", F.col("gram").alias("up"), F.col("up").alias("_up"), F.col("at").alias("_at"), F.col("done").alias("_done"))
        moved = state.where("NOT done").join(above, ["lang", "up"]).select("lang", "gram", "n", F.col("_up").alias("up"), (F.col("at") + F.col("_at")).alias("at"), F.col("_done").alias("done"))
        state = materialise(state.where("done").unionByName(moved), "path-edges")
    ends = F.transform(F.sort_array(F.collect_list(F.struct("at", last("gram", 1).alias("w")))), lambda x: x["w"])
    paths = state.groupBy("lang", "up").agg(F.max("n").alias("n"), ends.alias("ends"))
    return paths.select("lang", F.concat(F.split(first("up", LONGEST - 1), " "), "ends").alias("words"), "n")


def stretches(paths: DataFrame, size: int, inner: bool) -> DataFrame:
    """(lang, gram, n) of all runs of size words in paths; of those that begin and end inside them only, with inner."""
    skip = 1 if inner else 0
    many = F.size("words") - size + 1 - 2 * skip
    starts = F.when(many > 0, F.sequence(F.lit(1 + skip), many + skip)).otherwise(F.array().cast("array<int>"))
    return paths.select("lang", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, size), " "))).alias("gram"), "n")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((lang, n of all words), compacted paths, (lang, size, gram, n, inner)): the counts of all runs of up to LONGEST
    words with least occurrences in pieces; inner marks unary nodes."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = materialise(word_counts(docs, least), "word-counts")
    totals = words.where("word IS NULL").select("lang", F.col("n").alias("total"))
    maps = [bitmap(words.where("word IS NOT NULL"), "word")]
    while len(maps) < LONGEST - 1:
        maps.append(bitmap(gram_counts(docs, maps, least), "word"))
    grams = materialise(edges_and_ends(docs, maps), "edges")
    edges = materialise(grams.where((F.col("size") == LONGEST) & (F.col("n") >= least)).select("lang", "gram", "n"), "frequent-edges")
    short = [flow(grams, k, least).withColumn("size", F.lit(k)) for k in range(1, LONGEST)]
    nodes = materialise(short[0].unionByName(short[1]).unionByName(short[2]), "nodes")
    paths = materialise(compact(edges, nodes.where(F.col("size") == LONGEST - 1)), "paths")
    inner = stretches(paths, LONGEST - 1, True).withColumns({"size": F.lit(LONGEST - 1), "inner": F.lit(True)})
    others = nodes.join(inner.select("lang", "gram"), ["lang", "gram"], "left_anti").select("lang", "gram", "n", "size", F.lit(False).alias("inner"))
    whole = stretches(paths, LONGEST, False).withColumns({"size": F.lit(LONGEST), "inner": F.lit(False)})
    return totals, paths, materialise(others.unionByName(inner).unionByName(whole), "phrase-counts")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): phrases of 2 to LONGEST words with least occurrences a, without those inside a
    longer one that has inside percent of their count; l and r are the counts of the two parts of the lowest cut."""
    totals, _, counts = phrase_counts(docs, least)
    found = counts.where(~F.col("inner") & (F.col("size") >= 2)).select("lang", "gram", "size", F.col("n").alias("a"))
    cut = found.select("lang", "gram", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumns({"left": F.expr("substring_index(gram, ' ', k)"), "right": F.expr("substring_index(gram, ' ', k - size)")})
    part = lambda side, count: counts.select("lang", F.col("gram").alias(side), F.col("n").alias(count))
    cut = cut.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0)) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = cut.groupBy("lang", "gram", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    longer = found.where("size > 2").select("lang", "gram", "size", F.col("a").alias("over"))
    held = longer.select("lang", "over", F.split("gram", " ").alias("w"), F.explode(F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> named_struct('i', i, 'm', m))))")).alias("x"))
    held = held.select("lang", F.array_join(F.slice("w", F.col("x.i"), F.col("x.m")), " ").alias("gram"), "over").groupBy("lang", "gram").agg(F.max("over").alias("over"))
    wide = "CAST({} AS DECIMAL(20, 0)) * {}"
    stay = F.col("over").isNull() | F.expr(f"{wide.format('over', 100)} < {wide.format('a', inside)}")
    kept = scored.join(held, ["lang", "gram"], "left").where(stay)
    return kept.join(F.broadcast(totals), "lang").select("lang", F.col("gram").alias("phrase"), "a", "cut.l", "cut.r", F.col("total").alias("n"), "cut.score")  # a row for each language


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(table(spark, sf_dir, "documents")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FIRST)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = {
    "op13_collocations": r"""
WITH low AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?
-
]')), '[^ 	]+') AS ws FROM low),
pieces AS MATERIALIZED (SELECT lang, ws, len(ws) AS m FROM piece WHERE len(ws) > 0),
gram AS (SELECT lang, k, array_to_string(ws[i + 1 : i + k], ' ') AS g FROM (SELECT lang, ws, k, unnest(range(0, m - k + 1)) AS i FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE m >= k)),
cnt AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM gram GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(m)::BIGINT AS n FROM pieces GROUP BY lang),
cand AS (SELECT *, string_split(g, ' ') AS ws FROM cnt WHERE k > 1),
cut AS (SELECT c.lang, c.k, c.g, c.f AS a, j, x.f AS l, y.f AS r, (2000000::HUGEINT * c.f) // (x.f + y.f) AS s
    FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c JOIN cnt x ON x.lang = c.lang AND x.g = array_to_string(ws[1 : j], ' ') JOIN cnt y ON y.lang = c.lang AND y.g = array_to_string(ws[j + 1 :], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY s, j) = 1),
held AS (SELECT lang, array_to_string(ws[i + 1 : i + m], ' ') AS g, max(f) AS o FROM (SELECT lang, ws, f, m, unnest(range(0, k - m + 1)) AS i FROM cand, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, s::BIGINT AS score
FROM best LEFT JOIN held USING (lang, g) JOIN total USING (lang) WHERE o IS NULL OR 100 * o < 80 * a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY s DESC, a DESC, g) <= 2000"""
}
