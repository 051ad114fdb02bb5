"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. The items' word n-grams are counted over all documents. A bitmap of fixed size (2 MB, whatever the benchmark's size)
   of their hashes lets a scan pass over the n-grams of the documents that cannot be an item's; what passes is joined
   with the n-grams themselves, so false positives of the bitmap cost rows and not results.
2. An item's seeds are its n-grams that are rare on their own: an occurrence counts against an n-gram only if the
   neighbouring n-grams of the text are no item's, so copies of an item, however many, don't make its n-grams common.
   Rare is a count of at most 3 and 1/10,000 of the documents, or to be of the item's rarest half.
3. A second scan cuts, around the seeds that it meets, passages of the items' length to either side, and only those
   passages are shuffled. Each (passage, item) that shares a seed is aligned at word level by Smith-Waterman with
   linear gaps; a pair is a leak if the best local score is at least a share of the score of a full copy.

Defined cases: words are runs of letters and digits in lower case (bytes over 7F count as letters), so case,
punctuation and marks between words don't matter; null and empty texts match nothing; an item with fewer words than an
n-gram is found only as a document's whole text; items without words match nothing; rows that repeat an id are scanned
each and their best score is given; other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import materialise, slices, table
from tessera.llm.wordscan import U, ngrams, word_hashes

SEED = 3
#: An n-gram is rare with so many lone occurrences, and so large a share of the documents; and so is an item's rarest half.
LONE, LONE_SHARE, RARE = 3, 1e-4, 0.5
#: Share of a full copy's score that makes a leak.
LEAST = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Bits of the bitmap, as a power of two.
BITMAP = 24
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """One bit for each hash, by its upper bits; 2^BITMAP bits however many hashes there are."""
    at = f"shiftrightunsigned({column}, {64 - BITMAP})"
    words = hashes.selectExpr(f"{at} >> 5 AS w", f"shiftleft(1L, CAST({at} & 31 AS INT)) AS bit")
    out = np.zeros(1 << (BITMAP - 5), np.uint32)
    got = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy().astype(np.uint32)
    return out


def marked(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = key >> U(64 - BITMAP)
    return (bits[(at >> U(5)).astype(np.int64)] >> (at & U(31)).astype(np.uint32)) & np.uint32(1) == 1


def scanned(column: pa.Array, size: int):
    """(first row, number of rows, words, their rows, n-gram keys, rows and first words) of slices of a column."""
    for at, buf, off in slices(column):
        words, rows, _ = word_hashes(buf, off, SEPARATORS)
        yield (at, len(off) - 1, words, rows, *ngrams(words, rows, len(off) - 1, size))


def item_words(items: DataFrame, size: int) -> DataFrame:
    """(item_id, words, grams) of every item."""
    schema = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("grams", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for at, n, words, rows, key, row, _ in scanned(batch.column(1), size):
                cut = np.searchsorted(rows, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, n),
                    pa.array([words[a:b].view(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.list_(pa.int64())),
                    pa.array([np.unique(key[row == r]).view(np.int64) for r in range(n)], pa.list_(pa.int64())),
                ], schema.fieldNames())

    return items.mapInArrow(run, schema)


def lone_counts(docs: DataFrame, bits: np.ndarray, size: int) -> DataFrame:
    """(gram, docs): in how many rows each n-gram that the bitmap lets through stands without such neighbours.

    A row with gram null has the number of all rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            for _, n, _, _, key, row, first in scanned(batch.column(1), size):
                hit = np.flatnonzero(marked(shared.value, key))
                hit = hit[np.lexsort((first[hit], row[hit]))]
                near = (row[hit][1:] == row[hit][:-1]) & (first[hit][1:] == first[hit][:-1] + 1)
                lone = hit[~(np.append(near, False) | np.append(False, near))] if len(hit) else hit
                pairs = np.unique(np.stack([key[lone], row[lone].astype(np.uint64)], 1), axis=0)
                grams, count = np.unique(pairs[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([*grams.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(count, n))], ["gram", "docs"])

    return docs.mapInArrow(run, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))


def passages(docs: DataFrame, bits: np.ndarray, size: int, reach: int) -> DataFrame:
    """(doc_id, start_word, grams, words): stretches of the documents with reach words to either side of each hit."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start_word", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            for at, n, words, rows, key, row, first in scanned(batch.column(1), size):
                hit = np.flatnonzero(marked(shared.value, key))
                hit = hit[np.lexsort((first[hit], row[hit]))]
                if not len(hit):
                    continue
                low = np.searchsorted(rows, np.arange(n + 1))
                a = np.maximum(first[hit] - reach, low[row[hit]])
                b = np.minimum(first[hit] + size + reach, low[row[hit] + 1])
                new = np.ones(len(hit), bool)
                new[1:] = (row[hit][1:] != row[hit][:-1]) | (a[1:] > np.maximum.accumulate(b)[:-1])
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(hit))
                which = row[hit][begin]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at + which)), pa.array(a[begin] - low[which]),
                    pa.array([np.unique(key[hit[x:y]]).view(np.int64) for x, y in zip(begin, end, strict=True)], pa.list_(pa.int64())),
                    pa.array([words[a[x] : b[y - 1]].view(np.int64) for x, y in zip(begin, end, strict=True)], pa.list_(pa.int64())),
                ], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def local_alignment(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local score of two word sequences and the passage's word after its end."""
    steps = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        diagonal = row[:-1] + np.where(passage == w, MATCH, MISMATCH)
        top = np.maximum(row + GAP, 0)
        top[1:] = np.maximum(top[1:], diagonal)
        row = np.maximum.accumulate(top + steps) - steps  # gaps along the passage
        if (most := int(row.max())) > best:
            best, end = most, int(row.argmax())
    return best, end


def aligned(batches):
    for batch in batches:
        ids, items, starts = (batch.column(k) for k in range(3))
        score, first, last = [], [], []
        for item, passage, at in zip(batch.column(3), batch.column(4), starts.to_pylist(), strict=True):
            x, y = (np.asarray(v.values) for v in (item, passage))
            best, end = local_alignment(x, y)
            _, back = local_alignment(x[::-1], y[:end][::-1])
            score.append(best / (MATCH * len(x)) if len(x) else 0.0)
            first.append(at + end - back)
            last.append(at + end)
        yield pa.RecordBatch.from_arrays([ids, items, pa.array(score, pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())], ["doc_id", "item_id", "score", "first_word", "end_word"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = SEED, rare: float = RARE, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) of every leak: the best alignment of each document and item."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(text_col).alias("text"))
    known = materialise(item_words(items.select(F.col(item_col).cast("long").alias("item_id"), F.lower(item_text_col).alias("text")), size), "items").where("size(words) > 0")
    grams = known.select("item_id", F.explode("grams").alias("gram")).distinct()
    counts = materialise(lone_counts(rows, bitmap(grams, "gram"), size), "lone")
    total = counts.where("gram IS NULL").agg(F.max("docs")).first()[0] or 0
    ranked = grams.join(counts, "gram", "left").select("item_id", "gram", F.coalesce("docs", F.lit(0)).alias("docs"))
    whole = W.partitionBy("item_id")
    ranked = ranked.withColumns({"at": F.row_number().over(whole.orderBy("docs", "gram")), "of": F.count("*").over(whole)})
    seeds = ranked.where((F.col("docs") <= LONE + LONE_SHARE * total) | (F.col("at") <= F.ceil(F.col("of") * rare))).select("item_id", "gram")
    seeds = materialise(seeds, "seeds")
    reach = known.agg(F.max(F.size("words"))).first()[0] or 1
    found = materialise(passages(rows, bitmap(seeds, "gram"), size, int(reach * 1.25) + size).withColumn("passage", F.monotonically_increasing_id()), "passages")
    pairs = found.select("passage", F.explode("grams").alias("gram")).join(seeds, "gram").select("passage", "item_id").distinct()
    jobs = pairs.join(found.drop("grams"), "passage").join(known.select("item_id", F.col("words").alias("item")), "item_id")
    scores = jobs.select("doc_id", "item_id", "start_word", "item", "words").mapInArrow(aligned, "doc_id long, item_id long, score double, first_word long, end_word long")
    best = F.max_by(F.struct("score", "first_word", "end_word"), F.struct("score", -F.col("first_word"))).alias("b")
    return scores.where(F.col("score") >= least).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
