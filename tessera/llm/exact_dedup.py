"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of 4,096 bytes. Each chunk is hashed by itself, as a polynomial modulo the prime 2^31-1 in
two lanes with different bases, and the chunks' hashes combine by length-shifted arithmetic,
``H(AB) = H(A) * base^len(B) + H(B)``, so parts of a huge document can be hashed apart and in any grouping
(`combine`). Rows with the same two lanes and length are a group of candidates; one of its rows is the model, and every
other is compared with it, chunk by chunk (`same_text`). Rows that equal the model are its class; the others, if there
are any, choose a model among themselves and are compared again, until none is left. So the comparison alone says what
is equal; SHA-256 is output and decides nothing.

A group may hold any share of the rows: its figures are made of those of salted parts, rows meet the figures of their
part, and a model is sent once to each SLOT of its group's rows.

Defined cases: null text is empty; empty texts equal each other; rows that repeat are members like any others; of
rows with equal texts one stays, that with the largest doc_id (null doc_id is below all; of rows that tie, one; keep_id
is null if all are null); columns other than the two named ones are not read, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import ascii_lower, materialise, slices, table
from tessera.llm.wordscan import LOWER

PRIME = (1 << 31) - 1
BASES = (1_000_003_931, 1_725_636_277)
CHUNK = 4096
COMPARE = 1 << 16
#: Chunks that are hashed at once.
TOGETHER = 64
#: Parts that a group's figures are made of, and rows of a group that share one copy of its model.
SALTS, SLOT = 64, 256
PRINT = T.StructType([T.StructField("lane0", T.LongType()), T.StructField("lane1", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("text_sha256", T.StringType())])


def _powers(base: int) -> np.ndarray:
    out = np.ones(CHUNK + 1, np.uint64)
    for k in range(1, CHUNK + 1):
        out[k] = int(out[k - 1]) * base % PRIME
    return out


POWERS = [_powers(b) for b in BASES]


def combine(left: int, right: int, right_bytes: int, lane: int) -> int:
    """The fingerprint of two neighbouring pieces from the fingerprints of each."""
    return (left * pow(BASES[lane], right_bytes, PRIME) + right) % PRIME


def fingerprints(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Both lanes for each of the texts that lie one after another in buf."""
    sizes = np.diff(off)
    chunks = -(-sizes // CHUNK)
    row = np.repeat(np.arange(len(sizes)), chunks)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = off[:-1][row] + nth * CHUNK
    size = np.minimum(CHUNK, off[1:][row] - start)
    out = [np.zeros(len(sizes), np.uint64) for _ in BASES]
    parts = [np.zeros(len(row), np.uint64) for _ in BASES]
    for at in range(0, len(row), TOGETHER):  # chunks are hashed apart
        s, n = start[at : at + TOGETHER], size[at : at + TOGETHER]
        mine = buf[s[0] : s[-1] + n[-1]].astype(np.uint64) + np.uint64(1)
        left = np.repeat(s - s[0] + n, n) - 1 - np.arange(len(mine))
        for part, powers in zip(parts, POWERS, strict=True):
            part[at : at + TOGETHER] = np.add.reduceat(mine * powers[left], s - s[0]) % np.uint64(PRIME)
    by_nth = np.argsort(nth, kind="stable")
    cut = np.searchsorted(nth[by_nth], np.arange(int(chunks.max()) + 1 if len(row) else 1))
    for lane, part, powers in zip(out, parts, POWERS, strict=True):
        for at in (by_nth[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)):
            lane[row[at]] = (lane[row[at]] * powers[size[at]] + part[at]) % np.uint64(PRIME)
    return out


@F.arrow_udf(PRINT)
def fingerprint(text: pa.Array) -> pa.Array:
    """Lanes, length in bytes and SHA-256 of each text with A-Z lower-cased."""
    lanes, sizes, digests = [[], []], [], []
    for _, buf, off in slices(text):
        low = LOWER[buf]
        for mine, found in zip(lanes, fingerprints(low, off), strict=True):
            mine.append(found)
        sizes.append(np.diff(off))
        whole = memoryview(low)
        digests += [hashlib.sha256(whole[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
    cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return pa.StructArray.from_arrays([pa.array(cat(lanes[0], np.int64)), pa.array(cat(lanes[1], np.int64)), pa.array(cat(sizes, np.int64)), pa.array(digests, pa.string())], ["lane0", "lane1", "n_bytes", "text_sha256"])


def same_text(left: str, right: str) -> Column:
    """Whether two texts agree, compared piece by piece so that the first difference ends it."""
    a, b = (F.col(c).cast("binary") for c in (left, right))
    pieces = F.sequence(F.lit(0), F.floor(F.octet_length(left) / COMPARE).cast("int"))
    piece = lambda x, k: F.substring(x, k * COMPARE + 1, F.lit(COMPARE))
    return (F.octet_length(left) == F.octet_length(right)) & F.forall(pieces, lambda k: piece(a, k) == piece(b, k))


def labelled(prints: DataFrame, key: list[str]) -> DataFrame:
    """prints with keep_id, kept, group_size and model (the least (th, rid)) of the rows that agree on key."""
    salted = prints.withColumn("_salt", F.pmod("rid", F.lit(SALTS)))
    figures = [F.max(F.struct("doc_id", "rid")).alias("top"), F.count("*").alias("group_size"), F.min(F.struct("th", "rid")).alias("model")]
    parts = salted.groupBy(*key, "_salt").agg(*figures)
    whole = parts.groupBy(*key).agg(F.max("top").alias("top"), F.sum("group_size").alias("group_size"), F.min("model").alias("model"))
    figures_of_part = parts.select(*key, "_salt").join(whole, key)
    return salted.join(figures_of_part, [*key, "_salt"]).withColumns({"keep_id": F.col("top.doc_id"), "kept": F.col("rid") == F.col("top.rid")}).drop("_salt", "top")


def compared(texts: DataFrame, key: list[str]) -> DataFrame:
    """texts with same: whether the text equals that of the group's model; texts has rid, group_size, model and _text."""
    slots = F.ceil(F.col("group_size") / SLOT).cast("long")
    models = texts.where(F.col("rid") == F.col("model.rid")).dropDuplicates(key)
    models = models.select(*key, F.col("_text").alias("_model"), F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)).alias("_slot"))
    return texts.withColumn("_slot", F.pmod("rid", slots)).join(models, [*key, "_slot"]).withColumn("same", same_text("_text", "_model")).drop("_slot", "_model")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_bytes, th) of every row of docs; th is a hash of its text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(ascii_lower(F.col(text_col)), F.lit("")).alias("_text")).withColumn("th", F.xxhash64("_text"))
    key, me = ["lane0", "lane1", "n_bytes"], ["doc_id", "th"]
    prints = rows.select(*me, F.monotonically_increasing_id().alias("rid"), fingerprint("_text").alias("p")).select("rid", *me, "p.*")
    prints = materialise(prints, "exact-prints")  # from here on rid is fixed
    out = labelled(prints, key)
    members = out.where("group_size > 1").select("rid", *me, *key, "group_size", "model")
    # rows that repeat id and text are the same to a comparison: one of them is enough
    members = members.groupBy(*me, *key).agg(F.min("rid").alias("rid"), F.first("group_size").alias("group_size"), F.first("model").alias("model"))
    named = [F.col(c).alias(f"_{c}") for c in me]
    same_row = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th"))
    once = members.select(*named, "rid", *key, "group_size", "model")
    texts = materialise(rows.join(once, same_row).drop("_doc_id", "_th"), "exact-members")  # the texts of members only
    told = materialise(compared(texts, key).select("rid", *me, *key, "same").distinct(), "exact-told")
    if not told.where("NOT same").isEmpty():
        out = regrouped(prints, out, texts, told, key)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_bytes", "th")


def regrouped(prints: DataFrame, out: DataFrame, texts: DataFrame, told: DataFrame, key: list[str]) -> DataFrame:
    """out, with the groups whose rows are not all equal cut into classes; a round of comparisons for each class."""
    hit = materialise(told.where("NOT same").select(*key).distinct(), "exact-clashes")
    done, level = told.where("same").join(hit, key, "left_semi").select("doc_id", "th", *key, F.lit(0).alias("_class")), 0
    while not (rest := told.where("NOT same")).isEmpty():
        level += 1
        left = texts.drop("group_size", "model").join(rest.select("rid"), "rid", "left_semi")
        figures = left.groupBy(*key).agg(F.count("*").alias("group_size"), F.min(F.struct("th", "rid")).alias("model"))
        told = materialise(compared(left.join(figures, key), key).select("rid", "doc_id", "th", *key, "same").distinct(), "exact-told")
        done = done.unionByName(told.where("same").select("doc_id", "th", *key, F.lit(level).alias("_class")))
    done = done.select(F.col("doc_id").alias("_doc_id"), F.col("th").alias("_th"), *[F.col(k).alias(f"_{k}") for k in key], "_class")
    match = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("th") == F.col("_th")) & (F.col("lane0") == F.col("_lane0")) & (F.col("lane1") == F.col("_lane1")) & (F.col("n_bytes") == F.col("_n_bytes"))
    finer = prints.join(done, match).select(*prints.columns, "_class")
    return out.join(hit, key, "left_anti").unionByName(labelled(finer, [*key, "_class"]).drop("_class"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = {
    "op5_exact_dedup": """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
""",
}
