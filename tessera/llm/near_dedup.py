"""Near-duplicate detection with HyperMinHash sketches.

A document's set holds its distinct word shingles. A hash of each shingle picks one of 256 buckets by its upper 8
bits; the least of the other 56 bits in a bucket is stored as a 16-bit register: the number of leading zeros (6 bits)
and the 10 bits of mantissa after the leading one. A bucket that no shingle falls in is filled by the least of
bucket-specific hashes of the whole set, so short texts have full sketches, too.

1. Rows with equal sets become one node (grouped by a 128-bit key of the set, partial aggregates first).
2. 42 bands of 6 registers give band keys. Every node of a bucket is paired with the bucket's first node only, so a
   bucket of n nodes gives n - 1 pairs. Pairs pass a bound on set sizes and the collision-corrected Jaccard estimate of
   their registers, and are then confirmed on the full sets, recomputed from the whole texts.
3. Confirmed links are joined into components. Nodes that share a bucket share its first node, so the nodes that meet
   any first node of a component are a group that holds all candidate pairs of those buckets. The group's nodes
   outside the component are then compared with those inside and with each other, in blocks of about 1,024 nodes. The
   registers of two blocks say by the corrected estimate which parts of them (of 128 nodes and 4 MB of text) hold pairs
   that may be linked; only the texts of nodes in such pairs are sent, and a task computes the intersections of all
   full sets of two parts as products of 0/1 matrices and gives back only links between components. No candidate that
   could join two components is left out, and no table of pairs is made.

A pair at the threshold 0.85 shares no band with probability (1 - 0.85^6)^42 = 2e-9; at 0.8, 3e-6.

Defined cases: null and empty texts and texts without words have n_shingles 0 and are linked with nothing; a text
with fewer words than a shingle is one shingle; rows that repeat are copies; rows that repeat a doc_id with another
text count as one document; a null doc_id is no label: such a row takes its group's, or null; other columns are not
read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import connected_components
from tessera.llm.shared import materialise, slices, spread_join, table
from tessera.llm.wordscan import STEP, U, mix, ngrams, word_hashes

BUCKETS = 256
MANTISSA = 10
BANDS, BAND_SIZE = 42, 6
#: Standard errors of the estimate that a true pair may fall below the threshold.
SLACK = 5.0
#: Nodes of a group whose registers are compared with those of as many others in one task.
BLOCK = 1024
#: Nodes and bytes of text whose full sets are compared with as many others in one task.
PART, PART_BYTES = 128, 4 << 20

_rng = np.random.default_rng(7)
SEEDS = _rng.integers(1, 2**63, BUCKETS, dtype=np.uint64)
BAND_SEEDS = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)
SKETCH = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("registers", T.BinaryType()),
])


def register(least: np.ndarray) -> np.ndarray:
    """Leading zeros of 56-bit values and the mantissa after the leading one, in 16 bits."""
    least = least & U((1 << 56) - 1)
    top = least.copy()
    for s in (1, 2, 4, 8, 16, 32):
        top |= top >> U(s)
    width = np.bitwise_count(top).astype(np.int64)
    rest = least & (top >> U(1))  # without the leading one
    up = np.maximum(width - 1 - MANTISSA, 0).astype(np.uint64)
    down = np.maximum(MANTISSA + 1 - width, 0).astype(np.uint64)
    return (((U(56) - width.astype(np.uint64)) << U(MANTISSA)) | ((rest >> up) << down)).astype(np.uint16)


def distinct(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, key) pairs ordered by row and key."""
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], row[new]


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    words, rows, _ = word_hashes(buf, off)
    key, row, _ = ngrams(words, rows, len(off) - 1, size)
    return distinct(key, row)


def sketches(key: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Registers of n sets, given as ordered distinct (row, key) pairs."""
    bucket = (key >> U(56)).astype(np.int64)
    first = np.ones(len(key), bool)
    first[1:] = (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])
    least = np.zeros((n, BUCKETS), np.uint64)
    filled = np.zeros((n, BUCKETS), bool)
    least[row[first], bucket[first]] = key[first]
    filled[row[first], bucket[first]] = True
    start = np.searchsorted(row, np.arange(n + 1))
    for r in np.flatnonzero((start[1:] > start[:-1]) & ~filled.all(1)):
        empty = np.flatnonzero(~filled[r])
        value = (key[start[r] : start[r + 1], None] ^ SEEDS[empty]) * STEP
        value ^= value >> U(29)
        value *= U(0xBF58476D1CE4E5B9)
        least[r, empty] = value.min(0) >> U(8)
    return register(least)


def sketch_rows(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, buf, off in slices(batch.column(1)):
                n = len(off) - 1
                key, row = shingle_sets(buf, off, size)
                count = np.bincount(row, minlength=n)
                start = np.append(np.cumsum(count) - count, len(key))[:-1]
                sums = []
                for s in (U(0x51ED270B4F1C6D2B), U(0x2545F4914F6CDD1D)):
                    total = np.zeros(n, np.uint64)
                    if len(key):
                        has = count > 0
                        total[has] = np.add.reduceat(mix(key ^ s), start[has])
                    sums.append(mix(total + count.astype(np.uint64)).view(np.int64))
                regs = sketches(key, row, n)
                blobs = [r.tobytes() if c else None for r, c in zip(regs, count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(count), pa.array(np.diff(off)), pa.array(sums[0]), pa.array(sums[1]), pa.array(blobs, pa.binary())], SKETCH.fieldNames())

    return run


def registers_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def band_rows(batches):
    for batch in batches:
        ids, n = batch.column(0), batch.num_rows
        if not n:
            continue
        regs = registers_of(batch.column(1))
        keys = []
        for b in range(BANDS):
            h = np.full(n, BAND_SEEDS[b], np.uint64)
            for k in range(b * BAND_SIZE, (b + 1) * BAND_SIZE):
                h = mix(h * STEP + regs[:, k])
            keys.append(h.view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.concat_arrays([ids] * BANDS)], ["band", "node"])


def collision_rate(n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """The probability that registers of unrelated sets agree.

    A bucket's least value is near exponential with the number of its members as rate; two independent ones land in the
    same register with probability sum over registers of p_left * p_right. For equal rates that is close to
    2^-MANTISSA / (4 ln 2) whatever the rate; it only shrinks where the rates differ.
    """
    ratio = np.minimum(n_left, n_right) / np.maximum(np.maximum(n_left, n_right), 1)
    return ratio / (1 + ratio) ** 2 * 2.0**-MANTISSA / np.log(2)


def jaccard_estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Share of equal registers, less the share expected from collisions."""
    share = (left == right).mean(1)
    c = collision_rate(n_left, n_right)
    return np.clip((share - c) / (1 - c), 0, 1)


def estimated(threshold: float):
    """Keeps the pairs whose estimate does not rule the threshold out."""
    least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / BUCKETS)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = [batch.column(k).to_numpy() for k in (2, 4)]
                keep = jaccard_estimate(registers_of(batch.column(3)), registers_of(batch.column(5)), *n) >= least
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def confirmed(size: int, percent: int):
    """Keeps the pairs with 100 * intersection >= percent * union on the full sets of the whole texts."""

    def run(batches):
        for batch in batches:
            sets: list[list[np.ndarray]] = [[], []]
            for side, column in enumerate((2, 3)):
                for _, buf, off in slices(batch.column(column)):
                    key, row = shingle_sets(buf, off, size)
                    cut = np.searchsorted(row, np.arange(len(off)))
                    sets[side] += [key[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            keep = []
            for x, y in zip(*sets, strict=True):
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared) and len(both) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def parts_of(n_bytes: np.ndarray) -> np.ndarray:
    """The number of the part of each node: PART nodes and PART_BYTES bytes at most, or one longer text."""
    part, nodes, held = np.zeros(len(n_bytes), np.int64), 0, 0
    for k, n in enumerate(n_bytes.tolist()):
        if k and (nodes == PART or held + n > PART_BYTES):
            part[k:] += 1
            nodes = held = 0
        nodes, held = nodes + 1, held + n
    return part


def promising(threshold: float, percent: int):
    """(task, node, label): the nodes of two blocks of a group that are in a pair of different labels whose estimate does
    not rule the threshold out, by pairs of parts."""
    least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / BUCKETS)

    def run(group: pa.Table) -> pa.Table:
        hub, low, high = (group.column(k)[0].as_py() for k in ("hub", "low", "high"))
        node, label, block, n, size = (group.column(k).to_numpy() for k in ("node", "label", "part", "n", "n_bytes"))
        regs = registers_of(group.column("registers"))
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        other, mine, ids = regs[right], parts_of(size[left]), parts_of(size[right])
        first = np.flatnonzero(np.diff(ids, prepend=-1)) if len(right) else np.zeros(0, np.int64)
        out = []
        for part in range(int(mine[-1]) + 1 if len(left) and len(right) else 0):
            rows = left[mine == part]
            near = np.zeros((len(rows), len(right)), bool)
            for k, r in enumerate(rows):
                share = (regs[r] == other).mean(1)
                c = collision_rate(n[r], n[right])
                near[k] = (share - c) / (1 - c) >= least
            near &= (label[rows, None] != label[right]) & (100 * np.minimum(n[rows, None], n[right]) >= percent * np.maximum(n[rows, None], n[right]))
            if low == high:
                near &= node[rows, None] < node[right]
            for k, at in enumerate(first):
                cut = near[:, at : first[k + 1] if k + 1 < len(first) else len(right)]
                a, b = rows[cut.any(1)], right[at : at + cut.shape[1]][cut.any(0)]
                if len(a):
                    both = np.unique(np.concatenate([a, b]))
                    out.append((np.full(len(both), part * len(first) + k), node[both], label[both]))
        part, node, label = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        same = lambda value, kind: pa.array(np.full(len(node), value), kind)
        return pa.table({"hub": same(hub, pa.int64()), "low": same(low, pa.int64()), "high": same(high, pa.int64()), "part": part, "node": node, "label": label})

    return run


def compared(size: int, percent: int):
    """The links between nodes of different labels, by their full sets."""

    def run(group: pa.Table) -> pa.Table:
        node, label = (group.column(k).to_numpy() for k in ("node", "label"))
        keys, rows, at = [], [], 0
        for _, buf, off in slices(group.column("text")):
            key, row = shingle_sets(buf, off, size)
            keys.append(key)
            rows.append(row + at)
            at += len(off) - 1
        key, row = np.concatenate(keys), np.concatenate(rows)
        n = np.bincount(row, minlength=len(node))
        _, column, times = np.unique(key, return_inverse=True, return_counts=True)
        some = times[column] > 1
        _, column = np.unique(column[some], return_inverse=True)
        row = row[some]
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        shared = np.zeros((len(node), len(node)), np.float32)
        columns = int(column[-1]) + 1 if len(column) else 0
        width = max(1, min(columns, (1 << 23) // max(1, len(node))))
        for low in range(0, columns, width):
            a, b = np.searchsorted(column, [low, low + width])
            has = np.zeros((len(node), width), np.float32)
            has[row[a:b], column[a:b] - low] = 1
            shared += has @ has.T
        shared = shared.astype(np.int64)
        a, b = np.nonzero((100 * shared >= percent * (n[:, None] + n[None] - shared)) & (label[:, None] != label[None]) & (node[:, None] < node[None]))
        return pa.table({"a": node[a], "b": node[b]})

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, links) of every row of docs.

    component_id is the least doc_id that links reach, kept is true for that row, links counts the confirmed links that
    the row's set was found with.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    all_rows = materialise(rows.mapInArrow(sketch_rows(shingle), SKETCH), "near-sketches")
    key = ["set_a", "set_b"]
    nodes = all_rows.where("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node")).where("node IS NOT NULL")
    nodes = materialise(nodes, "near-nodes")
    own = all_rows.where("n_shingles > 0").join(nodes, key).where("doc_id = node").select("node", F.col("n_shingles").alias("n"), "n_bytes", "registers").dropDuplicates(["node", "n", "registers"])
    own = materialise(own, "near-own")
    bands = own.select("node", "registers").mapInArrow(band_rows, "band long, node long")
    firsts = bands.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("_last")).where("first < _last").drop("_last")
    buckets = materialise(bands.join(firsts, "band"), "near-buckets")

    members = buckets.select("node").distinct()
    texts = rows.join(members.select(F.col("node").alias("doc_id")), "doc_id").select(F.col("doc_id").alias("node"), "text")
    texts = materialise(texts, "near-texts")
    first_pairs = buckets.where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    left, right = (own.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}")) for s in "ab")
    sized = first_pairs.join(left, "a").join(right, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    near = sized.select("a", "b", "n_a", "r_a", "n_b", "r_b").mapInArrow(estimated(percent / 100), "a long, b long").distinct()
    x, y = (texts.select(F.col("node").alias(s), F.col("text").alias(f"t_{s}")) for s in "ab")
    stars = near.join(x, "a").join(y, "b").select("a", "b", "t_a", "t_b").mapInArrow(confirmed(shingle, percent), "a long, b long").distinct()
    stars = materialise(stars, "near-stars")
    labels = connected_components(stars, "a", "b")

    own_label = labels.withColumnRenamed("label", "_own")
    hub_label = labels.select(F.col("node").alias("first"), F.col("label").alias("_hub"))
    grouped = buckets.select("first", "node").join(own_label, "node", "left").join(hub_label, "first", "left")
    grouped = grouped.select(F.coalesce("_hub", "first").alias("hub"), "node", F.coalesce("_own", "node").alias("label")).distinct()
    grouped = materialise(grouped.withColumn("inside", F.col("hub") == F.col("label")), "near-groups")
    count = lambda inside: F.ceil(F.sum(F.when(F.col("inside") == inside, 1).otherwise(0)) / BLOCK).cast("long")
    open_groups = grouped.groupBy("hub").agg(count(True).alias("_in"), count(False).alias("_out")).where("_out > 0")
    rows_of = spread_join(grouped, open_groups, "hub", "node").withColumn("_slot", F.pmod(F.xxhash64("node"), F.when(F.col("inside"), F.col("_in")).otherwise(F.col("_out"))))
    meet = lambda low, high: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>"))
    # blocks inside the hub's component have numbers below 0 and are compared with blocks outside only
    with_out = F.transform(upto("_out"), lambda k: F.when(F.col("inside"), meet(-1 - F.col("_slot"), k)).otherwise(meet(F.least("_slot", k), F.greatest("_slot", k))))
    with_in = F.when(F.col("inside"), F.array().cast("array<struct<low:bigint,high:bigint>>")).otherwise(F.transform(upto("_in"), lambda k: meet(-1 - k, F.col("_slot"))))
    blocks = rows_of.join(own, "node").select("hub", "node", "label", "n", "n_bytes", "registers", F.when(F.col("inside"), -1 - F.col("_slot")).otherwise(F.col("_slot")).alias("part"), F.inline(F.concat(with_out, with_in)))
    tasks = blocks.groupBy("hub", "low", "high").applyInArrow(promising(percent / 100, percent), "hub long, low long, high long, part long, node long, label long")
    tasks = materialise(tasks, "near-tasks")
    across = tasks.join(texts, "node").groupBy("hub", "low", "high", "part").applyInArrow(compared(shingle, percent), "a long, b long").distinct()
    links = stars.unionByName(materialise(across, "near-across"))
    labels = connected_components(links, "a", "b")

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    ends = nodes.join(labels, "node", "left").join(degree, "node", "left").select(*key, F.coalesce("label", "node").alias("_label"), F.coalesce("links", F.lit(0)).alias("_links"))
    out = all_rows.select("doc_id", "n_shingles", *key).join(ends, key, "left")
    alone = F.col("n_shingles") == 0
    return out.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("_label")).alias("component_id"),
        F.when(alone, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("_label"))).alias("kept"),
        F.coalesce("_links", F.lit(0)).alias("links"),
    )


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = {
    "op3_hyperminhash": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT f.b, r.label FROM r JOIN f ON r.node = f.a),
m AS (SELECT node, min(label) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m ON node = doc_id LEFT JOIN n USING (doc_id)
""",
}
