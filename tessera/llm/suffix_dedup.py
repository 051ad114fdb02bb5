"""Repeated byte strings by distributed prefix doubling over sampled suffixes.

A byte goes if a string of `least` (50) bytes that covers it also starts in a document with a smaller id. Spark sorts
(position, rank) pairs at growing lengths and drops the positions whose rank has become unique:

* Whole texts. A text that equals one with a smaller id goes as a whole and is not ranked any further.
* 16 bytes. Every string of 50 bytes is represented by the least 16-byte string in it (least by a hash, then leftmost),
  its anchor: two equal strings have the same anchor at the same place. Only anchors are ranked, about one in eighteen
  positions, and those of one document only are dropped. Neighbouring positions with one anchor form a run.
* The whole run. A run that a smaller document has, too, is decided at once (all of it goes), and so is one whose
  anchor no smaller document has (all of it stays).
* 43 bytes. By how many of its bytes lie before the anchor, a string of 50 bytes is of one of five classes, and all
  strings of a class contain the same stretch of at least 43 bytes around the anchor. Classes of a run whose stretch no
  other document has are dropped.
* 32 and 50 bytes. For what is left, the rank of 32 bytes at a position is made of the ranks of 16 bytes there and 16
  further on, and the rank of 50 bytes is the pair of ranks of 32 bytes there and 18 further on. Spark makes both and
  sorts the pairs.

Ranks are names, not ordinals: 64-bit hashes that all tasks agree on without a global order. A run is compared by 128
bits, a position by the pair of its ranks. Texts are shuffled once; the later joins with them have the same exchange.

Defined cases: null text is empty; texts shorter than 50 bytes lose nothing; matches inside one document don't count;
rows that repeat an id are texts of one document (they don't match each other), each with removals of its own; a null
id is no document's lesser and loses nothing; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import slices, table
from tessera.llm.wordscan import BYTE_CODES, STEP, U, mix, powers

ANCHOR, LEAST, CLASSES = 16, 50, 5
#: Bits of a class's name that a run carries; they only prune.
SIDE = 12
#: Bytes that are hashed together, so that the arrays stay in a core's cache.
PIECE = 1 << 16
CODES = (BYTE_CODES >> U(32)).astype(np.uint32) | np.uint32(1)
SMALL = np.uint32(0x9E3779B1)
#: A run and its last string end so many bytes after its start at most.
MARGIN = 256
FORTH, BACK = powers(PIECE + MARGIN + 1), powers(PIECE + MARGIN + 1, U(pow(int(STEP), -1, 1 << 64)))
#: Parts that the figures of equal texts are made of.
SALTS = 64
#: Columns that name a text; th only where ids repeat.
KEY = ["doc", "th"]


def order_hash(buf: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 16 bytes at each position, by doubling; it only says which anchor is least."""
    part, width, power = CODES[buf], 1, SMALL
    while width < ANCHOR:
        part = part[:-width] * power + part[width:]
        width *= 2
        power = np.uint32(int(power) ** 2 & 0xFFFFFFFF)
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        part ^= part >> np.uint32(shift)
        part *= np.uint32(factor)
    return part ^ (part >> np.uint32(16))


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each size neighbouring values."""
    out, width = values, 1
    while width < size:
        step = min(width, size - width)
        out = np.minimum(out[:-step], out[step:])
        width += step
    return out


def ranks(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the 16 bytes at each of these positions."""
    two = np.ascontiguousarray(sliding_window_view(buf, ANCHOR)[at]).view(np.uint64)
    return mix(mix(two[:, 0] + STEP) * STEP + two[:, 1])


class Runs:
    """The runs of start positions of the texts in buf: row, first position in it, length, anchor's position and name."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, least: int):
        self.buf, self.off = buf, off
        window = least - ANCHOR + 1
        # a run begins at a text's first position, and where its last usable one is passed
        edges = np.unique(np.concatenate([off[:-1], np.maximum(off[:-1], off[1:] - least + 1)]))
        starts, sizes, places = [], [], []
        for at in range(0, max(0, len(buf) - least + 1), PIECE):
            n = min(PIECE, len(buf) - least + 1 - at)  # strings that start in this piece
            h = order_hash(buf[at : at + n + least - 1])
            low = sliding_least(h, window)
            new = np.ones(n, bool)
            # the anchor changes where a lesser one comes in sight and where it was the position just passed
            new[1:] = (low[1:] < low[:-1]) | (h[: n - 1] == low[:-1])
            a, b = np.searchsorted(edges, (at, at + n))
            new[edges[a:b] - at] = True
            head = np.flatnonzero(new)
            starts.append(head + at)
            sizes.append(np.diff(np.append(head, n)))
            places.append(head + at + (sliding_window_view(h, window)[head] == low[head, None]).argmax(1))
        start, size, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, sizes, places))
        row = np.searchsorted(off, start, "right") - 1
        usable = start + least <= off[row + 1]
        row, start, size, place = (x[usable] for x in (row, start, size, place))
        new = np.ones(len(row), bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])  # pieces cut runs
        head = np.flatnonzero(new)
        self.row, self.start, self.place = row[head], start[head], place[head]
        self.size = np.add.reduceat(size, head) if len(head) else size
        self.name = ranks(buf, self.place) if len(head) else np.zeros(0, U)

    def between(self, *bounds: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """For each pair of arrays, names of the bytes from the one position to before the other, both inside the run's
        strings: running sums of code * step^-position, scaled to the first position. Runs are in the order of buf."""
        out = [np.zeros(len(self.start), U) for _ in bounds]
        for at in range(0, len(self.buf), PIECE):
            i, j = np.searchsorted(self.start, (at, at + PIECE))
            if i < j:
                piece = self.buf[at : at + PIECE + MARGIN]
                total = np.zeros(len(piece) + 1, U)
                np.cumsum(BYTE_CODES[piece] * BACK[: len(piece)], out=total[1:])
                for names, (a, b) in zip(out, bounds, strict=True):
                    first = a[i:j] - at
                    names[i:j] = (total[b[i:j] - at] - total[first]) * FORTH[first]
        return out

    def wholes(self, least: int) -> np.ndarray:
        """Names of the runs' bytes, with their sizes and the places of their anchors."""
        inner = (self.place - self.start).astype(np.uint64)
        return mix(self.between((self.start, self.start + self.size + least - 1))[0] + self.size.astype(np.uint64) + inner * U(1 << 32))

    def take(self, keep: np.ndarray) -> Runs:
        for k in ("row", "start", "size", "place", "name"):
            setattr(self, k, getattr(self, k)[keep])
        return self


def anchors(least: int):
    """(anchor and key): the distinct anchors of each text."""

    def run(batches):
        for batch in batches:
            for at, buf, off in slices(batch.column("text")):
                r = Runs(buf, off, least)
                if not len(r.row):
                    continue
                key = pair_key(r.name, r.row)
                order = np.argsort(key)
                new = np.ones(len(key), bool)
                new[1:] = key[order][1:] != key[order][:-1]
                once = np.sort(order[new])  # rows of one text stay together
                name = r.name[once] >> U(16) << U(16)  # 48 bits find the anchors to look at; more decide
                yield made(["anchor"], [name], batch, at + r.row[once])

    return run


def keys(columns: list[str]) -> list[str]:
    return [k for k in KEY if k in columns]


def made(names: list[str], columns: list[np.ndarray], batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch:
    """A batch of new columns and the keys of the rows that they come from."""
    take = pa.array(rows)
    arrays = [c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns]
    return pa.RecordBatch.from_arrays([*arrays, *(batch.column(k).take(take) for k in keys(batch.schema.names))], [*names, *keys(batch.schema.names)])


def flat(column: pa.Array, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The values of n lists and the list of each."""
    part = column.slice(at, n)
    sizes = np.array([len(x) for x in part], np.int64) if part.null_count else np.diff(part.offsets.to_numpy())
    return part.flatten(), np.repeat(np.arange(n), sizes)


def pair_key(name: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(name + row.astype(np.uint64) * STEP)


def classes(least: int) -> list[tuple[int, int]]:
    """Least and most bytes before the anchor of the classes of strings."""
    span = least - ANCHOR
    edges = [-1, *(span * k // CLASSES for k in range(1, CLASSES + 1))]
    return [(a + 1, b) for a, b in zip(edges, edges[1:])]  # noqa: B905


def run_rows(least: int):
    """(anchor, whole, sides and key): the distinct runs of each text whose anchors are listed for it.

    sides holds SIDE bits of the name of each class's stretch (they only prune). Lists hold 32 bits of the anchors'
    names, which also lets a few runs through that need not be here.
    """

    def run(batches):
        for batch in batches:
            for at, buf, off in slices(batch.column("text")):
                n = len(off) - 1
                value, row = flat(batch.column("anchors"), at, n)
                wanted = np.sort(pair_key(value.to_numpy(zero_copy_only=False).view(np.uint32).astype(np.uint64), row))
                r = Runs(buf, off, least)
                key = pair_key(r.name >> U(32), r.row)
                found = np.searchsorted(wanted, key)
                r.take(wanted[np.minimum(found, max(0, len(wanted) - 1))] == key if len(wanted) else np.zeros(len(key), bool))
                if not len(r.row):
                    continue
                whole = r.wholes(least)
                _, once = np.unique(pair_key(mix(r.name + whole * STEP), r.row), return_index=True)
                once.sort()
                whole = whole[once]
                r.take(once)
                inner = r.place - r.start
                lonely = mix(pair_key(r.name, r.start) + pair_key(r.place.astype(np.uint64), batch.column("doc").take(pa.array(at + r.row)).to_numpy()))
                bounds, some = [], []
                for low, high in classes(least):
                    a, b = r.place - low, r.place + least - high
                    some.append((a >= r.start) & (b < r.start + r.size + least) & (inner >= low) & (inner - r.size + 1 <= high))
                    bounds.append((np.where(some[-1], a, r.start), np.where(some[-1], b, r.start)))
                sides = np.zeros(len(r.row), U)
                for c, name in enumerate(r.between(*bounds)):
                    sides |= (np.where(some[c], mix(name + U(c)), mix(lonely + U(c))) >> U(64 - SIDE)) << U(SIDE * c)
                yield made(["anchor", "whole", "sides"], [r.name, whole, sides], batch, at + r.row)

    return run


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the intervals [start, end) of each row; neighbours that touch are one."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    far = np.maximum.accumulate(end + row * (1 << 40)) - row * (1 << 40)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > far[:-1])
    head = np.flatnonzero(new)
    return row[head], start[head], far[np.append(head[1:], len(row)) - 1]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def open_stretches(least: int):
    """(start, size, ranks and key): with ranks, size neighbouring positions of open runs whose classes are shared, and
    the ranks of 16 bytes at them and as far on as their strings go; without, an interval that is already decided."""

    def run(batches):
        for batch in batches:
            for at, buf, off in slices(batch.column("text")):
                n = len(off) - 1
                value, row = flat(batch.column("runs"), at, n)
                if not len(row):
                    continue
                value = value.to_numpy(zero_copy_only=False).view(np.uint64)
                wanted = pair_key(value & ~U(31), row)
                order = np.argsort(wanted)
                wanted, states = wanted[order], (value & U(31)).astype(np.int64)[order]
                runs = Runs(buf, off, least)
                key = pair_key((runs.name ^ runs.wholes(least)) & ~U(31), runs.row)
                found = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                keep = np.flatnonzero(wanted[found] == key)
                runs.take(keep)
                state = states[found[keep]]
                decided, is_open = state == 0, np.flatnonzero(state > 0)
                r, a, b = merged(runs.row[decided], runs.start[decided], (runs.start + runs.size + least - 1)[decided])
                none = pa.nulls(len(r), pa.list_(pa.int64()))
                yield made(["start", "size", "ranks"], [(a - off[r]).astype(np.int32), (b - a).astype(np.int32), none], batch, at + r)
                bounds = classes(least)
                for low in range(0, len(is_open), 1 << 14):
                    x = is_open[low : low + (1 << 14)]
                    # classes that follow each other make one stretch; more bytes before the anchor come first
                    rows, first, last = [], [], []
                    for c in reversed(range(CLASSES)):
                        mine = x[(state[x] >> c) & 1 > 0]
                        begin = np.maximum(runs.start[mine], runs.place[mine] - bounds[c][1])
                        end = np.minimum(runs.start[mine] + runs.size[mine], runs.place[mine] - bounds[c][0] + 1)
                        some = end > begin
                        rows.append(runs.row[mine][some])
                        first.append(begin[some])
                        last.append(end[some])
                    r, a, b = merged(*(np.concatenate(v) for v in (rows, first, last)))
                    long = b - a + least - ANCHOR
                    held = ranks(buf, ranges(a, long)) if len(r) else np.zeros(0, U)
                    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(long)).astype(np.int32)), pa.array(held.view(np.int64)))
                    yield made(["start", "size", "ranks"], [(a - off[r]).astype(np.int32), (b - a).astype(np.int32), lists], batch, at + r)

    return run


def cut_rows(batches):
    """What is left of each text once its intervals are taken out."""
    for batch in batches:
        ids, texts, listed = batch.column("doc"), batch.column("text"), batch.column("cuts").fill_null([])
        for at, buf, off in slices(texts):
            n = len(off) - 1
            value, row = flat(listed, at, n)
            if len(row):
                start = value.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                size = np.diff(off)[row]
                row, start, end = merged(row, np.minimum(start, size), np.minimum(start + value.field(1).to_numpy(zero_copy_only=False), size))
                some = end > start
                row, start, end = row[some], start[some], end[some]
            else:
                start = end = np.zeros(0, np.int64)
            removed, spans = np.bincount(row, end - start, n).astype(np.int64), np.bincount(row, minlength=n)
            cut = np.searchsorted(row, np.arange(n + 1))
            digests, view = [], memoryview(np.ascontiguousarray(buf))
            for k in range(n):
                h, last = hashlib.sha256(), int(off[k])
                for j in range(cut[k], cut[k + 1]):
                    h.update(view[last : off[k] + start[j]])
                    last = int(off[k] + end[j])
                h.update(view[last : off[k + 1]])
                digests.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(np.diff(off)), pa.array(removed), pa.array(spans), pa.array(digests)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def doubled(stretches: DataFrame, least: int) -> DataFrame:
    """(high, low, start, size and key): a row for each position, with its pair of ranks: that of the 32 bytes that begin
    there (48 bits) and that of the last 32 of its string (47 bits), side by side in high and low; and a row for each
    decided interval, with high null."""
    key = keys(stretches.columns)
    rank = lambda i: F.get(F.col("ranks"), i)
    twice = lambda i: F.xxhash64(rank(i), rank(i + ANCHOR))
    low16 = F.lit(0xFFFF)
    one = lambda high, low, at, n: F.struct(high.alias("high"), low.alias("low"), at.cast("int").alias("start"), n.cast("int").alias("size"))
    pair = lambda near, far: (near.bitwiseAND(F.lit(~0xFFFF)).bitwiseOR(far.bitwiseAND(low16)), F.shiftrightunsigned(far, 33).cast("int"))
    none = F.lit(None).cast("long")
    whole = F.array(one(none, F.hash("start", *key), F.col("start"), F.col("size")))
    every = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: one(*pair(twice(i), twice(i + (least - 2 * ANCHOR))), F.col("start") + i, F.lit(least)))
    return stretches.select(*key, F.inline(F.when(F.col("ranks").isNull(), whole).otherwise(every)))


def removed_intervals(known: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, start, size): intervals of bytes to remove, in no order and perhaps overlapping; known has the key and text."""
    if not 2 * ANCHOR <= least <= 4 * ANCHOR:
        raise ValueError("two ranks of 32 bytes make strings of 32 to 64 bytes")
    key = keys(known.columns)
    typed = "".join(f", {k} {t}" for k, t in known.select(*key).dtypes)
    digests = known.where(F.octet_length("text") >= least).select(*key, F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("digest"))
    # a text may have any share of the rows: its figures are made of those of salted parts, and rows meet their part's
    digests = digests.withColumn("_salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)))
    parts = digests.groupBy("digest", "_salt").agg(F.min("doc").alias("_low"), F.max("doc").alias("_high"))
    firsts = parts.groupBy("digest").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")).where("_low < _high")
    firsts = parts.select("digest", "_salt").join(firsts, "digest")
    copies = digests.join(firsts, ["digest", "_salt"]).where("doc > _low").select(*key).distinct()
    of_anchor = W.partitionBy("anchor")
    each = known  # of rows that repeat id and text one is ranked; the joins sort by the key in any case
    if len(key) > 1:
        each = known.withColumn("_nth", F.row_number().over(W.partitionBy(*key).orderBy(*key))).where("_nth = 1").drop("_nth")
    ranked = each.join(copies, key, "left_anti").mapInArrow(anchors(least), f"anchor long{typed}")
    shared = ranked.withColumns({"_low": F.min("doc").over(of_anchor), "_high": F.max("doc").over(of_anchor)}).where("_low < _high")
    lists = shared.groupBy(*key).agg(F.collect_list(F.shiftright("anchor", 32).cast("int")).alias("anchors"))
    runs = each.join(lists, key).select(*key, "text", "anchors").mapInArrow(run_rows(least), f"anchor long, whole long, sides long{typed}")
    runs = runs.withColumns({"_whole": F.min("doc").over(W.partitionBy("anchor", "whole")), "_anchor": F.min("doc").over(of_anchor)})
    own = F.col("doc") == F.col("_whole")
    runs = runs.withColumn("_any", F.max(own & (F.col("doc") > F.col("_anchor"))).over(of_anchor)).where("doc > _whole OR _any")
    state = F.lit(0)
    mine = F.when(own, F.col("doc"))
    for c in range(CLASSES):
        bit = 1 << c
        same = W.partitionBy("anchor", f"_key{bit}")
        runs = runs.withColumn(f"_key{bit}", F.shiftrightunsigned("sides", SIDE * c).bitwiseAND(F.lit((1 << SIDE) - 1))).withColumn(f"_is{bit}", F.when(F.min(mine).over(same) < F.max(mine).over(same), bit).otherwise(0))
        state = state + F.col(f"_is{bit}")
    runs = runs.withColumn("state", F.when(own, state).otherwise(0)).where("doc > _whole OR state > 0")
    lists = runs.groupBy(*key).agg(F.collect_list(F.col("anchor").bitwiseXOR(F.col("whole")).bitwiseAND(F.lit(-32)).bitwiseOR(F.col("state"))).alias("runs"))
    last = each.join(lists, key).select(*key, "text", "runs").mapInArrow(open_stretches(least), f"start int, size int, ranks array<long>{typed}")
    last = doubled(last, least).withColumn("_low", F.min("doc").over(W.partitionBy("high", "low"))).where("high IS NULL OR doc > _low")
    return last.select(*key, "start", "size").unionByName(copies.select(*key, F.lit(0).alias("start"), F.lit((1 << 31) - 1).alias("size")))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    repeated = not rows.where("doc IS NOT NULL").groupBy("doc").count().where("count > 1").isEmpty()
    if repeated:
        rows = rows.select("doc", F.xxhash64("text").alias("th"), "text")  # th tells texts of one id apart
    known = rows.where("doc IS NOT NULL")  # every join of texts has the same exchange of these rows
    key = keys(known.columns)
    cuts = removed_intervals(known, least).groupBy(*key).agg(F.collect_list(F.struct("start", "size")).alias("cuts"))
    nameless = rows.where("doc IS NULL").select("doc", "text", F.lit(None).cast("array<struct<start:int,size:int>>").alias("cuts"))
    every = known.join(cuts, key, "left").select("doc", "text", "cuts").unionByName(nameless)
    return every.mapInArrow(cut_rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
