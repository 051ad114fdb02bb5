"""Periodic runs of words: maximal stretches that repeat with a period, found in tiles by octaves of the period.

A run of period q is an interval of word numbers i with word[i] = word[i + q], lengthened by q. Periods are taken by
octaves [P, 2P). Such an interval has a least length m in its octave, so a grid of boundaries m - L apart has one whose
next L words lie in the interval whole. A document is exploded into overlapping tiles: short ones into one for all
octaves, longer ones into tiles of 4,096 words for the periods up to 256, of 65,536 for those up to 4,096, and so on; a
tile overlaps its neighbours by as much as its periods need. Each tile is solved alone. Ranks name its blocks of 1, 2, 4,
... words. At a boundary c, the boundary Z-functions give for each period q of the octave how far the words from c on
equal those from c + q on, and how far those before do, up to a reach of 2P: blocks of L words are compared first, then
only what is equal there is lengthened block by block. A period whose word at c is a power of a shorter one is left to
that one. A tile's intervals are joined inside the tile, cut where the reach ends, and go by document and period to the
tasks that stitch them: intervals that meet are one.

Defined cases: words are the runs of characters outside 0x20 and 0x09-0x0D and are compared byte for byte; null, empty
and blank texts have no words and no runs; rows that repeat, or whose id is null, have results of their own; texts of any
length are read whole, and the tiles of a long one are solved one after another; other columns are not read; an empty
table gives no rows. Two words count as equal if 64-bit hashes of them do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.shared import materialise, slices, table
from tessera.llm.wordscan import U, mix, word_hashes

#: Fewest words of a run.
LEAST = 12
#: Words of the smallest tile and its longest period; both grow by GROW from class to class.
TILE, PERIOD, GROW = 4_096, 256, 16
#: Words that are solved at once, if tiles are small.
TOGETHER = 1 << 18
ONE_CASE = np.arange(256, dtype=np.uint8)

TILES = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("start", pa.int64()), ("core", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("words", pa.binary()), ("text", pa.string())])
TILE_ROW = "rid long, doc_id long, n long, start long, core long, low long, high long, words binary, text string"
SOLVED_ROW = "rid long, doc_id long, n long, first boolean, text string, kept string, parts array<struct<period long, begin long, end long>>"


def octave(period: int, least: int = LEAST) -> tuple[int, int, int]:
    """(L, distance of boundaries, reach) for the periods [period, 2 period)."""
    shortest = min(max(q, least - q) for q in range(period, min(2 * period, period + least)))
    block = 1 << max(0, (max(1, shortest // 2)).bit_length() - 1)
    return block, shortest - block, max(2 * period, 16)


def tile_bounds(n: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first word, end, first word of the core, lowest octave, end of octaves) of the tiles of a text of n words. A
    tile's boundaries are those from its core on, up to where the next core begins."""
    low, size, top = 1, TILE, PERIOD
    while True:
        if n <= size + size // 2 or 2 * low > n:
            yield 0, n, 0, low, max(n, 1)
            return
        for core in range(0, n, size):
            yield max(0, core - 4 * top), min(n, core + size + 6 * top), core, low, 2 * top
        low, size, top = 2 * top, size * GROW, top * GROW
        if 2 * low > n:
            return


def explode_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rid, doc_id, text) as their tiles; the first tile of a text carries it."""
    for batch in batches:
        rid, ids, text = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        for at, buf, off in slices(text):
            hashes, rows, _ = word_hashes(buf, off, fold=ONE_CASE)
            ends = np.searchsorted(rows, np.arange(len(off)), "left")
            out: list[list] = [[] for _ in TILES]
            for k in range(len(off) - 1):
                words = hashes[ends[k] : ends[k + 1]]
                for j, (start, end, core, low, high) in enumerate(tile_bounds(len(words))):
                    mine = (rid[at + k], ids[at + k], len(words), start, core, low, high, words[start:end].tobytes(), text[at + k].as_py() if not j else None)
                    for held, value in zip(out, mine, strict=True):
                        held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, TILES, strict=True)], schema=TILES)


class Ranks:
    """Names of the blocks of 1, 2, 4, ... words at every place of some words; blocks over the end have names of their own."""

    def __init__(self, words: np.ndarray) -> None:
        self.levels = [words]

    def of(self, level: int) -> np.ndarray:
        while len(self.levels) <= level:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            after = np.concatenate([last[half:], np.arange(min(half, len(last)), dtype=U) * U(2) + U(1)])
            self.levels.append(mix(last * U(0xD6E8FEB86659FD93) + mix(after + U(half))))
        return self.levels[level]

    def ahead(self, x: np.ndarray, y: np.ndarray, end: np.ndarray, reach: int) -> np.ndarray:
        """How many words from y on equal those from x on (x < y), up to end or to reach, a power of two."""
        got = np.zeros(len(x), np.int64)
        for level in _levels(reach):
            names, size = self.of(level), 1 << level
            fits = np.flatnonzero(y + got + size <= end)
            fits = fits[names[x[fits] + got[fits]] == names[y[fits] + got[fits]]]
            got[fits] += size
        return np.minimum(got, reach)

    def behind(self, x: np.ndarray, y: np.ndarray, start: np.ndarray, reach: int) -> np.ndarray:
        """How many words before y equal those before x (x < y), up to start or to reach, a power of two."""
        got = np.zeros(len(x), np.int64)
        for level in _levels(reach):
            names, size = self.of(level), 1 << level
            fits = np.flatnonzero(x - got - size >= start)
            fits = fits[names[x[fits] - got[fits] - size] == names[y[fits] - got[fits] - size]]
            got[fits] += size
        return np.minimum(got, reach)


def _levels(reach: int) -> list[int]:
    """Levels of the blocks to try, one after another: two of half the reach, then one of each smaller size."""
    top = max(0, reach.bit_length() - 2)
    return [top, *range(top, -1, -1)]


def prime_factors(q: int) -> list[int]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return out + [q] * (q > 1)


def _primitive(ranks: Ranks, c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the q words from c on are no power of fewer words."""
    out = np.ones(len(c), bool)
    for period in np.unique(q).tolist():
        at = np.flatnonzero(q == period)
        for r in prime_factors(period):
            part = period // r
            size = period - part
            level = size.bit_length() - 1
            names, x = ranks.of(level), c[at]
            last = size - (1 << level)
            out[at] &= ~((names[x] == names[x + part]) & (names[x + last] == names[x + part + last]))
    return out


def solve(tiles: list[tuple[np.ndarray, int, int, int, int]], least: int = LEAST) -> Iterator[tuple[int, int, int, int]]:
    """(number of the tile, period, first place, end) of the intervals found in tiles of (words, start in the text, core,
    lowest octave, end of octaves). An interval ends inside its tile or is cut there and goes on in the next one."""
    size = np.array([len(t[0]) for t in tiles], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)])[:-1] + 1  # a word that is like no other stands before each tile and at the end
    total = int(first[-1] + size[-1] + 1)
    flat = mix(np.arange(total, dtype=U) * U(2) + U(0x51ED270B2D6E1F47))
    for t, (words, *_), f in zip(range(len(tiles)), tiles, first.tolist(), strict=True):
        flat[f : f + size[t]] = words
    owner = np.repeat(np.arange(len(tiles)), size + 1)
    owner = np.concatenate([[0], owner])[:total]
    core = np.array([t[2] - t[1] for t in tiles], np.int64) + first
    low, high = np.array([t[3] for t in tiles]), np.array([t[4] for t in tiles])
    ends = first + size
    ranks = Ranks(flat)
    found: list[np.ndarray] = []
    period = 1
    while period < int(high.max()) and 2 * period <= int(size.max()):
        block, apart, reach = octave(period, least)
        use = (low <= period) & (period < high) & (size >= 2 * period)
        names = ranks.of(block.bit_length() - 1)
        c = np.arange(0, total, apart)
        c = c[use[owner[c]]]
        c = c[(c >= np.maximum(first, core - apart)[owner[c]]) & (c + period + block <= ends[owner[c]])]
        if len(c):
            mine, at_c = ends[owner[c]], names[c]
            xs, qs = [], []
            if len(c) < period:
                for k in range(len(c)):
                    stop = min(c[k] + 2 * period, mine[k] - block + 1)
                    hit = np.flatnonzero(names[c[k] + period : stop] == at_c[k])
                    xs.append(np.full(len(hit), c[k]))
                    qs.append(hit + period)
            else:
                room = mine - block - c
                for q in range(period, 2 * period):
                    if q > period and not q % 16:  # boundaries near the end of their tile drop out
                        fits = room >= q
                        c, at_c, room = c[fits], at_c[fits], room[fits]
                        if not len(c):
                            break
                    fits = np.flatnonzero(names[np.minimum(c + q, total - 1)] == at_c)
                    fits = fits[room[fits] >= q]
                    xs.append(c[fits])
                    qs.append(np.full(len(fits), q))
            x, q = np.concatenate(xs).astype(np.int64), np.concatenate(qs).astype(np.int64)
            if len(x):
                f = ranks.ahead(x, x + q, ends[owner[x]], reach)
                b = ranks.behind(x, x + q, first[owner[x]], reach)
                runs = np.flatnonzero(f + b >= np.maximum(q, least - q))
                x, q, f, b = x[runs], q[runs], f[runs], b[runs]
                own = _primitive(ranks, x, q)
                x, q, f, b = x[own], q[own], f[own], b[own]
                if len(x):
                    found.append(np.stack([owner[x], q, x - b, x + f]))
        period *= 2
    if not found:
        return
    tile, q, begin, end = np.concatenate(found, axis=1)
    order = np.lexsort((begin, q, tile))
    tile, q, begin, end = tile[order], q[order], begin[order], end[order]
    group = np.concatenate([[True], (tile[1:] != tile[:-1]) | (q[1:] != q[:-1])])
    shift = np.cumsum(group) * (total + 1)  # so that a running maximum starts anew in each group
    furthest = np.maximum.accumulate(end + shift) - shift
    new = group.copy()
    new[1:] |= begin[1:] > furthest[:-1]
    at = np.flatnonzero(new)
    stop = np.maximum.reduceat(end, at)
    for t, p, i, j in zip(tile[at].tolist(), q[at].tolist(), begin[at].tolist(), stop.tolist(), strict=True):
        off = tiles[t][1] - int(first[t])
        yield t, p, i + off, j + off


def _solver(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("words")).to_numpy(zero_copy_only=False) // 8) // TOGETHER
            cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    yield _solved(batch.slice(a, b - a).to_pylist(), digest)

    return run


def _solved(rows: list[dict], digest: bool) -> pa.RecordBatch:
    parts: list[list] = [[] for _ in rows]
    for t, period, begin, end in solve([(np.frombuffer(r["words"], U), r["start"], r["core"], r["low"], r["high"]) for r in rows]):
        parts[t].append({"period": period, "begin": begin, "end": end})
    out = []
    for row, mine in zip(rows, parts, strict=True):
        first = not row["start"] and row["low"] == 1
        whole = first and not mine and row["high"] >= row["n"]  # its only tile has no run, so nothing goes
        kept = _told(_words(row["text"]), digest) if whole else None
        out.append({"rid": row["rid"], "doc_id": row["doc_id"], "n": row["n"], "first": first, "text": None if whole else row["text"], "kept": kept, "parts": mine})
    part = pa.struct([("period", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("first", pa.bool_()), ("text", pa.string()), ("kept", pa.string()), ("parts", pa.list_(part))])
    return pa.RecordBatch.from_pylist(out, schema=schema)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes are split at exactly these six


def _told(words: list[bytes], digest: bool) -> str:
    whole = b" ".join(words)
    return hashlib.sha256(whole).hexdigest() if digest else whole.decode()


def stitch(parts: DataFrame, least: int = LEAST) -> DataFrame:
    """(rid, period, begin, end) of fragments as runs (rid, start, length, period): what meets is one interval."""
    before = W.partitionBy("rid", "period").orderBy("begin", "end")
    marked = parts.withColumn("_far", F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1)))
    marked = marked.withColumn("_no", F.sum(F.when(F.col("begin") <= F.col("_far"), 0).otherwise(1)).over(before.rowsBetween(W.unboundedPreceding, 0)))
    whole = marked.groupBy("rid", "period", "_no").agg(F.min("begin").alias("start"), F.max("end").alias("_end"))
    whole = whole.select("rid", "start", (F.col("_end") - F.col("start") + F.col("period")).alias("length"), "period")
    return whole.where((F.col("length") >= 2 * F.col("period")) & (F.col("length") >= least))


def _collapser(digest: bool):
    def collapsed(text: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for t, mine in zip(text, runs, strict=True):
            words = _words(t.as_py())
            go = np.zeros(len(words) + 1, np.int64)
            for r in mine.as_py() or []:
                go[r["start"] + r["period"]] += 1
                go[r["start"] + r["length"]] -= 1
            stay = np.cumsum(go)[:-1] == 0
            out.append(_told([w for w, s in zip(words, stay.tolist(), strict=True) if s], digest))
        return pa.array(out, pa.string())

    return collapsed


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, kept) of every row: runs is an array of (start, length, period) by start and period; kept
    is the text without the words that repeat inside a run, joined by single spaces (with digest, its SHA-256)."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tiles = rows.mapInArrow(explode_tiles, TILE_ROW)
    # written once, so that a row keeps its number; texts stay only where a run may be
    solved = materialise(tiles.mapInArrow(_solver(digest), SOLVED_ROW), "run-parts")
    runs = stitch(solved.select("rid", F.explode("parts").alias("p")).select("rid", "p.period", "p.begin", "p.end"))
    lists = runs.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))  # fewer than words of the text
    firsts = solved.where("first")
    none = F.array().cast("array<struct<start: long, length: long, period: long>>")
    plain = firsts.where("kept IS NOT NULL").select("doc_id", F.col("n").alias("n_words"), none.alias("runs"), "kept")
    others = firsts.where("kept IS NULL").select("rid", "doc_id", "n", "text").join(lists, "rid", "left")
    collapsed = F.arrow_udf(_collapser(digest), "string")
    others = others.select("doc_id", F.col("n").alias("n_words"), F.coalesce("runs", none).alias("runs"), collapsed(F.col("text"), F.col("runs")).alias("kept"))
    return plain.unionByName(others)


def planted(docs: DataFrame) -> DataFrame:
    """documents, of which every tenth by a hash of its id gets a periodic tail; a null id has no hash and stays."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeat(w: Column) -> Column:
        n = F.greatest(F.size(w), F.lit(1)).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        return F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")

    tail = F.get(F.transform(F.array(words), repeat), 0)
    return docs.select("doc_id", F.when(h % 10 == 0, tail).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")), digest=True)
    best = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1)).when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)), 0)
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = found.select("*", best.alias("best"), F.size("runs").cast("long").alias("n_runs"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return found.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", F.col("kept").alias("collapsed_sha256"))


#: The same by pairs of equal stretches of four words, which every run has throughout its interval.
ORACLE = {
    "op11_periodic_runs": r"""
WITH ids AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
hashed AS (SELECT rid, doc_id, ws, len(ws)::BIGINT AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) AS h FROM ids),
cut AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n ELSE 0 END AS a FROM hashed),
made AS MATERIALIZED (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: ws[CASE WHEN i < a THEN i + 1 ELSE a + 1 + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM cut),
word AS MATERIALIZED (SELECT rid, unnest(ws) AS w, unnest(range(0, n)) AS i FROM made),
gram AS (SELECT rid, i, concat_ws(' ', w, lead(w) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o) AS g, count(*) OVER (PARTITION BY rid) AS n FROM word WINDOW o AS (PARTITION BY rid ORDER BY i)),
inner_gram AS MATERIALIZED (SELECT rid, i, g, n FROM gram WHERE i + 4 <= n),
pair AS (SELECT x.rid, x.i, y.i - x.i AS q FROM inner_gram x JOIN inner_gram y USING (rid, g) WHERE y.i > x.i AND 2 * (y.i - x.i) <= x.n),
island AS (SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM pair),
span AS (SELECT rid, q, min(i) AS s, max(i) + 4 - min(i) + q AS len FROM island GROUP BY rid, q, k),
run AS MATERIALIZED (SELECT rid, s, len, min(q) AS q FROM span WHERE len >= 12 AND len >= 2 * q GROUP BY rid, s, len),
sums AS (SELECT rid, count(*) AS n_runs, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS runs_sha256, first({'s': s, 'len': len, 'q': q} ORDER BY len DESC, s, q) AS best FROM run GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT w.rid, string_agg(w.w, ' ' ORDER BY w.i) AS t FROM word w ANTI JOIN gone USING (rid, i) GROUP BY w.rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period, (1000 * best.len) // best.q AS exponent_milli,
    coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM made LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid)"""
}
