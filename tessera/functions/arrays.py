"""Sequential work on an array in one linear pass over Arrow batches, where a fold in SQL would copy the array at each step."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists, and the offsets of each; null counts as an empty list."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), offsets


@F.arrow_udf(T.ArrayType(T.LongType()))
def sums_before(sizes: pa.Array) -> pa.Array:
    """For each array of numbers, the sums of what stands before each element."""
    values, offsets = _flat(sizes)
    total = np.append(0, np.cumsum(values.astype(np.int64)))
    base = np.repeat(total[offsets[:-1]], np.diff(offsets))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(total[:-1] - base))


def greedy_groups(budget: int):
    """A function from arrays of sizes to group numbers from 1: a unit joins the group before it while the sum stays in
    budget; a larger unit is a group of its own."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(sizes: pa.Array) -> pa.Array:
        values, offsets = _flat(sizes)
        groups = np.zeros(len(values), np.int32)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            held, group = budget + 1, 0
            for k in range(a, b):
                n = int(values[k])
                fits = held + n <= budget
                held, group = (held + n, group) if fits else (n, group + 1)
                groups[k] = group
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(groups))

    return run


_TERM = re.compile("[a-z0-9]+")
_TERMS = T.StructType([T.StructField("length", T.LongType()), T.StructField("terms", T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])))])


#: Characters of texts after which rows are made Arrow arrays, so that a worker holds no Python objects of a whole batch.
PIECE = 1 << 20


def in_pieces(found, names: list[str], types: list):
    """Record batches of the rows of texts, found as (characters of a text, its rows as tuples): one ends where its texts
    reach PIECE characters."""
    held: list[tuple] = []
    size = 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
    for n, rows in found:
        held.extend(rows)
        size += n
        if size >= PIECE:
            if held:
                yield batch()
            held, size = [], 0
    if held:
        yield batch()


@F.arrow_udf(_TERMS)
def term_frequencies(text: pa.Array) -> pa.Array:
    """The number of a text's tokens (as `text.tokens` cuts them) and how often each distinct one stands in it: counted
    where the row lies, so tokens are not shuffled to be counted."""
    made, terms, counts, offsets, lengths, size = [], [], [], [0], [], 0

    def piece() -> pa.Array:
        rows = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int64())], ["term", "tf"])
        return pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)], ["length", "terms"])

    for t in text:
        words = (t.as_py() or "").lower()
        found = _TERM.findall(words)
        once = Counter(found)
        terms.extend(once)
        counts.extend(once.values())
        offsets.append(len(terms))
        lengths.append(len(found))
        size += len(words)
        if size >= PIECE:
            made.append(piece())
            terms, counts, offsets, lengths, size = [], [], [0], [], 0
    return pa.concat_arrays([*made, piece()])


#: Which bytes make tokens; bytes of a token that is hashed with others; the first bytes of eight.
_LETTERS = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
SHORT = 64
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hashed_tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of tokens, 64-bit hashes) of the tokens (as `text.tokens` cuts them) of texts, one text after another; equal
    tokens have equal hashes. All tokens are hashed together, eight bytes of each at a time; long ones alone. Tokens of
    eight bytes or fewer have hashes of their own, since each step can be undone."""
    held = [(t or "").lower().encode() for t in texts]
    data = np.frombuffer(b" ".join(held) + b" " * 8, np.uint8)
    edges = np.flatnonzero(np.diff(_LETTERS[data].view(np.int8), prepend=np.int8(0)))
    first, last = edges[::2], edges[1::2]
    size = last - first
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    hashes, at, begin, left = np.zeros(len(first), np.uint64), slice(None), first, size
    for _ in range(0, SHORT, 8):
        h = (hashes[at] ^ (eights[begin] & _FIRST[np.minimum(left, 8)])) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        hashes[at] = h ^ (h >> np.uint64(29))
        more = left > 8
        at, begin, left = np.arange(len(first))[at][more], begin[more] + 8, left[more] - 8
        if not len(at):
            break
    for i in np.flatnonzero(size > SHORT).tolist():
        hashes[i] = int.from_bytes(blake2b(data[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
    ends = np.cumsum([len(x) + 1 for x in held])
    return np.diff(np.searchsorted(first, ends), prepend=0), hashes.view(np.int64)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`np.unique` of 64-bit numbers with the inverse. Numbers are sorted ten times as fast as places of numbers, so the low
    bits make room for the places; where numbers differ in these alone, they are sorted as usual."""
    low = (1 << max(len(values) - 1, 1).bit_length()) - 1
    order = np.sort((values & ~low) | np.arange(len(values))) & low
    found = values[order]
    first = np.diff(found, prepend=found[:1] - 1) != 0
    if np.any(found[1:] < found[:-1]):
        return np.unique(values, return_inverse=True)
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.cumsum(first) - 1
    return found[first], inverse


#: Bits of a bitmap, as a power of two: 2 MB however many values it stands for.
BITMAP = 24


def _places(values: np.ndarray) -> np.ndarray:
    return (values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITMAP)


def has(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = _places(values).astype(np.int64)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def bitmap(values, column: str) -> np.ndarray:
    """One bit for each value of a column of numbers, at its hash; made of partial sums, at most 2^18 numbers come back."""

    def words(batches):
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy(zero_copy_only=False))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    got = values.select(column).mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def among(bits: np.ndarray):
    """A function from numbers to whether a `bitmap` has them: true for all that it stands for, and for few others."""

    @F.arrow_udf(T.BooleanType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array(has(bits, values.to_numpy(zero_copy_only=False)))

    return run


#: An odd base of polynomial hashes modulo 2^64, its inverse, and bytes of a window of texts.
_BASE = 0x9E6C63D0876A9A47
_INVERSE = pow(_BASE, -1, 1 << 64)
WINDOW = 1 << 19
#: Hashes of one string beyond its own, so that a crowded bitmap still lets few strings pass.
_AGAIN = (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(max(n - 1, 0), base, np.uint64)), dtype=np.uint64)[:n]


def _start(size: int) -> int:
    """The bytes at the start of a string of that size that are looked at first."""
    return max(k for k in (1, 2, 4, 8) if k <= size)


def _hashes(sums: np.ndarray, at: np.ndarray, size: int, inverse: np.ndarray) -> np.ndarray:
    """Hashes of the strings of one size that start at the places, from sums of bytes times powers; they tell the size."""
    h = (sums[at + size] - sums[at]) * inverse[at]
    return (h ^ (h >> np.uint64(31))) + np.uint64((size * 0x632BE59BD9B4E019) % (1 << 64))


def _again(h: np.ndarray, k: int) -> np.ndarray:
    return (h ^ (h >> np.uint64(29))) * np.uint64(_AGAIN[k])


def _sums(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    return np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64))


@F.arrow_udf(T.ArrayType(T.LongType()))
def spelling(name: pa.Array) -> pa.Array:
    """Hashes of a string that is not empty, and of its start, by which `spelled` finds it."""
    out = []
    for text in name:
        data = np.frombuffer(text.as_py().encode(), np.uint8)
        at, inverse, sums = np.zeros(1, np.int64), np.ones(1, np.uint64), _sums(data, _powers(_BASE, len(data)))
        whole = _hashes(sums, at, len(data), inverse)
        out.append(np.concatenate([_hashes(sums, at, _start(len(data)), inverse), whole, _again(whole, 0), _again(whole, 1)]).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * 4), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)))


def spelled(sizes: list[int], bits: np.ndarray):
    """A function from texts to the distinct strings in each, of the sizes in bytes, whose `spelling` a bitmap has: all
    strings that the bitmap stands for, and few others. Windows of texts bound its memory."""

    by_start: dict[int, list[int]] = {}
    for n in sizes:
        by_start.setdefault(_start(n), []).append(n)
    longest = max(sizes, default=1)
    size = max(WINDOW, 4 * longest)

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def run(text: pa.Array) -> pa.Array:
        flat = text.cast(pa.large_binary())
        offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
        data = np.frombuffer(flat.buffers()[2], np.uint8) if len(flat) and flat.buffers()[2] is not None else np.zeros(0, np.uint8)
        powers, inverse = _powers(_BASE, size + longest), _powers(_INVERSE, size + longest)
        found: list[set[bytes]] = [set() for _ in range(len(flat))]
        first, last = int(offsets[0]), int(offsets[-1])
        for begin in range(first, last, size):
            part = data[begin : min(begin + size + longest, last)]
            sums, held = _sums(part, powers), part.tobytes()
            here = min(size, last - begin)
            row = np.searchsorted(offsets, np.arange(begin, begin + here), "right") - 1
            left = offsets[row + 1] - begin  # where each place's text ends
            places = np.arange(here)
            for start, lengths in by_start.items():
                at = places[places + start <= left]
                at = at[has(bits, _hashes(sums, at, start, inverse))]
                for n in lengths:
                    fits = at[at + n <= left[at]]
                    whole = _hashes(sums, fits, n, inverse)
                    for k in (None, 0, 1):
                        passed = has(bits, whole if k is None else _again(whole, k))
                        fits, whole = fits[passed], whole[passed]
                    for p, r in zip(fits.tolist(), row[fits].tolist(), strict=True):
                        found[r].add(held[p : p + n])
        ends = np.append(0, np.cumsum([len(f) for f in found])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for f in found for x in f], pa.binary()))

    return run
