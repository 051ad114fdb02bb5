"""Token counts at every prefix, by dynamic programming over byte-pair merges.

The tokenizer's pre-tokenizer cuts a text into pieces, and a special string in the text is one token of its own. Inside
a piece the encoding of a prefix ends with exactly one token that is compatible with the last token of the prefix
before it (two tokens are compatible if their joined bytes encode to just these two), so
``count[i] = count[i - len(token)] + 1`` gives the exact count of every prefix of the piece in one pass. Pieces recur, so
each worker keeps a bounded table of them with the counts of all their prefixes. A document's count is the sum over its
pieces; `PrefixCounts` keeps the sums at piece ends and looks up the counts inside pieces, and so answers counts, budgets
and truncation without encoding again.

A count inside a piece is that of the prefix as a text of its own wherever the pre-tokenizer cuts that prefix like the
whole text. Where it may not (white space before another word, a contraction, a special string that is cut apart: at most
three characters into a piece, or inside a special string), the last piece or two are cut again, and the new pieces are
looked up. The pattern must be one whose pieces are runs of one kind of character, but for such seams.

Defined cases: null is empty and has 0 tokens; texts of any length are counted whole; rows that repeat are counted
each; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterable
from functools import lru_cache
from itertools import accumulate, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import table

#: Pieces that a worker remembers with their prefixes, and bytes of them, before the older half goes; the latest stays.
PIECES, REMEMBERED = 400_000, 1 << 25
#: A prefix that ends so many characters into a piece may be cut otherwise than the whole text; further in it is not.
SEAM = 3
COUNTS = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("cut_chars", T.LongType())])


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges(dict):
    """Piece to its number of tokens; inside has the count of each prefix of the piece, by characters from 0 on."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.inside: dict[str, bytes | np.ndarray] = {}
        self.held = 0
        spec = json.loads(open(path, encoding="utf-8").read())
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        self.rank = {}
        for k, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[raw(left), raw(right)] = k
        # numbers in the order of merging: the 256 bytes, then what each merge makes
        self.number = {bytes([b]): b for b in range(256)}
        self.halves, self.made = [(b, b) for b in range(256)], {}
        for left, right in self.rank:
            new = self.number.setdefault(left + right, len(self.halves))
            if new == len(self.halves):
                self.halves.append((self.number[left], self.number[right]))
            self.made[self.number[left], self.number[right]] = new
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pattern = regex.compile(pattern)
        self.pieces = self.pattern.findall
        self.compatible = lru_cache(1 << 18)(self._compatible)
        self.found = self.automaton().iter

    def merge(self, data: bytes) -> list[bytes]:
        """The encoding of a piece, by the lowest-ranked merge first."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best = min(((self.rank.get((a, b), 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))  # noqa: B905
            if best[0] == 1 << 60:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        """Whether two tokens that stand side by side stay as they are when their joined bytes are encoded.

        The merges that made both are undone, the latest first. Where the parts that meet at the seam could merge before
        the one that is undone there was made, the encoding would have joined them; bytes on both sides end it.
        """
        before = len(self.halves)  # number of the merge that the next one at the seam would have to precede
        while True:
            if self.made.get((left, right), before) < before:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left and left > 255:
                    before, left = left, self.halves[left][1]
                    break
                if not undo_left and right > 255:
                    before, right = right + 1, self.halves[right][0]
                    break
                undo_left = not undo_left
            else:
                return True

    def token(self, data: bytes) -> int:
        """The number of a token that the merges make of these bytes, or -1."""
        return self.number[data] if data in self.number and self.merge(data) == [data] else -1

    def automaton(self) -> ahocorasick.Automaton:
        """All tokens that the merges make, to be found at every place of a piece in one pass; bytes stand as letters."""
        out = ahocorasick.Automaton()
        for t in self.number:
            if (token := self.token(t)) >= 0:
                out.add_word(t.decode("latin-1"), (len(t), token))
        out.make_automaton()
        return out

    def prefix_counts(self, data: bytes) -> list[int]:
        count, last, done = [0] * (len(data) + 1), [-1] * (len(data) + 1), 0
        for at, (size, token) in self.found(data.decode("latin-1")):
            # tokens that end here; exactly one goes with the last token of the prefix before it
            if at == done:
                start = at + 1 - size
                if start == 0 or self.compatible(last[start], token):
                    done = at + 1
                    count[done], last[done] = count[start] + 1, token
        if done < len(data):
            raise ValueError("the vocabulary lacks a byte")
        return count

    def __missing__(self, piece: str) -> int:
        """Tokens of a whole piece; the counts of its prefixes stay in inside."""
        if len(self) >= PIECES or self.held >= REMEMBERED:  # the older half goes, which has the rare pieces of the past and what comes again soon
            for old in list(islice(self, (len(self) + 1) // 2)):
                del self[old], self.inside[old]
            self.held = sum(map(len, self))
        data = piece.encode()
        found = self.prefix_counts(data)
        if len(data) != len(piece):  # by characters
            begins = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
            found = [*np.array(found[:-1], np.uint32)[begins].tolist(), found[-1]]
        self[piece] = found[-1]
        self.inside[piece] = bytes(found) if max(found) < 256 else np.array(found, np.uint32)
        self.held += len(piece)
        return found[-1]

    def prefixes(self, piece: str) -> bytes | np.ndarray:
        """The counts of the piece's prefixes, by characters."""
        self[piece]
        return self.inside[piece]

    def segments(self, text: str):
        """(piece or special string, whether it is special) in order, one at a time."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield from ((p[0], False) for p in self.pattern.finditer(text, at, m.start()))
            yield m[0], True
            at = m.end()
        yield from ((p[0], False) for p in self.pattern.finditer(text, at))

    def count(self, text: str) -> int:
        if self.special and any(s in text for s in self.special):
            return sum(1 if special else self[p] for p, special in self.segments(text))
        return sum(map(self.__getitem__, self.pieces(text)))

    def truncated(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the text, and the most characters whose prefix takes no more than budget tokens."""
        if self.special and any(s in text for s in self.special):
            prefix = PrefixCounts(self, text)
            return prefix.tokens[-1], prefix.within(budget)
        pieces = self.pieces(text)
        ends = list(accumulate(map(self.__getitem__, pieces)))
        if not ends or ends[-1] <= budget:
            return ends[-1] if ends else 0, len(text)
        # sums at piece ends say where the budget is used up; a prefix count looks at the piece before its last at most
        first = max(0, bisect_right(ends, budget) - 3)
        before, start = ends[first - 1] if first else 0, sum(map(len, pieces[:first]))
        near = pieces[first : first + 8]
        here = PrefixCounts(self, text[start : start + sum(map(len, near))], [(p, False) for p in near])
        return ends[-1], start + here.within(budget - before)


class PrefixCounts:
    """Exact token counts of the prefixes of one text, whose pieces may be given."""

    def __init__(self, merges: Merges, text: str, segments: Iterable[tuple[str, bool]] | None = None):
        self.merges, self.text = merges, text
        self.cuts, self.marks, self.tokens, self.special = [], [0], [0], []
        for piece, special in merges.segments(text) if segments is None else segments:
            self.cuts.append(piece)
            self.special.append(special)
            self.marks.append(self.marks[-1] + len(piece))
            self.tokens.append(self.tokens[-1] + (1 if special else merges[piece]))

    def at(self, chars: int) -> int:
        """Tokens of the first chars characters, as a text of their own."""
        k = min(bisect_right(self.marks, chars), len(self.cuts)) - 1
        if k < 0:
            return 0
        part = chars - self.marks[k]
        if part > SEAM and not self.special[k]:
            return self.tokens[k] + int(self.inside(k)[part])
        if self.special[k] and part == len(self.cuts[k]):
            return self.tokens[k + 1]
        # a piece that ends the prefix may be cut otherwise than before other text: at most it and the one before
        first = k - 1 if k and not self.special[k - 1] else k
        start = self.marks[first]
        if first < k and len(self.cuts[first]) > SEAM and not self.cuts[first].isspace():
            first, start = k, self.marks[k]  # only white space and short pieces join what comes behind them
        again = [p for p, _ in self.merges.segments(self.text[start:chars])]
        if again == [*self.cuts[first:k], self.cuts[k][:part]] and not self.special[k]:
            return self.tokens[k] + int(self.inside(k)[part])
        return self.tokens[first] + sum(self.merges[p] for p in again)

    def inside(self, k: int) -> bytes | np.ndarray:
        return self.merges.prefixes(self.cuts[k])

    def within(self, budget: int) -> int:
        """The most characters whose prefix takes no more than budget tokens, by piece ends and then inside a piece."""
        k = max(0, bisect_right(self.tokens, budget) - 1)
        # white space that joins the piece behind may still fit
        end = min(self.marks[min(k + 1, len(self.marks) - 1)] + 1, self.marks[-1])
        for j in range(min(k + 1, len(self.cuts) - 1), max(0, k - 1) - 1, -1):
            start, stop = self.marks[j], min(self.marks[j + 1], end)
            near = stop if self.special[j] else min(stop, start + SEAM)
            if stop > near:
                counts = self.inside(j)
                counts = np.frombuffer(counts, np.uint8) if isinstance(counts, bytes) else counts
                fits = np.flatnonzero(counts[SEAM + 1 : stop - start + 1] <= budget - self.tokens[j])
                if len(fits):
                    return start + SEAM + 1 + int(fits[-1])
            for chars in range(near, start, -1):
                if self.at(chars) <= budget:
                    return chars
        return 0


@lru_cache(4)
def _merges(path: str, pattern: str) -> Merges:
    return Merges(path, pattern)


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, cut_chars) of every row; path is a byte-level BPE file of the tokenizers library.

    cut_chars is the most characters whose prefix takes no more than limit tokens. The file is read on the executors,
    where the tokenizers' files are installed beside Python.
    """

    @F.arrow_udf(COUNTS)
    def counted(text: pa.Array) -> pa.Array:
        merges = _merges(path, pattern)
        sizes, tokens, cuts = (np.zeros(len(text), np.int64) for _ in range(3))
        for k, t in enumerate(text):
            t = t.as_py() or ""
            sizes[k] = len(t.encode())
            tokens[k], cuts[k] = merges.truncated(t, limit)
        return pa.StructArray.from_arrays([pa.array(sizes), pa.array(tokens), pa.array(cuts)], ["n_bytes", "n_tokens", "cut_chars"])

    rows = docs.select(F.col(id_col).alias("doc_id"), counted(F.col(text_col)).alias("c"))
    return rows.select("doc_id", "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"), "c.cut_chars")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_counts(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN, 1024)
