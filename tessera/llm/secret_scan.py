"""Secret scanning with a recursive decoding worklist.

The base patterns are run on the text itself. Then layers are unwrapped: runs with percent escapes, runs with backslash
Unicode escapes, and base64 runs, also joined over single line breaks, whose bytes may be gzip or zlib streams (all
members, and what lies behind them) or text, in which bad bytes are replaced. Every decoded layer is scanned by the
same patterns and put on the worklist again, until no layer decodes any further; inflated layers are spooled and read
in pieces. A layer that was seen before in the document is not opened again, so cycles end. A finding in a layer is
mapped to the span of the outermost encoded run in the text. Texts are also scanned with their escapes replaced in
place; a finding that goes beyond one run there is mapped to its own span in the text.

Defined cases: null is empty and has no spans; spans are code points with an exclusive end, of the whole match; base
spans stay as they are, a decoded finding that maps to the same kind and span is one with it; rows that repeat are
scanned each; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import tempfile
import zlib
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # AKIA and a whole run, of 20 characters at least
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs of 24 characters at least
RUN = re.compile(r"[!-~]+")
PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
ESCAPE = re.compile(r"\\u(?:([0-9A-Fa-f]{4})|\{([0-9A-Fa-f]{1,6})\})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
BLANKS = re.compile(r"[ \t\r\n]+")
EITHER = re.compile(ESCAPE.pattern + "|%([0-9A-Fa-f]{2})")
URLSAFE = str.maketrans("-_", "+/")
#: Streams are inflated and read so many bytes at a time, and texts are cut where no pattern and no run goes on.
PIECE = 1 << 20
BREAK = re.compile(rb"[^\t\r\n -~]|[^A-Za-z0-9+/_=\s-][ \t]*\r?\n|\n[ \t]*\r?\n")
FOUND = T.StructType([T.StructField("n_assign", T.LongType()), T.StructField("n_access", T.LongType()), T.StructField("n_hex", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("layers", T.LongType())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _stream(head: bytes) -> int:
    """The window argument of a gzip or zlib stream that begins so, or 0."""
    return 31 if head[:2] == b"\x1f\x8b" else 15 if head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0 else 0


def _spool(data: bytes = b""):
    spool = tempfile.SpooledTemporaryFile(4 * PIECE)
    spool.write(data)
    return spool


def _inflate(source) -> list:
    """What the members of a gzip or zlib stream hold, and the bytes behind them; nothing where source is no stream."""
    source.seek(0)
    buf, out, broken = source.read(PIECE), _spool(), False
    while (kind := _stream(buf)) and not broken:
        member = zlib.decompressobj(kind)
        try:
            while not member.eof:
                got = member.decompress(buf, PIECE)
                out.write(got)
                buf = member.unused_data if member.eof else member.unconsumed_tail or source.read(PIECE)
                if not member.eof and not buf and not got:
                    break
        except zlib.error:
            broken = True
        if len(buf) < 3:
            buf += source.read(PIECE)
    if not out.tell():
        return []
    rest = _spool()
    while buf:
        rest.write(buf)
        buf = source.read(PIECE)
    return [out, rest] if rest.tell() else [out]


def _texts(source):
    """The text of a layer in pieces that no match or run crosses; bytes that are not UTF-8 are replaced."""
    source.seek(0)
    held = b""
    while piece := source.read(PIECE):
        at, held, cut = max(0, len(held) - 2), held + piece, 0
        for m in BREAK.finditer(held, at):
            cut = m.end()
        if cut:
            yield held[:cut].decode("utf-8", "replace")
            held = held[cut:]
    yield held.decode("utf-8", "replace")


def _base64(run: str) -> bytes | None:
    body = run.rstrip("=").translate(URLSAFE)
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        # a word of letters decodes, too, but hardly ever to text with a secret or to a stream
        return binascii.a2b_base64(body + "=" * (-len(body) % 4))
    except binascii.Error:
        return None


def _unicode(run: str) -> str:
    out = ESCAPE.sub(lambda m: chr(c) if (c := int(m[1] or m[2], 16)) < 0x110000 else m[0], run)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # joins surrogate pairs


def _wrapped(text: str):
    """(start, end) of stretches of base64 lines: from the first and the second line on, and lines of one length."""
    for m in WRAPPED.finditer(text):
        lines = [(x.start(), x.end()) for x in LINE.finditer(text, m.start(), m.end())]
        found, first = {(lines[0][0], m.end()), (lines[1][0], m.end())}, 0
        for k in range(1, len(lines) + 1):
            size = lines[first][1] - lines[first][0]
            if k == len(lines) or lines[k][1] - lines[k][0] != size:
                last = k if k < len(lines) and lines[k][1] - lines[k][0] < size else k - 1
                if last > first:
                    found.add((lines[first][0], lines[last][1]))
                first = k
        yield from sorted(found)


def layers(text: str):
    """(decoded text or bytes, start, end) of each run that decodes to something else."""
    if "%" in text:
        yield from ((d, m.start(), m.end()) for m in RUN.finditer(text) if PERCENT.search(m[0]) and (d := unquote_to_bytes(m[0]).decode("utf-8", "replace")) != m[0])
    if "\\u" in text:
        yield from ((d, m.start(), m.end()) for m in RUN.finditer(text) if ESCAPE.search(m[0]) and (d := _unicode(m[0])) != m[0])
    yield from ((d, m.start(), m.end()) for m in BASE64.finditer(text) if (d := _base64(m[0])))
    yield from ((d, a, b) for a, b in _wrapped(text) if (d := _base64(BLANKS.sub("", text[a:b]))))


def in_place(text: str):
    """(text with one character for each escape, starts, ends of its characters in text), until no escape is left."""
    starts = ends = None
    while "%" in text or "\\u" in text:
        parts, at, kept = [], 0, np.ones(len(text), bool)
        if starts is None:
            starts, ends = np.arange(len(text)), np.arange(1, len(text) + 1)
        for m in EITHER.finditer(text):
            code = int(m[1] or m[2] or m[3], 16)
            if code < 0x110000:
                parts += [text[at : m.start()], chr(code) if code < 0x80 or not m[3] else "\ufffd"]
                at = m.end()
                kept[m.start() + 1 : at] = False
                ends[m.start()] = ends[at - 1]
        if not parts:
            return
        text, starts, ends = "".join([*parts, text[at:]]), starts[kept], ends[kept]
        yield text, starts, ends


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], int]:
    """Base spans, all spans, and how many layers were opened."""
    base = base_spans(text)
    spans, opened, seen, work = set(base), 0, set(), []

    def put(layer, a, b):
        if not isinstance(layer, (str, bytes)):
            sha = hashlib.sha256()
            layer.seek(0)
            while piece := layer.read(PIECE):
                sha.update(piece)
            key = (sha.digest(), a, b)
        elif isinstance(layer, bytes):
            key = (hashlib.sha256(layer).digest(), a, b)
        else:
            key = (layer, a, b)
        if key not in seen:
            seen.add(key)
            work.append((layer, a, b))

    for found in layers(text):
        put(*found)
    for changed, starts, ends in in_place(text):
        # what lies in one run is found in the run
        there = [(int(starts[a]), kind, int(ends[b - 1])) for a, kind, b in base_spans(changed)]
        spans |= {(a, kind, b) for a, kind, b in there if not RUN.fullmatch(text, a, b)}
        for d, a, b in layers(changed):
            a, b = int(starts[a]), int(ends[b - 1])
            if not RUN.fullmatch(text, a, b):
                put(d, a, b)
    while work:
        layer, a, b = work.pop()
        if isinstance(layer, bytes):
            if not _stream(layer):
                layer = layer.decode("utf-8", "replace")
            else:
                layer = _spool(layer)
        if not isinstance(layer, str):
            inner = _inflate(layer)
            for x in inner:
                put(x, a, b)
            pieces = [] if inner else _texts(layer)
        else:
            pieces = [layer]
        opened += 1
        for piece in pieces:
            spans |= {(a, kind, b) for _, kind, _ in base_spans(piece)}
            for d, _, _ in layers(piece):
                put(d, a, b)
            for changed, _, _ in in_place(piece):
                put(changed, a, b)
    return base, sorted(spans), opened


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


@F.arrow_udf(FOUND)
def found(text: pa.Array) -> pa.Array:
    counts, digests, spans, opened = np.zeros((3, len(text)), np.int64), [], [], []
    for k, t in enumerate(text):
        base, every, n = scan(t.as_py() or "")
        for _, kind, _ in base:
            counts[kind, k] += 1
        digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
        spans.append(joined(every))
        opened.append(n)
    return pa.StructArray.from_arrays([*map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(opened, pa.int64())], FOUND.fieldNames())


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, layers) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), found(F.col(text_col)).alias("f")).select("doc_id", "f.*")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("layers")
