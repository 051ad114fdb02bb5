"""Main text of web pages: a bidirectional LSTM labels every block of a page in the context of all of them.

A linear pass over the html keeps the open elements and cuts the text into leaf blocks at block elements. A block is
described by a vector of its tag path (the open elements, pairs of a parent and its child, the parts of their class and
id names, all hashed), one of its words (hashed) and a few figures (length, links, punctuation, place, likeness to the
title). The sequence of a page's blocks is read forwards and backwards by two LSTMs in numpy, and each block is main text
or not by both states and its own vector. The network is trained here by back-propagation through time on a fixed number
of made-up pages (see block_pages) whose blocks are known; its size depends on nothing in the data.

Defined cases: null and empty html, and pages without main text, give an empty text; character references are decoded,
also those without a semicolon that browsers take; white space (no-break spaces too) inside a block becomes one space;
`br` is white space; comments, scripts, styles and other elements that aren't shown are left out; unclosed elements and
tags, stray ends and bare text are read as browsers do for the most part; rows that repeat, or have null ids, are read
each; other columns are not read; an empty table gives no rows. Pages of any length are read whole.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.block_pages import made_page
from tessera.llm.shared import as_bytes, table
from tessera.llm.wordscan import U, word_hashes

#: Rows and width of the tables of path and word vectors, figures of a block, units of a direction.
PATHS, PATH_DIM, WORDS, WORD_DIM, FIGURES, UNITS = 4_096, 16, 4_096, 8, 12, 24
#: Training: made-up pages, pages of a step, passes, step size.
PAGES, STEP_PAGES, PASSES, RATE = 2_400, 24, 4, 0.02
#: Characters of html parsed together, and cells (pages times blocks) of one pass of the network.
TOGETHER, CELLS = 1 << 21, 1 << 14

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>"'=]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
SIMPLE = re.compile(r"""<(/?)([a-zA-Z][^\s/>"'=]*)([^>]*+)>""")
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
SENTENCE_END = frozenset(".!?…:;\"”»)")
# Elements of HTML by how they are read.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template textarea title iframe svg math select object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q ruby rt rp rb s samp small span strike strong sub sup time tt u var wbr nobr".split())
CLOSES = {"li": ("ul ol menu", "li"), "dt": ("dl", "dt dd"), "dd": ("dl", "dt dd"), "td": ("table tr", "td th"), "th": ("table tr", "td th"), "tr": ("table", "tr td th"), "option": ("", "option")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
NO_PARAGRAPH = frozenset("div article section main aside nav header footer form table td th li ul ol dl dt dd blockquote body html figure details fieldset button".split())


def path_id(name: str) -> int:
    return zlib.crc32(name.encode()) % PATHS


class Block:
    __slots__ = ("heading", "linked", "links", "path", "tags", "text")

    def __init__(self, text: str, linked: int, links: int, path: list[int], tags: str, heading: bool) -> None:
        self.text, self.linked, self.links, self.path, self.tags, self.heading = text, linked, links, path, tags, heading


class Parser:
    """One pass over a page; blocks and title are its results."""

    def __init__(self, page: str) -> None:
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.open: Counter = Counter()  # names of open elements
        self.features: Counter = Counter()  # path ids of open elements
        self.blocks: list[Block] = []
        self.title = ""
        self.texts: list[str] = []
        self.linked: list[str] = []
        self.links = 0
        self._read(page)

    def _read(self, page: str) -> None:
        at, tag = 0, TAG
        while True:
            lt = page.find("<", at)
            if lt < 0:
                self._text(page[at:])
                break
            if lt > at:
                self._text(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                if end < 0:
                    break
                at = end + 3
                continue
            mark = page[lt + 1 : lt + 2]
            if mark in ("!", "?"):
                end = page.find(">", lt)
                if end < 0:
                    break
                at = end + 1
                continue
            if not (mark.isascii() and mark.isalpha()) and not (mark == "/" and page[lt + 2 : lt + 3].isalpha()):
                self._text("<")
                at = lt + 1
                continue
            found = tag.match(page, lt)
            if found is None:
                tag = SIMPLE  # a quote that is never closed: from here on, tags end at the next >
                found = tag.match(page, lt)
                if found is None:
                    break
            at = found.end()
            name = found[2].lower()
            if found[1]:
                self._end(name)
            elif name in HIDDEN:
                self._gap(name)
                if found[3].endswith("/"):
                    continue
                close = _closing(name).search(page, at)
                if name == "title" and not self.title:
                    self.title = " ".join(entities.unescape(page[at : close.start() if close else len(page)]).split())
                if close is None:
                    break
                at = close.end()
            else:
                self._start(name, found[3])
        self._flush()

    def _text(self, text: str) -> None:
        self.texts.append(text)
        if self.open["a"]:
            self.linked.append(text)

    def _gap(self, name: str) -> None:
        if name in INLINE:
            if name == "br":
                self._text(" ")
        else:
            self._flush()

    def _start(self, name: str, attrs: str) -> None:
        self._gap(name)
        if name in VOID:
            return
        if name == "a":
            self.links += 1
            if self.open["a"]:
                self._end("a")
        if name not in INLINE and self.open["p"]:
            self._close_above(frozenset(("p",)), NO_PARAGRAPH)
        if name in CLOSES:
            inside, same = CLOSES[name]
            if any(self.open[x] for x in same):
                self._close_above(same, inside)
        parent = next((t for t, _ in reversed(self.stack) if t not in INLINE), "") if name not in INLINE else ""
        ids = [path_id(f"t:{name}")]
        if name not in INLINE:
            ids.append(path_id(f"b:{parent}>{name}"))
        if "=" in attrs:
            for m in NAMED.finditer(attrs):
                ids += [path_id("c:" + part.lower()) for part in PARTS.findall(m[1] or m[2] or m[3] or "")]
        own = tuple(ids)
        self.stack.append((name, own))
        self.open[name] += 1
        self.features.update(own)

    def _pop(self) -> str:
        name, own = self.stack.pop()
        self.open[name] -= 1
        for x in own:
            if self.features[x] == 1:
                del self.features[x]
            else:
                self.features[x] -= 1
        return name

    def _close_above(self, names: frozenset, stop: frozenset) -> None:
        """Ends the outermost of the named elements that no element of stop encloses more narrowly."""
        depth = None
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in stop:
                break
            if self.stack[k][0] in names:
                depth = k
        if depth is not None:
            self._flush()
            while len(self.stack) > depth:
                self._pop()

    def _end(self, name: str) -> None:
        if name not in INLINE:
            self._flush()
        elif name == "br":
            self._text(" ")
        if self.open[name]:
            while self._pop() != name:
                pass

    def _flush(self) -> None:
        if not self.texts:
            return
        text, linked, links = "".join(self.texts), "".join(self.linked), self.links
        self.texts, self.linked, self.links = [], [], 0
        if "&" in text:
            text = entities.unescape(text)
        text = " ".join(text.split())
        if not text or self.open["head"]:
            return
        names = [t for t, _ in self.stack]
        nearest = next((t for t in reversed(names) if t not in INLINE), "")
        path = [*self.features, path_id(f"n:{nearest}")]
        self.blocks.append(Block(text, len(linked.strip()), links, path, "/".join(names[-12:]), nearest in ("h1", "h2", "h3", "h4", "h5", "h6")))


@lru_cache(64)
def _closing(name: str) -> re.Pattern:
    return re.compile(f"</{name}[^>]*>", re.I)


def described(pages: list[tuple[list[Block], str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(path ids, their ends, word ids, their ends, figures, blocks of each page) of the pages' blocks one after another."""
    blocks = [b for page, _ in pages for b in page]
    sizes = np.array([len(page) for page, _ in pages], np.int64)
    path = np.array([x for b in blocks for x in b.path], np.int64)
    path_ends = np.cumsum([len(b.path) for b in blocks])
    buf, off = as_bytes(pa.array([b.text for b in blocks], pa.string()))
    words, rows, _ = word_hashes(buf, off)
    n_words = np.bincount(rows, minlength=len(blocks))
    figures = np.zeros((len(blocks), FIGURES), np.float32)
    at = 0
    for page, title in pages:
        for k, b in enumerate(page):
            n, t = len(b.text), b.text
            stops = t.count(".") + t.count(",") + t.count("!") + t.count("?")
            figures[at] = (np.log1p(n) / 8, min(1.0, b.linked / n), min(4, b.links) / 4, min(1.0, 8 * stops / max(8, n_words[at])), t[-1] in SENTENCE_END, n / max(1, n_words[at]) / 20, (k + 1) / len(page), 1 / (k + 1), 1 / (len(page) - k), b.heading, bool(title) and (t in title or title in t), t[0].isdigit() or t[0] in "©|•")
            at += 1
    return path, path_ends, (words % U(WORDS)).astype(np.int64), np.cumsum(n_words), figures, sizes


def means(rows: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The mean of the rows of each stretch of ids; zero for an empty one."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = np.zeros((len(ends), rows.shape[1]), np.float32)
    full = np.flatnonzero(ends > starts)
    for part in np.array_split(full, max(1, len(ids) // (1 << 18))):
        if len(part):
            a, b = starts[part[0]], ends[part[-1]]
            out[part] = np.add.reduceat(rows[ids[a:b]], starts[part] - a, axis=0) / (ends[part] - starts[part])[:, None]
    return out


def padded(sizes: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block number for each step and page, mask) of some pages."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[pages]
    steps = np.arange(int(sizes[pages].max()))[:, None]
    mask = steps < sizes[pages][None, :]
    return np.where(mask, starts[None, :] + steps, 0), mask.astype(np.float32)[:, :, None]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def new_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    width = PATH_DIM + WORD_DIM + FIGURES
    draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    out = {"path": draw(PATHS, PATH_DIM, by=0.3), "word": draw(WORDS, WORD_DIM, by=0.3), "out": draw(2 * UNITS + width, by=0.1), "bias": np.zeros(1, np.float32)}
    for d in "fb":
        out |= {f"x{d}": draw(width, 4 * UNITS, by=width**-0.5), f"h{d}": draw(UNITS, 4 * UNITS, by=UNITS**-0.5), f"b{d}": np.zeros(4 * UNITS, np.float32)}
        out[f"b{d}"][UNITS : 2 * UNITS] = 1  # gates that forget are open at first
    return out


def read(w: dict, x: np.ndarray, mask: np.ndarray, d: str, tape: list | None = None) -> np.ndarray:
    """States of one direction for (steps, pages, width); tape takes what the way back needs."""
    steps, many = x.shape[:2]
    inputs = x @ w[f"x{d}"] + w[f"b{d}"]
    h = c = np.zeros((many, UNITS), np.float32)
    out = np.zeros((steps, many, UNITS), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = inputs[t] + h @ w[f"h{d}"]
        gates = sigmoid(z[:, : 3 * UNITS])
        i, f, o, g = gates[:, :UNITS], gates[:, UNITS : 2 * UNITS], gates[:, 2 * UNITS :], np.tanh(z[:, 3 * UNITS :])
        before = (h, c)
        c = (f * c + i * g) * mask[t]
        th = np.tanh(c)
        h = o * th * mask[t]
        out[t] = h
        if tape is not None:
            tape.append((t, i, f, o, g, th, before))
    return out


def way_back(w: dict, x: np.ndarray, mask: np.ndarray, d: str, tape: list, d_out: np.ndarray, grad: dict) -> np.ndarray:
    """Adds the gradients of one direction to grad and gives that of x."""
    dz = np.zeros((*x.shape[:2], 4 * UNITS), np.float32)
    dh = np.zeros_like(d_out[0])
    dc = np.zeros_like(dh)
    for t, i, f, o, g, th, (h0, c0) in reversed(tape):
        dh = (dh + d_out[t]) * mask[t]
        dc = (dc + dh * o * (1 - th * th)) * mask[t]
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        grad[f"h{d}"] += h0.T @ dz[t]
        dh, dc = dz[t] @ w[f"h{d}"].T, dc * f
    flat = dz.reshape(-1, 4 * UNITS)
    grad[f"x{d}"] += x.reshape(-1, x.shape[2]).T @ flat
    grad[f"b{d}"] += flat.sum(0)
    return dz @ w[f"x{d}"].T


def vectors(w: dict, path, path_ends, word, word_ends, figures) -> np.ndarray:
    return np.concatenate([means(w["path"], path, path_ends), means(w["word"], word, word_ends), figures], axis=1)


def main_scores(w: dict, pages: list[tuple[list[Block], str]]) -> np.ndarray:
    """The probability of being main text, of all blocks of the pages one after another."""
    path, path_ends, word, word_ends, figures, sizes = described(pages)
    out = np.zeros(len(figures), np.float32)
    if not len(figures):
        return out
    x = vectors(w, path, path_ends, word, word_ends, figures)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    while len(order):
        longest = int(sizes[order[-1]])
        some, order = order[-max(1, CELLS // longest) :], order[: -max(1, CELLS // longest)]
        at, mask = padded(sizes, some)
        mine = x[at] * mask
        score = np.concatenate([read(w, mine, mask, "f"), read(w, mine, mask, "b"), mine], axis=2) @ w["out"] + w["bias"]
        real = mask[:, :, 0] > 0
        out[at[real]] = sigmoid(score[real])
    return out


@lru_cache(2)
def trained(pages: int = PAGES, seed: int = 12) -> dict[str, np.ndarray]:
    """The network, fitted by Adam on so many made-up pages; the same at every call."""
    rng = np.random.default_rng(seed)
    made, labels = [], []
    for k in range(pages):
        page, blocks = made_page(seed * 1_000_003 + k)
        parsed = Parser(page)
        if [b.text for b in parsed.blocks] == [" ".join(t.split()) for t, _ in blocks]:
            made.append((parsed.blocks, parsed.title))
            labels.append(np.array([y for _, y in blocks], np.float32))
    path, path_ends, word, word_ends, figures, sizes = described(made)
    label = np.concatenate(labels)
    path_starts, word_starts = np.append(0, path_ends[:-1]), np.append(0, word_ends[:-1])
    w = new_weights(rng)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    ranges = lambda starts, ends, at: np.concatenate([np.arange(starts[b], ends[b]) for b in at]).astype(np.int64)
    for _ in range(PASSES):
        order = rng.permutation(len(made))
        order = np.concatenate([c[np.argsort(sizes[c], kind="stable")] for c in np.array_split(order, max(1, len(order) // 240))])
        lots = np.array_split(order, max(1, len(order) // STEP_PAGES))
        for k in rng.permutation(len(lots)):
            at, mask = padded(sizes, lots[k])
            real = mask[:, :, 0] > 0
            mine = np.unique(at[real])
            p_ids, w_ids = path[ranges(path_starts, path_ends, mine)], word[ranges(word_starts, word_ends, mine)]
            p_len, w_len = (path_ends - path_starts)[mine], (word_ends - word_starts)[mine]
            hidden = rng.random(len(p_ids)) < 0.15  # some names are unknown, as on other sites
            vec = vectors(w, np.where(hidden, path_id("?"), p_ids), np.cumsum(p_len), w_ids, np.cumsum(w_len), figures[mine])
            where = np.searchsorted(mine, at)
            x = vec[np.minimum(where, len(mine) - 1)] * mask
            tapes: dict[str, list] = {"f": [], "b": []}
            h = [read(w, x, mask, d, tapes[d]) for d in "fb"]
            whole = np.concatenate([*h, x], axis=2)
            miss = (sigmoid(whole @ w["out"] + w["bias"]) - label[at]) * mask[:, :, 0] / real.sum()
            grad = {k: np.zeros_like(v) for k, v in w.items()}
            grad["out"] += np.tensordot(miss, whole, 2)
            grad["bias"] += miss.sum()
            d_whole = miss[:, :, None] * w["out"]
            dx = d_whole[:, :, 2 * UNITS :].copy()
            for n, d in enumerate("fb"):
                dx += way_back(w, x, mask, d, tapes[d], d_whole[:, :, n * UNITS : (n + 1) * UNITS], grad)
            d_vec = np.zeros_like(vec)
            d_vec[where[real]] = dx[real]
            np.add.at(grad["path"], np.where(hidden, path_id("?"), p_ids), np.repeat(d_vec[:, :PATH_DIM] / np.maximum(1, p_len)[:, None], p_len, axis=0))
            np.add.at(grad["word"], w_ids, np.repeat(d_vec[:, PATH_DIM : PATH_DIM + WORD_DIM] / np.maximum(1, w_len)[:, None], w_len, axis=0))
            step += 1
            rate = RATE * min(1.0, step / 20) * (0.2 + 0.8 * (1 - step / (PASSES * len(lots) + 1)))
            for k in w:
                first[k] += 0.1 * (grad[k] - first[k])
                second[k] += 0.01 * (grad[k] ** 2 - second[k])
                w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return w


def labelled(pages: list[str | None], w: dict) -> Iterator[list[tuple[Block, float]]]:
    """The blocks of each page, with their scores."""
    parsed = [Parser(p or "") for p in pages]
    score = main_scores(w, [(p.blocks, p.title) for p in parsed])
    at = 0
    for p in parsed:
        yield list(zip(p.blocks, score[at : at + len(p.blocks)].tolist(), strict=True))
        at += len(p.blocks)


def _lots(pages: list[str | None]) -> Iterator[list[str | None]]:
    held: list[str | None] = []
    size = 0
    for p in pages:
        held.append(p)
        size += len(p or "")
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), threshold: float = 0.5) -> DataFrame:
    """The columns in keep, and text: the main text of every row's page."""
    model = pages.sparkSession.sparkContext.broadcast(trained())  # of fixed size

    @F.arrow_udf("string")
    def text(page: pa.Array) -> pa.Array:
        out = []
        for lot in _lots(page.to_pylist()):
            out += ["\n".join(b.text for b, s in blocks if s >= threshold) for blocks in labelled(lot, model.value)]
        return pa.array(out, pa.string())

    return pages.select(*keep, text(F.col(html_col)).alias("text"))


def page_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, block, tags, text, score): every block of every page with its path and its score as main text."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    @F.arrow_udf("array<struct<block: int, tags: string, text: string, score: float>>")
    def blocks(page: pa.Array) -> pa.Array:
        out = []
        for lot in _lots(page.to_pylist()):
            out += [[{"block": k, "tags": b.tags, "text": b.text, "score": s} for k, (b, s) in enumerate(found)] for found in labelled(lot, model.value)]
        kind = pa.struct([("block", pa.int32()), ("tags", pa.string()), ("text", pa.string()), ("score", pa.float32())])
        return pa.array(out, pa.list_(kind))

    found = pages.select(F.col(id_col).alias("page_id"), F.explode(blocks(F.col(html_col))).alias("b"))
    return found.select("page_id", "b.block", "b.tags", "b.text", "b.score")


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
