"""Assets of Markdown documents: tables, figures, code, equations and citations with places, ids and order.

One Arrow pass over each document's own text finds them (a regular expression's place in the text has no expression in
SQL), so nothing is shuffled; pages, sections and chunks are joined to them afterwards.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import lexicon as L

RECORDS = "document_id bigint, asset_id string, asset_type string, subtype string, asset_order int, start_offset bigint, end_offset bigint, line_no int, caption string, uri string, language string, headers array<string>, content string"
_NAMES = [c.split()[0] for c in RECORDS.split(", ")]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
_ORDER = list(L.ASSET_PREFIX)


def is_table_line(line: str) -> bool:
    bare = line.strip()
    return "|" in line and (bare.startswith("|") or bare.endswith("|"))


class Page:
    """A text with its lines and their first characters."""

    def __init__(self, text: str):
        self.text, self.lines = text, text.split("\n")
        self.starts = [0, *accumulate(len(x) + 1 for x in self.lines)]

    def line_of(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def caption_above(self, line: int) -> str:
        """The line before, where it reads like a table's caption."""
        above = self.lines[line - 1].strip() if line > 0 else ""
        return above if above.lower().startswith(("table", "caption:", "**table")) else ""


def _tables(p: Page):
    first = None
    for k, line in enumerate([*p.lines, ""]):
        if is_table_line(line):
            first = k if first is None else first
        elif first is not None:
            headers = [h.strip() for h in p.lines[first].split("|") if h.strip()]
            yield "table", "markdown", p.starts[first], min(p.starts[k], len(p.text)), {"caption": p.caption_above(first), "headers": headers, "content": "\n".join(p.lines[first:k])}
            first = None
    for m in re.finditer(L.HTML_TABLE, p.text):
        if "</table>" in m[0]:
            yield "table", "html", *m.span(), {"caption": p.caption_above(p.line_of(m.start())), "headers": [], "content": m[0]}
        else:
            yield "warning", "table", *m.span(), {"content": L.BROKEN_TABLE}


def _figures(p: Page):
    for m in re.finditer(L.MARKDOWN_IMAGE, p.text):
        cut = m[2].find(" ")
        yield "figure", "markdown", *m.span(), {"caption": m[1], "uri": m[2][:cut].strip() if cut > 0 else m[2]}
    for m in re.finditer(L.HTML_IMAGE, p.text):
        alt = re.search(L.ALT_TEXT, m[0])
        yield "figure", "html", *m.span(), {"caption": alt[1] if alt else "", "uri": m[1]}
    for start, line in zip(p.starts, p.lines, strict=False):
        if "<img" in line.lower() and ">" not in line:
            yield "warning", "figure", start, start + len(line), {"content": L.BROKEN_IMAGE % line.strip()}


def _code(p: Page):
    opened = None
    for k, line in enumerate(p.lines):
        bare = line.strip()
        if opened is None:
            if bare.startswith(("```", "~~~")):
                opened = k
        elif bare.startswith(p.lines[opened].strip()[:3]):
            yield "code", "fenced", p.starts[opened], p.starts[k] + len(line), {"language": p.lines[opened].strip()[3:].strip(), "content": "\n".join(p.lines[opened + 1 : k])}
            opened = None
    if opened is not None:  # a block that is not closed ends with the text
        yield "code", "fenced", p.starts[opened], len(p.text), {"language": p.lines[opened].strip()[3:].strip(), "content": "\n".join(p.lines[opened + 1 :])}


def _equations(p: Page):
    for m in re.finditer(L.DISPLAY_MATH, p.text):
        yield "equation", "display", *m.span(), {"content": (m[1] if m[1] is not None else m[2]).strip()}


def _citations(p: Page):
    """Five scans in order of priority; of those that begin at one place the first counts."""
    cited = lambda kind, a, b, raw: ("citation", kind, a, b, {"content": raw})
    inside = False
    for start, line in zip(p.starts, p.lines, strict=False):
        bare = line.strip()
        if bare.startswith("#"):
            inside = re.match(L.BIBLIOGRAPHY_HEADING, bare) is not None
        elif inside and re.match(L.BIBLIOGRAPHY_ITEM, bare):
            yield cited("bibliography", start, start + len(line), bare)
    for start, line in zip(p.starts, p.lines, strict=False):
        if "[^" not in line:  # neither form
            continue
        if re.search(L.FOOTNOTE_TEXT, line.strip()):
            yield cited("footnote", start, start + len(line), line.strip())
        else:
            yield from (cited("footnote", start + m.start(), start + m.end(), m[0]) for m in re.finditer(L.FOOTNOTE_MARK, line))
    for pattern, kind in ((L.CATALOG, "attribution"), (L.INLINE_CITATION, "inline"), (L.ATTRIBUTION, "attribution")):
        yield from (cited(kind, *m.span(), m[0].strip()) for m in re.finditer(pattern, p.text))


def bytes_before(text: str, places: list[int]) -> dict[int, int]:
    """The number of bytes before each of the places, which are in order; each character is encoded once."""
    if text.isascii():
        return {at: at for at in places}
    pieces = (len(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip([0, *places], places, strict=False))
    return dict(zip(places, accumulate(pieces), strict=True))


def find(text: str) -> list[tuple]:
    """(id, type, subtype, order, start, end, line, fields) of a text's assets and warnings, in the order of their places;
    ids are numbered by type in the order of the scans, places are bytes."""
    p, count, taken, out = Page(text), dict.fromkeys(_ORDER, 0), set(), []
    for scan in (_tables, _figures, _code, _equations, _citations):
        for kind, sub, a, b, fields in scan(p):
            if kind == "citation":
                if a in taken:
                    continue
                taken.add(a)
            if kind in count:
                count[kind] += 1
            rank = _ORDER.index(kind) if kind in count else len(_ORDER)
            out.append((a, rank, f"{L.ASSET_PREFIX[kind]}-{count[kind]}" if kind in count else None, kind, sub, b, fields))
    out.sort(key=lambda r: (r[3] == "warning", r[0], r[1]))  # stable: equal places stay in the order of the scans
    size = bytes_before(text, sorted({at for r in out for at in (r[0], r[5])}))
    order, rows = 0, []
    for a, _, name, kind, sub, b, fields in out:
        order += kind != "warning"
        rows.append((name, kind, sub, order if kind != "warning" else None, size[a], size[b], p.line_of(a) + 1, fields))
    return rows


def assets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """RECORDS of every document: assets in document order, and warnings (asset_type `warning`, without id or order)."""

    def rows(doc: int, text: str) -> list[tuple]:
        return [(doc, *r[:7], *(r[7].get(k) for k in ("caption", "uri", "language", "headers", "content"))) for r in find(text)]

    def run(batches):
        pairs = ((d.as_py(), t.as_py() or "") for batch in batches for d, t in zip(batch.column(0), batch.column(1), strict=True))
        yield from A.in_pieces(((len(t), rows(d, t)) for d, t in pairs), _NAMES, _TYPES)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, RECORDS)


def statistics(found: DataFrame) -> DataFrame:
    """(document_id, tables, figures, codes, equations, citations, warnings): how many of each a document has."""
    n = lambda kind: F.sum(F.when(F.col("asset_type") == kind, 1).otherwise(0)).alias(f"{kind}s")
    return found.groupBy("document_id").agg(*map(n, (*_ORDER, "warning")))


def placed(found: DataFrame, lines: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Assets with section_path, page_number, page_numbers and related_chunk_ids.

    lines (document_id, ord, section) has the heading in force at each line; pages (document_id, page_number, r_start,
    r_end) and chunks (document_id, chunk_id, r_start, r_end) are inclusive spans of bytes that meet the asset's. An asset
    without a page is on page 1.
    """
    from tessera.operators.structure import overlaps
    from tessera.sources.storage import stored

    # three parts of the plan read the assets, and each would scan the texts for them
    own = stored(found.where("asset_type <> 'warning'"), "assets").withColumns({"l_start": F.col("start_offset"), "l_end": F.col("end_offset"), "ord": F.col("line_no") - 1})
    key = ["document_id", "asset_id"]
    spans = own.select(*key, "l_start", "l_end")
    on_pages = overlaps(spans, pages, "document_id").groupBy(*key).agg(F.array_sort(F.collect_set("page_number")).alias("page_numbers"), F.min_by("page_number", "r_start").alias("page_number"))
    in_chunks = overlaps(spans, chunks, "document_id").groupBy(*key).agg(F.array_sort(F.collect_set("chunk_id")).alias("related_chunk_ids"))
    out = own.join(lines.select("document_id", "ord", F.col("section").alias("section_path")), ["document_id", "ord"], "left").join(on_pages, key, "left").join(in_chunks, key, "left")
    out = out.withColumns({
        "page_number": F.coalesce("page_number", F.lit(1)), "page_numbers": F.coalesce("page_numbers", F.array(F.lit(1))),
        "related_chunk_ids": F.coalesce("related_chunk_ids", F.array().cast("array<string>")),
    })
    return out.drop("ord", "l_start", "l_end")


def numbered(found: DataFrame, *order: str) -> DataFrame:
    """Assets (document_id, asset_type) with ids by type in the given order, for tables that were made elsewhere."""
    prefix = F.create_map(*[F.lit(x) for pair in L.ASSET_PREFIX.items() for x in pair])
    n = F.row_number().over(W.partitionBy("document_id", "asset_type").orderBy(*order))
    return found.withColumn("asset_id", F.concat_ws("-", prefix[F.col("asset_type")], n.cast("string")))
