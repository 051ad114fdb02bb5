"""Markdown structure: lines, pages, sections, blocks, chunks and assets, keyed by document."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.functions import lexicon as L
from tessera.functions import text as X

HEADING = r"^(#{1,6})(?:\s+(.*))?$"
PAGE_MARK = r"(?i)<!--\s*page:?\s*(\d+)\s*-->|^---\s*page\s*(\d+)\s*---|\[page\s*(\d+)\]"
PAGE_BREAK = r"(?i)<!--\s*pagebreak\s*-->|\f"
TARGET_TOKENS, MOST_TOKENS = 700, 1200


def lines(docs: DataFrame, id_col: str, text: Column, offsets: bool = True) -> DataFrame:
    """(document_id, ord, line, start): lines from 0 on, with the byte offset of each; without offsets no start.

    Offsets are sums inside the document's own array, so no line is shuffled.
    """
    exploded = docs.select(F.col(id_col).alias("document_id"), F.split(text, "\n").alias("_l"))
    if not offsets:
        return exploded.select("document_id", F.posexplode("_l").alias("ord", "line"))
    exploded = exploded.withColumn("_s", A.sums_before(F.transform("_l", lambda x: F.octet_length(x).cast("bigint") + 1)))
    return exploded.select("document_id", F.posexplode(F.arrays_zip(F.col("_l").alias("line"), F.col("_s").alias("start"))).alias("ord", "z")).select("document_id", "ord", "z.line", "z.start")


def headings(rows: DataFrame) -> DataFrame:
    """Lines that are headings, with level and text; an empty one is "Untitled Section"."""
    name = X.bare(F.regexp_extract("line", HEADING, 2))
    return rows.where(F.col("line").rlike(HEADING)).select("document_id", "ord", "start", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.when(name == "", "Untitled Section").otherwise(name).alias("heading"))


def sections(rows: DataFrame) -> DataFrame:
    """Headings with the ordinal of their parent and the path from the root.

    The ancestor of level j is the last heading of that level with no higher one after it: six windows that carry the
    last heading of each level, and a comparison of their places.
    """
    h = headings(rows)
    order = W.partitionBy("document_id").orderBy("ord")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    for j in range(1, 7):
        h = h.withColumn(f"_{j}", F.last(F.when(F.col("level") == j, F.struct("ord", "heading")), True).over(before))
    higher = F.lit(None).cast("int")
    path, parent = [], F.lit(None).cast("int")
    for j in range(1, 7):
        at = F.col(f"_{j}.ord")
        alive = (F.lit(j) < F.col("level")) & at.isNotNull() & (higher.isNull() | (at > higher))
        path.append(F.when(alive, F.col(f"_{j}.heading")))
        parent = F.when(alive, at).otherwise(parent)
        higher = F.greatest(higher, at)
    full = F.concat_ws(" > ", *path, F.col("heading"))
    return h.select("document_id", "ord", "start", "level", "heading", parent.alias("parent_ord"), full.alias("section_path"), F.row_number().over(order).alias("node_no"))


def marked_lines(rows: DataFrame) -> DataFrame:
    """Lines as nodes of an outline (document_id, ord, level, heading, page): level is null for content; page marks,
    breaks and blank lines are left out. What a line says is read before its document is put in order, so that of texts
    only headings are shuffled."""
    bare = F.col("_bare")
    own = rows.where(F.trim("line") != "").withColumn("_bare", X.bare(F.col("line")))
    level = F.when(bare.startswith("#") & bare.rlike(HEADING), F.length(F.regexp_extract(bare, HEADING, 1)))
    marked = own.select("document_id", "ord", *_page_marks(F.col("line")), level.alias("level"), (~(_says_page(bare) & bare.rlike(PAGE_MARK)) & (bare != "")).alias("_node"), "_bare")
    heading = F.when(F.col("level").isNotNull(), X.bare(F.regexp_extract(bare, HEADING, 2)))
    marked = marked.select("document_id", "ord", "_page", "_break", "level", heading.alias("heading"), (F.col("_node") & ~F.col("_break")).alias("_node"))
    return _with_pages(marked).where("_node").select("document_id", "ord", "level", "heading", "page")


def layout_nodes(raw: DataFrame) -> DataFrame:
    """Nodes of an outline from JSON layouts (document_id, json_layout), with the type of each: headings and headers have
    a level (1 where it lacks) and a text; pages below 1 count as 1."""
    node = F.from_json(F.get_json_object("json_layout", "$.nodes"), "array<struct<type:string,level:int,text:string,page:int>>")
    rows = raw.select("document_id", F.posexplode(node).alias("ord", "n"))
    head = F.col("n.type").isin("heading", "header")
    page = F.coalesce("n.page", F.lit(1))
    return rows.select(
        "document_id", "ord", F.when(head, F.coalesce("n.level", F.lit(1))).alias("level"), F.when(head, X.bare(F.coalesce("n.text", F.lit("")))).alias("heading"),
        F.greatest(page, F.lit(1)).alias("page"), F.coalesce("n.type", F.lit("")).alias("type"), page.alias("given_page"),
    )


def _open_headings(nodes: DataFrame) -> tuple[DataFrame, list[Column]]:
    """nodes with the last heading of each level up to here (_1 to _6), and for each level its place where it is open."""
    upto = W.partitionBy("document_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    for j in range(1, 7):
        nodes = nodes.withColumn(f"_{j}", F.last(F.when(F.col("level") == j, F.col("ord")), True).over(upto))
    higher, open_at = F.lit(None).cast("int"), []
    for j in range(1, 7):
        at = F.col(f"_{j}")
        open_at.append(F.when(at.isNotNull() & (higher.isNull() | (at > higher)), at))
        higher = F.greatest(higher, at)
    return nodes, open_at


def outline(nodes: DataFrame) -> DataFrame:
    """(document_id, ord, node_id, level, heading, parent_ord, page_numbers): the headings of an outline; content adds its
    page to every heading that is open at it. A document with content only has one node, "Document Overview"."""
    marked, open_at = _open_headings(nodes)
    parent = F.lit(None).cast("int")
    for j, at in enumerate(open_at, 1):
        parent = F.when(at.isNotNull() & (F.lit(j) < F.col("level")), at).otherwise(parent)
    heads = marked.where("level IS NOT NULL").select("document_id", "ord", "level", F.when(F.col("heading") == "", "Untitled Section").otherwise(F.col("heading")).alias("heading"), parent.alias("parent_ord"), F.col("page").alias("_own"))
    body = marked.where("level IS NULL").select("document_id", F.explode(F.array_compact(F.array(*open_at))).alias("ord"), "page").groupBy("document_id", "ord").agg(F.collect_set("page").alias("_pages"))
    n = F.row_number().over(W.partitionBy("document_id").orderBy("ord"))
    out = heads.withColumn("node_id", F.concat(F.lit("sec-"), n.cast("string"))).join(body, ["document_id", "ord"], "left")
    pages = F.array_sort(F.array_union(F.array("_own"), F.coalesce("_pages", F.array().cast("array<int>"))))
    bare = nodes.groupBy("document_id").agg(F.min("ord").alias("ord"), F.count("level").alias("_n")).where("_n = 0")
    alone = bare.select("document_id", "ord", F.lit("sec-1").alias("node_id"), F.lit(1).alias("level"), F.lit(OVERVIEW).alias("heading"), F.lit(None).cast("int").alias("parent_ord"), F.array(F.lit(1)).alias("page_numbers"))
    return out.select("document_id", "ord", "node_id", "level", "heading", "parent_ord", pages.alias("page_numbers")).unionByName(alone)


def _warnings(nodes: DataFrame, preambles: bool, *more: Column) -> DataFrame:
    """The messages of each node, and more: one pass over a document's nodes in their order gives them all."""
    marked, open_at = _open_headings(nodes)
    order = W.partitionBy("document_id").orderBy("ord")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    parent = F.lit(None).cast("int")
    for j, at in enumerate(open_at, 1):
        parent = F.when(at.isNotNull() & (F.lit(j) < F.col("level")), F.lit(j)).otherwise(parent)
    name = F.when(F.col("heading") == "", "Untitled Section").otherwise(F.col("heading"))
    empty = F.when(F.col("level").isNotNull() & (F.col("heading") == ""), F.format_string(L.EMPTY_HEADING, "page"))
    skipped = F.when(F.col("level") > F.col("_parent") + 1, F.format_string(L.LEVEL_SKIPPED, F.col("_parent") + 1, F.col("level"), name))
    marked = marked.withColumn("_parent", parent)
    if preambles:  # stands at the first heading, or at the last node where there is none
        marked = marked.withColumns({"_heads": F.count("level").over(upto), "_text": F.min(F.when(F.col("level").isNull(), F.col("ord"))).over(upto), "_more": F.lead(F.lit(True)).over(order)})
        first = F.when(F.col("level").isNotNull(), (F.col("_heads") == 1) & (F.col("_text") < F.col("ord"))).otherwise((F.col("_heads") == 0) & F.col("_more").isNull())
        more = (F.when(first, F.format_string(L.PREAMBLE, "page")), *more)
    return marked.select("document_id", "ord", F.explode(F.array_compact(F.array(empty, skipped, *more))).alias("message"))


def outline_warnings(nodes: DataFrame) -> DataFrame:
    """(document_id, ord, message): empty headings, text before the first heading, and levels that are skipped."""
    return _warnings(nodes, True)


def layout_warnings(nodes: DataFrame) -> DataFrame:
    """outline_warnings of layout nodes without those of preambles, and pages below 1 and unknown types."""
    known = ["heading", "header", "paragraph", "text", "table", "code", "list"]
    page = F.when(F.col("given_page") < 1, F.format_string(L.AMBIGUOUS_PAGE, "given_page"))
    kind = F.when(~F.col("type").isin(*known), F.format_string(L.UNMAPPED_NODE, "type", "page"))
    return _warnings(nodes, False, page, kind)


def resolve_pages(nodes: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """nodes (document_id, node, heading) with page: the first page with a heading line that reads so, else the first page
    of the first chunk whose section path reads so, else the first page whose text holds it and that is no table of
    contents; null where there is none. pages: document_id, page_number, markdown; chunks: document_id, chunk_order,
    section_path, pages."""
    own = nodes.withColumn("_key", X.normal_heading(F.col("heading")))
    key = ["document_id", "_key"]
    wanted = own.where("_key <> ''").select(*key).distinct()
    lines = pages.select("document_id", "page_number", F.explode(F.split("markdown", "\n")).alias("line")).where(F.ltrim("line").startswith("#"))
    by_line = lines.groupBy("document_id", X.normal_heading(F.regexp_replace(X.bare(F.col("line")), "^#+", "")).alias("_key")).agg(F.min("page_number").alias("_a"))
    by_chunk = chunks.where("section_path <> '' AND size(pages) > 0").groupBy("document_id", X.normal_heading(F.col("section_path")).alias("_key")).agg(F.min_by(F.get("pages", F.lit(0)), "chunk_order").alias("_b"))
    text = X.normal_heading(F.col("markdown"))
    contents = text.contains("contents") | F.col("markdown").contains(".....") | F.col("markdown").contains(". . . .")
    plain = pages.where(~contents).select("document_id", "page_number", text.alias("_text"))
    by_text = wanted.join(plain, "document_id").where(F.col("_text").contains(F.col("_key"))).groupBy(*key).agg(F.min("page_number").alias("_c"))
    joined = own.join(by_line, key, "left").join(by_chunk, key, "left").join(by_text, key, "left")
    return joined.withColumn("page", F.coalesce("_a", "_b", "_c")).drop("_key", "_a", "_b", "_c")


def page_warnings(resolved: DataFrame) -> DataFrame:
    """(document_id, node, message) of nodes (document_id, node, heading, is_root, given, page) at the root whose page was
    not found and whose own pages say no more than that they begin at the first."""
    vague = (F.coalesce(F.size("given"), F.lit(0)) <= 0) | ((F.size("given") == 1) & (F.get("given", F.lit(0)) == 1))
    quoted = F.replace(F.replace("heading", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    lost = resolved.where(F.col("is_root") & F.col("page").isNull() & vague)
    return lost.select("document_id", "node", F.format_string(L.PAGE_UNKNOWN, quoted).alias("message"))


def section_of_lines(rows: DataFrame) -> DataFrame:
    """Each line with the heading in force at it: the latest one at or before it, or "Document Overview"."""
    marked = rows.withColumn("_h", F.when(F.col("line").rlike(HEADING), X.bare(F.regexp_extract("line", HEADING, 2))))
    here = F.last("_h", True).over(W.partitionBy("document_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("section", F.coalesce(here, F.lit("Document Overview"))).drop("_h")


def _says_page(line: Column) -> Column:
    """Whether a line can hold a page mark at all: a plain search, since few lines do."""
    return F.lower(line).contains("page")


def _page_marks(line: Column) -> tuple[Column, Column]:
    """The page that a line marks (_page) and whether it is a page break (_break)."""
    number = F.coalesce(*[F.nullif(F.regexp_extract(line, PAGE_MARK, k), F.lit("")) for k in (1, 2, 3)]).cast("int")
    marks, breaks = _says_page(line) & line.rlike(PAGE_MARK), (_says_page(line) | line.contains("\f")) & line.rlike(PAGE_BREAK)
    return F.when(marks, number).alias("_page"), breaks.alias("_break")


def _with_pages(marked: DataFrame) -> DataFrame:
    """Lines (document_id, ord, _page, _break) with page instead of the marks."""
    order = W.partitionBy("document_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    marked = marked.withColumn("_breaks", F.sum(F.when(F.col("_break"), 1).otherwise(0)).over(order))
    base = F.last(F.when(F.col("_page").isNotNull(), F.struct(F.col("_page").alias("p"), F.col("_breaks").alias("b"))), True).over(order)
    return marked.withColumn("_base", base).withColumn("page", F.coalesce(F.col("_base.p") + F.col("_breaks") - F.col("_base.b"), F.col("_breaks") + 1).cast("int")).drop("_page", "_break", "_breaks", "_base")


def page_of_lines(rows: DataFrame) -> DataFrame:
    """Each line with its page: the last explicit mark, and one more for each break since then."""
    return _with_pages(rows.select("*", *_page_marks(F.col("line"))))


def overlaps(left: DataFrame, right: DataFrame, key: str, cell_bytes: int = 4096) -> DataFrame:
    """Pairs of intervals (key, start_offset, end_offset) that overlap, ends included: an equi-join on the key and on the
    cells of the line that both touch, kept in the first such cell."""
    cells = lambda df, p: df.withColumn(f"_{p}", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / cell_bytes), F.floor(F.col(f"{p}_end") / cell_bytes))))
    a, b = cells(left, "l"), cells(right, "r")
    joined = a.join(b, (a[key] == b[key]) & (F.col("_l") == F.col("_r"))).drop(b[key])
    first = F.col("_l") == F.floor(F.greatest("l_start", "r_start") / cell_bytes)
    return joined.where(first & (F.col("l_start") <= F.col("r_end")) & (F.col("l_end") >= F.col("r_start"))).drop("_l", "_r")


def islands(rows: DataFrame, member: Column, id_cols=("document_id",)) -> DataFrame:
    """Maximal runs of neighbouring lines that are members: (document, first_ord, last_ord, start, body)."""
    kept = rows.where(member)
    run = F.col("ord") - F.row_number().over(W.partitionBy(*id_cols).orderBy("ord"))
    grouped = kept.withColumn("_run", run).groupBy(*id_cols, "_run")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return grouped.agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.min("start").alias("start"), body.alias("body")).drop("_run")


def table_line(line: Column) -> Column:
    t = X.bare(line)
    return t.contains("|") & (t.startswith("|") | t.endswith("|"))


def fenced(rows: DataFrame) -> DataFrame:
    """Lines with the number of their code block, 0 outside: fences open and close it in turn."""
    fence = X.bare(F.col("line")).rlike("^(```|~~~)")
    order = W.partitionBy("document_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    n = F.sum(F.when(fence, 1).otherwise(0)).over(order)
    return rows.withColumns({"is_fence": fence, "_n": n}).withColumn("code_no", F.when((F.col("_n") % 2 == 1) | fence, F.floor((F.col("_n") + 1) / 2)).otherwise(0).cast("int")).drop("_n")


def inline_assets(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(document_id, asset_type, subtype, raw): images, HTML images and tables, equations and citations by pattern."""
    found = lambda kind, sub, pattern, group=0: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda r: F.struct(F.lit(kind).alias("asset_type"), F.lit(sub).alias("subtype"), r.alias("raw")))
    every = F.concat(
        found("figure", "markdown", r"!\[[^\]]*\]\([^)\n]+\)"), found("figure", "html", r"(?i)<img\s[^>]*>"),
        found("table", "html", r"(?is)<table>.*?</table>"), found("equation", "display", r"(?s)\$\$.+?\$\$"),
        found("citation", "inline", L.INLINE_CITATION), found("citation", "catalog", L.CATALOG, 1), found("citation", "attribution", L.ATTRIBUTION, 1),
        found("citation", "footnote", r"\[\^[^\]]+\]"),
    )
    return docs.select(F.col(id_col).alias("document_id"), F.inline(every))


BLOCKS = "document_id bigint, block_ord int, kind string, category string, heading_level int, section_path string, page int, start_offset bigint, end_offset bigint, tokens bigint, citations array<string>, content string"
_BLOCK_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string()]
#: The category of each kind of block but a paragraph, which has that of its text.
CATEGORY = {"code": "code", "equation": "equation", "table": "table", "figure": "figure", "list": "procedure"}
OVERVIEW = "Document Overview"


def _estimate(text: str) -> int:
    return max(-(-len(text) // 4), int(len(text.split()) * 1.3)) if text.strip() else 0


def is_list_item(line: str) -> bool:
    return line[:2] in ("- ", "* ", "+ ") or (len(line) > 2 and line[0] in "0123456789" and 0 < line.find(". ") < 5)


def _paragraph_category(text: str) -> str:
    low = text.lower()
    if low.startswith(("note:", "warning:", "caution:", "important:")):
        return "warning"
    if "is defined as" in low or "refers to" in low or low.startswith("definition:"):
        return "definition"
    if low.startswith(("for example:", "e.g.,", "example:")):
        return "example"
    return "reference" if low.startswith(("see ", "refer to ")) else "narrative"


def _kind(line: str, bare: str) -> str:
    """The kind of block that a line outside code and equations belongs to."""
    if bare.startswith(("```", "~~~")):
        return "code"
    if bare.startswith(("$$", "\\[")):
        return "equation"
    if "|" in bare and (bare[0] == "|" or bare[-1] == "|"):
        return "table"
    if bare.startswith(("![", "<!-- figure")):
        return "figure"
    return "list" if is_list_item(bare) else "paragraph"


def page_mark(bare: str) -> re.Match | None:
    """PAGE_MARK in a line, looked for only where one of its forms can be."""
    return re.search(PAGE_MARK, bare) if "<!--" in bare or "[" in bare or bare.startswith("---") else None


def _blocks(doc: int, text: str) -> list[tuple]:
    """The blocks of one document: what a line adds depends on those before it. Code and equations are kept whole, with
    blank lines and marks in them; blank lines don't end tables and lists; paragraphs have their true start."""
    out, held, kind, category, start, path, page, at = [], [], "", "", 0, [], 1, 0
    size = len(text.encode())

    def flush(end: int) -> None:
        nonlocal held, kind
        body = "\n".join(held)
        if body.strip():
            cited = list(dict.fromkeys(m[0] for m in re.finditer(L.INLINE_CITATION, body)))
            where = " > ".join(h for _, h in path) or OVERVIEW
            out.append((doc, len(out), kind, category, path[-1][0] if path else 1, where, page, start, min(end, size), _estimate(body), cited, body))
        held, kind = [], ""

    for line in text.split("\n"):
        bare, after = line.strip(), at + len(line.encode()) + 1
        if kind in ("code", "equation"):
            held.append(line)
            if bare.startswith(held[0].strip()[:3]) if kind == "code" else bare.endswith(("$$", "\\]")):
                flush(after)
        elif (mark := page_mark(bare)) or (("<!--" in line or "\f" in line) and re.search(PAGE_BREAK, line)):
            flush(at)
            page = int(next(g for g in mark.groups() if g)) if mark else page + 1
        elif head := bare.startswith("#") and re.match(HEADING, bare):
            flush(at)
            level = len(head[1])
            path = [p for p in path if p[0] < level] + [(level, (head[2] or "").strip() or "Untitled Section")]
        elif not bare:
            if kind not in ("table", "list"):
                flush(at)
        else:
            new = _kind(line, bare)
            if new != kind:
                flush(at)
                kind, start, category = new, at, CATEGORY.get(new) or _paragraph_category(bare)
            held.append(line)
            if new == "figure" or (new == "equation" and len(bare) > 2 and bare.endswith(("$$", "\\]"))):
                flush(after)
        at = after
    flush(at)
    return out


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of every document; each is parsed where its row lies, so nothing is shuffled and groups don't form, and a
    worker gives blocks back text by text, so that its memory does not follow a batch."""

    def run(batches):
        pairs = ((d.as_py(), t.as_py() or "") for batch in batches for d, t in zip(batch.column(0), batch.column(1), strict=True))
        yield from A.in_pieces(((len(t), _blocks(int(d), t)) for d, t in pairs), [c.split()[0] for c in BLOCKS.split(", ")], _BLOCK_TYPES)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, BLOCKS)


def greedy_groups(units: Column, budget: int) -> Column:
    """Group numbers of an ordered array of sizes: a unit joins the group before it while the sum stays in budget."""
    return A.greedy_groups(budget)(units)


def chunks(parsed: DataFrame) -> DataFrame:
    """Chunks of blocks: neighbours of one section pack into TARGET_TOKENS; other kinds and blocks over MOST_TOKENS stand
    alone; a section of several chunks gets a parent chunk with their texts, measured anew. Sections come in the order of
    their first block, a parent before its children. Pages are sorted, [1] where there are none; a citation counts where
    it stands first."""
    alone = (F.col("kind") != "paragraph") | (F.col("tokens") > MOST_TOKENS)
    order = W.partitionBy("document_id").orderBy("block_ord")
    turn = alone | F.lag(alone).over(order) | (F.lag("section_path").over(order) != F.col("section_path"))
    island = F.sum(F.coalesce(turn, F.lit(True)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    fields = F.struct("block_ord", "tokens", "content", "section_path", "page", "start_offset", "end_offset", "kind", "category", "heading_level", "citations")
    runs = parsed.withColumn("_island", island).groupBy("document_id", "_island").agg(F.array_sort(F.collect_list(fields)).alias("b"))
    packed = runs.withColumn("g", greedy_groups(F.col("b.tokens"), TARGET_TOKENS))
    units = packed.select("document_id", "_island", F.inline(F.arrays_zip("b", "g"))).select("document_id", "_island", "g", "b.*")
    in_order = lambda key, c: F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda x: x[c])
    first = lambda c: F.min_by(c, "block_ord").alias(c)
    made = units.groupBy("document_id", "_island", "g").agg(
        F.first("section_path").alias("section_path"), first("kind"), first("category"), first("heading_level"), F.min("block_ord").alias("first_block"),
        F.sum("tokens").alias("tokens"), F.collect_set("page").alias("pages"), F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"),
        F.array_distinct(F.flatten(in_order("block_ord", "citations"))).alias("citations"), F.array_join(in_order("block_ord", "content"), "\n\n").alias("content"),
        (F.max("tokens") > MOST_TOKENS).alias("is_oversized"),
    ).drop("_island", "g").withColumn("is_parent", F.lit(False))
    section = ["document_id", "section_path"]
    parents = made.groupBy(*section).agg(
        F.lit("paragraph").alias("kind"), F.lit("narrative").alias("category"), F.min_by("heading_level", "first_block").alias("heading_level"), F.min("first_block").alias("first_block"),
        F.array_distinct(F.flatten(F.collect_list("pages"))).alias("pages"), F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"),
        F.array_distinct(F.flatten(in_order("first_block", "citations"))).alias("citations"), F.array_join(in_order("first_block", "content"), "\n\n").alias("content"), F.count("*").alias("_n"),
    ).where("_n > 1").drop("_n").withColumn("tokens", X.token_estimate(F.col("content"))).withColumn("is_oversized", F.col("tokens") > MOST_TOKENS).withColumn("is_parent", F.lit(True))
    both = made.unionByName(parents)
    begins = F.min("first_block").over(W.partitionBy(*section))
    emitted = W.partitionBy("document_id").orderBy("_first", F.col("is_parent").desc(), "first_block")
    both = both.withColumn("_first", begins).withColumns({"chunk_order": F.row_number().over(emitted), "_slug": X.slug(F.col("section_path"))})
    nth = F.row_number().over(W.partitionBy("document_id", "_slug").orderBy("chunk_order"))
    both = both.withColumn("chunk_id", F.format_string("%s/%s/%03d", F.col("document_id").cast("string"), "_slug", nth))
    line, family = W.partitionBy("document_id").orderBy("chunk_order"), W.partitionBy(*section)
    parent = F.max(F.when(F.col("is_parent"), F.col("chunk_id"))).over(family)
    children = F.transform(F.array_sort(F.collect_list(F.when(~F.col("is_parent"), F.struct("chunk_order", "chunk_id"))).over(family)), lambda x: x["chunk_id"])
    pages = F.array_sort(F.filter("pages", lambda p: p >= 1))
    both = both.withColumn("pages", F.when(F.size(pages) > 0, pages).otherwise(F.array(F.lit(1))))
    none = F.array().cast("array<string>")
    return both.select(
        "document_id", "chunk_id", "chunk_order", "section_path", "heading_level", "is_parent", F.when(~F.col("is_parent"), parent).alias("parent_id"),
        F.when(F.col("is_parent"), children).otherwise(none).alias("child_ids"), F.col("kind").alias("content_type"), "category", "tokens",
        F.octet_length("content").alias("character_count"), "is_oversized", "pages", "citations", "start_offset", "end_offset", "content",
        F.lag("chunk_id").over(line).alias("previous_id"), F.lead("chunk_id").over(line).alias("next_id"), X.content_hash(F.col("content")).alias("content_hash"),
        X.chunk_fingerprint(F.col("document_id").cast("string"), F.col("section_path"), F.col("heading_level"), F.transform("pages", lambda p: p.cast("string")), F.col("content")).alias("fingerprint"),
    )


def chunk_warnings(parsed: DataFrame) -> DataFrame:
    """(document_id, block_ord, message): a warning for each block over MOST_TOKENS."""
    text = F.format_string(L.OVERSIZED_CHUNK, "section_path", "tokens", F.lit(MOST_TOKENS))
    return parsed.where(F.col("tokens") > MOST_TOKENS).select("document_id", "block_ord", text.alias("message"))


def chunk_documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and warnings of all documents; a row without an id is an error when it is met."""
    known = F.when(F.col(id_col).isNull(), F.raise_error(F.lit("a document has no id"))).otherwise(F.col(id_col))
    parsed = blocks(docs.select(known.cast("bigint").alias("document_id"), F.col(text_col).alias("text")), "document_id", "text")
    return chunks(parsed), chunk_warnings(parsed)
