"""Blocks, chunks, assets and outlines on small texts whose records are known; arrays and names against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import assets as T
from tessera.operators import enrichment as N
from tessera.operators import indexing as I
from tessera.operators import retrieval as R
from tessera.operators import structure as S
from tessera.sources import tables

DOC = """intro [1] and [1]

# One
Note: mind the gap.
more of it

See the rest [Smith et al., 2020].
--- page 4 ---
```py
# no heading

--- page 9 ---
```
| a | b |

| c | d |
- item

2. item
$$
x

y
$$
$$z$$
![pic](a.png)
<!-- figure b -->
## Two
\f
last words"""


def test_blocks_of_all_kinds(spark):
    b = S.blocks(spark.createDataFrame([(1, DOC), (2, None), (3, " \n\n")], "id long, t string"), "id", "t").orderBy("document_id", "block_ord").collect()
    assert {x.document_id for x in b} == {1}
    assert [x.kind for x in b] == ["paragraph", "paragraph", "paragraph", "code", "table", "list", "equation", "equation", "figure", "figure", "paragraph"]
    assert [x.category for x in b] == ["narrative", "warning", "reference", "code", "table", "procedure", "equation", "equation", "figure", "figure", "narrative"]
    assert [x.page for x in b] == [1, 1, 1, 4, 4, 4, 4, 4, 4, 4, 5]
    assert b[0].citations == ["[1]"] and b[2].citations == ["[Smith et al., 2020]"] and b[0].section_path == "Document Overview" and b[-1].section_path == "One > Two" and b[-1].heading_level == 2
    assert b[4].content == "| a | b |\n| c | d |" and b[5].content == "- item\n2. item" and b[6].content == "$$\nx\n\ny\n$$"
    raw = DOC.encode()
    assert all(raw[x.start_offset : x.end_offset].decode().split() == x.content.split() for x in b)


def test_chunks_have_parents_children_and_flags(spark):
    big = " ".join(["word"] * 1000)
    text = f"# A\nfirst [2]\n\n| t | u |\n\nlast [2] [3]\n# B\n{big}\n\n{big}\n# C\nalone"
    chunks, warnings = S.chunk_documents(spark.createDataFrame([(7, text)], "id long, t string"), "id", "t")
    c = chunks.orderBy("chunk_order").collect()
    assert [(x.chunk_id, x.is_parent, x.content_type) for x in c] == [
        ("7/a/001", True, "paragraph"), ("7/a/002", False, "paragraph"), ("7/a/003", False, "table"), ("7/a/004", False, "paragraph"),
        ("7/b/001", True, "paragraph"), ("7/b/002", False, "paragraph"), ("7/b/003", False, "paragraph"), ("7/c/001", False, "paragraph"),
    ]
    assert c[0].child_ids == ["7/a/002", "7/a/003", "7/a/004"] and {x.parent_id for x in c[1:4]} == {"7/a/001"} and c[7].parent_id is None and c[7].child_ids == []
    assert c[0].citations == ["[2]", "[3]"] and c[0].pages == [1] and c[0].content == "first [2]\n\n| t | u |\n\nlast [2] [3]"
    assert [x.is_oversized for x in c] == [False, False, False, False, True, True, True, False]
    assert sorted(r.message for r in warnings.collect()) == ['oversized chunk encountered in section "B": token estimate 1300 exceeds absolute max limit 1200'] * 2
    assert c[0].character_count == len(c[0].content) and len({x.fingerprint for x in c}) == len(c) - 1  # two have the same text
    with pytest.raises(Exception, match="a document has no id"):
        S.chunk_documents(spark.createDataFrame([(None, "x")], "id long, t string"), "id", "t")[0].collect()


def test_slugs_take_letters_by_decomposition(spark):
    from tessera.functions import text as X

    words = ["Őrült čerň", "żółw", "İstanbul ı", "Ångström ỹ", "é a", "日本"]
    got = spark.createDataFrame([(w,) for w in words], "t string").select(X.slug(F.col("t")).alias("s")).collect()
    assert [r.s for r in got] == ["orult-cern", "zo-w", "istanbul", "angstrom-y", "e-a", "section"]


def test_assets_and_warnings(spark):
    text = 'é\nTable 2: x\n| a |\n| 1 |\n<TABLE>no</TABLE>\n<table>yes</table>\n![c d](u.png "t") <img a src="s" alt=\'q\'>\n<img broken\n~~~\n```\n~~~\n``` js\nopen \\[ e \\] $$f$$'
    rows = T.find(text)
    named = {r[0]: r for r in rows if r[0]}
    assert [r[0] for r in rows if r[0]] == ["tbl-1", "tbl-2", "fig-1", "fig-2", "code-1", "code-2", "eq-1", "eq-2"]
    assert named["tbl-1"][7] == {"caption": "Table 2: x", "headers": ["a"], "content": "| a |\n| 1 |"} and named["tbl-1"][4] == len("é\nTable 2: x\n".encode())
    assert named["fig-1"][7] == {"caption": "c d", "uri": "u.png"} and named["fig-2"][7] == {"caption": "q", "uri": "s"}
    assert named["code-1"][7] == {"language": "", "content": "```"} and named["code-2"][7]["language"] == "js" and named["eq-1"][7]["content"] == "e"
    assert sorted(r[7]["content"] for r in rows if r[1] == "warning") == ["malformed HTML image tag encountered: <img broken", "malformed HTML table block encountered"]
    assert [r[3] for r in rows if r[0]] == list(range(1, 9))


def test_citations_at_one_place_count_once():
    text = "# References\n[1] Smith et al. 2020\n* Book\n\n# Next\n[^a]: note [7]\nsee [^a] and [7], ISBN: 978-1\nExcerpt from [7]"
    got = [(r[0], r[2], r[7]["content"]) for r in T.find(text)]
    assert got == [
        ("cit-1", "bibliography", "[1] Smith et al. 2020"), ("cit-2", "bibliography", "* Book"), ("cit-3", "footnote", "[^a]: note [7]"), ("cit-6", "inline", "[7]"),
        ("cit-4", "footnote", "[^a]"), ("cit-7", "inline", "[7]"), ("cit-5", "attribution", "ISBN: 978-1"), ("cit-9", "attribution", "Excerpt from [7]"), ("cit-8", "inline", "[7]"),
    ]


def test_outline_of_skipped_levels_and_pages(spark):
    text = "before\n# A\none\n\f\ntwo\n### C\n#\n## B\n[page 8]\nend"
    nodes = S.marked_lines(S.lines(spark.createDataFrame([(1, text), (2, "only text"), (3, "")], "id long, t string"), "id", F.col("t")))
    o = S.outline(nodes).orderBy("document_id", "ord").collect()
    assert [(x.node_id, x.level, x.heading, x.parent_ord, x.page_numbers) for x in o] == [
        ("sec-1", 1, "A", None, [1, 2]), ("sec-2", 3, "C", 1, [2]), ("sec-3", 1, "Untitled Section", None, [2, 8]), ("sec-4", 2, "B", 6, [2, 8]), ("sec-1", 1, "Document Overview", None, [1]),
    ]
    w = S.outline_warnings(nodes).orderBy("document_id", "ord", "message").collect()
    assert [(x.document_id, x.ord, x.message.split(" ")[0]) for x in w] == [(1, 1, "preamble"), (1, 5, "heading"), (1, 6, "empty"), (2, 0, "preamble")]


def test_linear_passes_over_arrays(spark):
    rng = random.Random(1)
    lists = [[rng.randint(0, 900) for _ in range(rng.randint(0, 30))] for _ in range(50)] + [None, []]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k int, n array<bigint>")
    for r, x in zip(df.select("k", A.sums_before("n").alias("s"), A.greedy_groups(700)("n").alias("g")).orderBy("k").collect(), lists, strict=True):
        x = x or []
        assert r.s == [sum(x[:k]) for k in range(len(x))]
        groups, held = [], None
        for n in x:
            fits = held is not None and held + n <= 700
            held = held + n if fits else n
            groups.append(groups[-1] if fits else len(set(groups)) + 1)
        assert r.g == groups


def test_names_are_found_anywhere_in_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé c") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, ""]
    names = {"".join(rng.choice("abé C") for _ in range(rng.randint(1, 7))) for _ in range(60)} | {"zzzz", "日本", ""}
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {(r.chunk_id, r.name) for r in N.named_in(docs, spark.createDataFrame([(n,) for n in names], "name string"), "i", "t").collect()}
    assert got == {(k, n) for k, t in enumerate(texts) for n in names if n and n.lower() in (t or "").lower()} and len(got) > 100
    assert N.named_in(docs, spark.createDataFrame([], "name string"), "i", "t").collect() == []


def test_blocks_of_sparse_products_equal_the_join(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), f"t{t}", float(np.float32(rng.random() + 0.1))) for i in range(120) for t in rng.choice(40, rng.integers(0, 9), replace=False)]
    index = spark.createDataFrame(rows, "id long, term string, weight float")
    want = R.sparse_search(index.where("id % 3 = 0"), index, 7)
    got = R.sparse_self_search(index, F.col("id") % 3 == 0, 7, 120, 40, query_rows=9, block_rows=25)
    key = ["query_id", "id", "score", "rank"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))


def test_dense_search_of_many_queries_in_tiles(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 4)]) for k in range(600)]
    points = spark.createDataFrame(rows, "id long, vector array<float>")
    queries = points.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = {(r.query_id, r["rank"]): r.id for r in R.dense_search(queries, points, 3, query_rows=90, block_rows=70, tile=16).collect()}
    v = np.array([x for _, x in rows])
    n = np.sqrt((v * v).sum(1))
    sims = np.round(np.divide(v @ v.T, n[:, None] * n, out=np.zeros((600, 600)), where=n[:, None] * n > 0), 6)
    assert all(got[k, j + 1] == i for k in range(600) for j, i in enumerate(np.lexsort((np.arange(600), -sims[k]))[:3]))


def test_results_of_another_version_are_an_error(spark, tmp_path):
    tables.write_result(spark.createDataFrame([(1, None)], "a long, b string"), f"{tmp_path}/r")
    assert tables.read_result(spark, f"{tmp_path}/r", "a long, b string").collect() == [(1, None)]
    for text in ('{"a": 1, "schema_version": "9"}', '{"a": 1}', "no json"):
        with pytest.raises(Exception, match="schema version"):
            tables.from_result(spark.createDataFrame([(text,)], "result string"), "a long").collect()


