"""Warnings of outlines come from one pass over each document, of which only what they need is shuffled."""

import random

from pyspark.sql import functions as F

from tessera.operators import structure as S


def plan(df):
    """Before it runs, also of a table that has run already."""
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def warned(nodes):
    """Plain version for one document's nodes (ord, level, heading, page) in order."""
    out, above, seen, text = [], [], False, False
    for at, (order, level, heading, page) in enumerate(nodes):
        if level is None:
            text = True
            if not seen and at == len(nodes) - 1:
                out.append((order, f"preamble text detected before first heading node at page {page}"))
            continue
        if not seen and text:
            out.append((order, f"preamble text detected before first heading node at page {page}"))
        seen = True
        above = [x for x in above if x < level]
        if heading == "":
            out.append((order, f"empty heading text encountered at page {page}"))
        if above and level > above[-1] + 1:
            out.append((order, f"heading level skipped: expected level {above[-1] + 1} before level {level} for heading '{heading or 'Untitled Section'}'"))
        above.append(level)
    return out


def documents():
    rng = random.Random(3)
    for d in range(60):
        heads = rng.choice((0, 0.2, 0.8, 1))
        yield d, [(2 * k, level, rng.choice(("", "A", "b c")) if level else None, 1 + k // 3) for k in range(rng.randint(1, 12)) for level in [rng.randint(1, 6) if rng.random() < heads else None]]


def test_warnings_are_one_pass(spark):
    rows = [(d, *n) for d, nodes in documents() for n in nodes]
    nodes = spark.createDataFrame(rows, "document_id long, ord int, level int, heading string, page int")
    got = S.outline_warnings(nodes)
    assert sorted(map(tuple, got.collect())) == sorted((d, *w) for d, n in documents() for w in warned(n))
    assert plan(got).count("Exchange hashpartitioning") == 1 and "Union" not in plan(got)


def test_layout_warnings_read_layouts_once(spark):
    layout = '{"nodes":[{"type":"text","page":0},{"type":"heading","text":"A"},{"type":"header","level":3,"text":" ","page":-2},{"type":"aside","page":4}]}'
    raw = spark.createDataFrame([(1, layout), (2, '{"nodes":[]}'), (3, None)], "document_id long, json_layout string")
    got = S.layout_warnings(S.layout_nodes(raw))
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 0, "ambiguous page reference 0 in JSON layout node"), (1, 2, "ambiguous page reference -2 in JSON layout node"), (1, 2, "empty heading text encountered at page 1"),
        (1, 2, "heading level skipped: expected level 2 before level 3 for heading 'Untitled Section'"), (1, 3, "unmapped custom layout node type: 'aside' on page 4"),
    ]
    assert plan(got).count("Exchange hashpartitioning") == 1 and "Union" not in plan(got)


def test_lines_are_not_shuffled(spark):
    text = "\t\n \f\nx\n--- PAGE 7 ---\n  [Page 9] y\n## B \n<!-- PageBreak -->\nseen on page 3\n#\t\n#no\n<!--page:2--> and more\n####### seven\nend\f\nlast"
    docs = spark.createDataFrame([(1, text), (2, None), (3, " ")], "id long, t string")
    nodes = S.marked_lines(S.lines(docs, "id", F.col("t"), offsets=False))
    assert [tuple(r) for r in nodes.orderBy("ord").collect()] == [
        (1, 2, None, None, 2), (1, 5, 2, "B", 9), (1, 7, None, None, 10), (1, 8, 1, "", 10), (1, 9, None, None, 10), (1, 11, None, None, 2), (1, 13, None, None, 3),
    ]
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, S.marked_lines(S.lines(docs, "id", F.col("t"))).collect()))
    assert "ArrowEvalPython" not in plan(nodes)
    above, below = plan(nodes).split("Exchange hashpartitioning")
    assert "RLIKE" not in above and "line#" not in above and "RLIKE" in below
