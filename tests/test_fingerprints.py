"""Hash trees and fingerprints against hashlib, and outlines of plain text."""

import hashlib
import random
from collections import Counter

from tessera.operators import fingerprints as P
from tessera.sources.tables import plain_pages

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def plain_tree(hashes, depth):
    leaves: dict = {}
    for h, n in sorted(Counter(hashes).items()):
        leaves.setdefault(h[:depth], []).append(f"{h}:{n}")
    level = {k: sha("\n".join(v)) for k, v in leaves.items()}
    tree = dict(level)
    for d in range(depth - 1, -1, -1):
        above: dict = {}
        for k in sorted(level):
            above.setdefault(k[:d], []).append(f"{k}:{level[k]}")
        level = {k: sha("\n".join(v)) for k, v in above.items()}
        tree |= level
    return tree


def test_trees_equal_hashlib_and_updates_equal_new_trees(spark):
    rng = random.Random(1)
    rows = [sha(str(rng.randrange(400))) for _ in range(600)] + [sha("copy")] * 400
    frame = lambda x: spark.createDataFrame([(h,) for h in x], "hash string")
    for depth in (0, 1, 2):
        assert dict(map(tuple, P.hash_tree(frame(rows), depth).collect())) == plain_tree(rows, depth)
    gone, new = rows[:20], [sha(f"new {k}") for k in range(15)]
    after = rows[20:] + new
    tree = P.updated_tree(P.hash_tree(frame(rows), 2), frame(after), frame(gone + new), 2)
    assert dict(map(tuple, tree.collect())) == plain_tree(after, 2)
    assert P.hash_tree(frame([]), 2).count() == 0
    assert [P.tree_depth(n) for n in (0, 1024, 1025, 16_385)] == [0, 0, 1, 2]


def test_a_documents_fingerprint(spark):
    rows = [("a", sha("1")), ("a", sha("0")), ("a", sha("1")), ("b", sha("2"))]
    got = dict(map(tuple, P.document_fingerprints(spark.createDataFrame(rows, "doc string, hash string"), "doc").collect()))
    assert got == {"a": sha("\n".join(sorted([sha("1"), sha("0"), sha("1")]))), "b": sha(sha("2"))}


def test_pages_of_plain_text(spark):
    text = "INTRO PART\r\n 3. steps \n\n a plain line\nABC é\nABCdef is none\n" + "7. " + "x" * 70
    rows = [(1, text, 2), (2, None, 3), (3, "only", None), (4, "", -1)]
    got = {(r.document_id, r.page_number): r.markdown for r in plain_pages(spark.createDataFrame(rows, "document_id long, text string, page_count int")).collect()}
    whole = "\n\n".join(["\n## INTRO PART\n", "\n## 3. steps\n", "a plain line", "\n## ABC é\n", "ABCdef is none", "7. " + "x" * 70]).split("\n")
    half = -(-len(whole) // 2)
    assert got[1, 1] == "\n".join(whole[:half]) and got[1, 2] == "\n".join(whole[half:])
    assert [got[2, k] for k in (1, 2, 3)] == ["", "", ""] and (got[3, 1], got[4, 1]) == ("only", "")
