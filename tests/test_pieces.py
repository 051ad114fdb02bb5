"""Workers give rows back in pieces, and scans encode and run no more than they must."""

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import assets as T
from tessera.operators import structure as S


def test_rows_come_back_in_pieces(monkeypatch):
    monkeypatch.setattr(A, "PIECE", 10)
    seen = []

    def texts():
        for k in range(100):
            seen.append(k)
            yield 5, [(k, f"r{k}")] * (k % 3)

    pieces = A.in_pieces(texts(), ["a", "b"], [pa.int64(), pa.string()])
    first = next(pieces)
    assert len(seen) <= 4 and first.num_rows == 1  # the first piece is there before most texts are read
    rest = list(pieces)
    assert max(b.num_rows for b in rest) <= 4 and len(rest) > 20
    assert [r["a"] for b in [first, *rest] for r in b.to_pylist()] == [k for k in range(100) for _ in range(k % 3)]


def test_term_counts_do_not_depend_on_pieces(monkeypatch):
    texts = pa.array(["a b a", None, "", "Été c3 c3", "x " * 50, "a"])
    whole = A.term_frequencies.func(texts)
    made = []
    real = pa.concat_arrays
    monkeypatch.setattr(A, "PIECE", 4)
    monkeypatch.setattr(A.pa, "concat_arrays", lambda parts: made.append(len(parts)) or real(parts))
    assert A.term_frequencies.func(texts).to_pylist() == whole.to_pylist()
    assert made[0] == 4 and [r["length"] for r in whole.to_pylist()] == [3, 0, 0, 3, 50, 1]


def test_bytes_before_places():
    text = "aé\U0001f600b\ud800c"
    every = list(range(len(text) + 1))
    want = {k: len(text[:k].encode("utf-8", "surrogatepass")) for k in every}
    assert T.bytes_before(text, every) == want and T.bytes_before(text, [2, 5]) == {2: want[2], 5: want[5]}
    assert T.bytes_before("abc", [0, 3]) == {0: 0, 3: 3}


def test_assets_are_scanned_once_for_their_places(spark):
    docs = spark.createDataFrame([(1, "# A\n![a](b)\n$$x$$"), (2, "plain")], "doc_id bigint, text string")
    lines = S.section_of_lines(S.lines(docs, "doc_id", F.col("text")))
    pages = spark.createDataFrame([(1, 1, 0, 8), (1, 2, 9, 30)], "document_id bigint, page_number int, r_start bigint, r_end bigint")
    chunks = spark.createDataFrame([(1, "c0", 0, 30)], "document_id bigint, chunk_id string, r_start bigint, r_end bigint")
    got = T.placed(T.assets(docs, "doc_id", "text"), lines, pages, chunks)
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    rows = {r.asset_id: (r.section_path, r.page_number, r.page_numbers, r.related_chunk_ids) for r in got.collect()}
    assert rows == {"fig-1": ("A", 1, [1, 2], ["c0"]), "eq-1": ("A", 2, [2], ["c0"])}
