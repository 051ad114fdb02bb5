import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.conftest import words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_keep_clean_documents_and_pass_their_columns_on(spark, tmp_path):
    rng = random.Random(4)
    clean = [(k, words(rng, 80), "xx", f"s{k % 3}", 1) for k in range(40)]
    item = words(rng, 30)
    rows = clean + [(100, clean[0][1], "xx", "s0", 1), (101, clean[1][1] + " and more", "xx", "s1", 1), (102, words(rng, 40) + " " + item, "xx", "s2", 1), (103, "123 ...", None, "s1", 1), (104, None, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS
        docs.write.parquet(f"{tmp_path}/{len(left)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(left)}")
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    kept = {k for k in range(1, 40)}
    assert list(left.values()) == [kept | {0, 100, 101, 102}, kept | {100, 101, 102}, kept | {100, 102}, kept | {100}]
    mix = P.run(spark, str(tmp_path))
    assert mix.where(F.col("taken") <= 0).isEmpty() and {r.doc_id for r in mix.collect()} <= kept | {100}


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


def test_null_and_repeated_ids_in_every_stage(spark, tmp_path):
    rng = random.Random(6)
    x, y, z, item = (words(rng, 80) for _ in range(4))
    near = " ".join(["changed", *x.split()[1:]])
    full = lambda rows: spark.createDataFrame([(i, t, "xx", None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item), (None, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = lambda stage, rows: sorted(((r.doc_id, r.text) for r in stage(spark, full(rows), str(tmp_path)).collect()), key=str)
    rows = [(1, x), (5, x), (5, y), (5, y), (7, z), (None, z), (None, "only one"), (None, "only one"), (None, None), (8, "")]
    assert got(P.exact_stage, rows) == sorted([(5, x), (5, y), (7, z), (None, "only one"), (8, "")], key=str)
    rows = [(1, x), (5, near), (5, y), (None, z), (None, z + " more"), (9, None), (None, None), (7, y + " and")]
    kept = got(P.near_stage, rows)
    assert len(kept) == 5 and (9, None) in kept and (None, None) in kept
    assert sum(t in (x, near) for _, t in kept) == sum(t in (y, y + " and") for _, t in kept) == sum(t in (z, z + " more") for _, t in kept) == 1
    rows = [(1, x + " " + item), (5, item), (5, y), (None, z + " " + item), (None, z), (6, None)]
    assert got(P.decontamination_stage, rows) == sorted([(5, y), (None, z), (6, None)], key=str)
    rows = [(1, x), (1, x), (None, y), (2, None), (None, None)]
    mixed = P.mixing_stage(spark, full(rows), str(tmp_path)).collect()
    assert all(0 < r.taken <= 160 for r in mixed) and {r.doc_id for r in mixed} <= {1, None}
    assert len(got(P.language_stage, [(1, x), (1, x), (None, y), (2, "123"), (None, None), (3, z)])) == 4
