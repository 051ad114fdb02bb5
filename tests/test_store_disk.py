"""What the store shuffles and leaves behind: layered rows are merged by keys, texts are weighed in blocks, scratch goes."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays as A
from tessera.operators import indexing as I
from tessera.operators import statistics as Z
from tessera.sources.storage import Table


def test_long_rows_of_layers_are_merged_without_a_shuffle_of_what_stands(spark, tmp_path, monkeypatch):
    rows = lambda ids, s: spark.createDataFrame([(k, "p", s * 3) for k in ids], "document_id bigint, point_id string, content string")
    t = Table(spark, f"{tmp_path}/t", "document_id bigint, point_id string, content string", ("document_id", "point_id"), 3)
    t.commit(rows(range(60), "a"))
    t.commit(rows(range(40, 80), "b"), rows(range(10), "").select("document_id", "point_id"))
    t.commit(rows([0, 41, 90], "c"), rows([50], "").select("document_id", "point_id"))
    known = {k: "a" for k in range(10, 40)} | {k: "b" for k in range(40, 80) if k not in (41, 50)} | {0: "c", 41: "c", 90: "c"}
    found = lambda: sorted(tuple(r) for r in t.read().collect())
    assert found() == sorted((k, "p", v * 3) for k, v in known.items())
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert "max_by" not in plan  # nothing was left to merge
    monkeypatch.setattr(A, "_places", lambda values: (values % 4).astype("uint64"))  # crowded bitmaps let rows pass that are merged
    monkeypatch.setattr(A, "has", lambda bits, values: values % 4 >= 0)
    monkeypatch.setattr(A, "among", lambda bits: lambda column: F.lit(True))
    assert found() == sorted((k, "p", v * 3) for k, v in known.items())


def test_a_block_is_weighed_as_its_texts_are():
    texts = pa.table({"document_id": pa.array([1, 2, 3, 4]), "point_id": ["p"] * 4, "length": pa.array([3, 0, 0, 4], pa.int32()), "words": ["a b", "", None, "a zz"], "uses": pa.array([[1, 2], [], None, [3, 1]], pa.list_(pa.int32())), "avg_length": [3.5] * 4, "stats_version": ["v"] * 4})
    known = pa.table({"term": ["a", "b", "zz", "a"], "idf": pa.array([0.5, 2.0, None, 0.5])})
    got = Z._weigh_block(known, texts).to_pylist()
    w = lambda idf, tf, n: pytest.approx(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 3.5)), rel=1e-6)
    assert [r["terms"] for r in got] == [[{"term": "a", "tf": 1, "weight": w(0.5, 1, 3)}, {"term": "b", "tf": 2, "weight": w(2.0, 2, 3)}], [], [], [{"term": "a", "tf": 3, "weight": w(0.5, 3, 4)}, {"term": "zz", "tf": 1, "weight": None}]]
    batch = pa.record_batch({"block": pa.array([7, 7, 8]), "terms": pa.array([["a", "b"], ["a"], ["a"]], pa.list_(pa.string()))})
    assert sorted((r["block"], r["term"]) for b in Z._distinct_terms([batch]) for r in b.to_pylist()) == [(7, "a"), (7, "b"), (8, "a")]


def test_postings_are_not_collected_by_text_and_repeated_keys_are_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Z, "BLOCK_TERMS", 4)
    monkeypatch.setattr(Z, "BLOCK_TEXTS", 2)
    stats = Z.Statistics(spark, f"{tmp_path}/s", 2)
    kind = "document_id long, point_id string, text string"
    stats.update(spark.createDataFrame([(1, "p", "a b a"), (2, "p", None), *((k, "p", f"a w{k} x{k % 3}") for k in range(3, 30)), (None, "p", "a c"), (None, "p", "c d"), (7, "q", "a"), (7, "q", "a")], kind))
    stats.update(spark.createDataFrame([(5, "p", "new a")], kind))
    plan = stats.postings()._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "FlatMapCoGroupsInArrow" in plan
    held = {(r.document_id, r.point_id): sorted(t.term for t in r.terms) for r in stats.texts.read().collect()}
    assert len(held) == stats.texts.read().count() == 31
    assert held[1, "p"] == ["a", "b"] and held[2, "p"] == [] and held[5, "p"] == ["a", "new"] and held[None, "p"] == ["a", "c", "c", "d"] and held[7, "q"] == ["a", "a"]
    assert {r.term: r.df for r in stats.frequencies.read().collect()}["a"] == 31
    assert stats.postings().select("stats_version").distinct().count() == 1


def test_tables_that_no_plan_reads_again_are_deleted(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    index = I.Index(spark, f"{tmp_path}/index", 2)
    rows = spark.createDataFrame([(k, f"c{k}", f"Acme Corp text {k}") for k in range(9)], "document_id long, chunk_id string, content string")
    I.index_documents(index, rows)
    plan = I.index_documents(index, rows.where("document_id < 6"))
    assert {n.rsplit("-", 1)[0] for n in {*os.listdir(folder)} - there} <= {"plan", "again"}
    assert plan.groupBy("action").count().count() == 2 and index.points.read().count() == 6
