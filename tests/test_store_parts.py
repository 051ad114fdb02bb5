"""A part of many rows is written by several tasks."""

import os

from tessera.sources.storage import Table


def test_a_part_of_many_rows_is_written_by_several_tasks(spark, tmp_path):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    held = spark.conf.get(key)
    spark.conf.set(key, "32k")
    try:
        t = Table(spark, f"{tmp_path}/t", "document_id bigint, s string", ("document_id",), 1)
        t.commit(spark.range(20000, numPartitions=8).selectExpr("id AS document_id", "sha2(string(id), 256) AS s"))
    finally:
        spark.conf.set(key, held)
    (folder,) = t.folders[0]
    assert len([f for f in os.listdir(f"{tmp_path}/t/data/_commit={folder}/_part=0") if f.endswith(".parquet")]) > 1
    assert t.read().count() == 20000
