"""Letters whose other case Spark writes in several letters, against the SQL of titles_and_authors."""

import duckdb

from tessera.plans import registry


def test_names_of_authors_keep_one_letter_for_one(spark, tmp_path):
    names = ["\u00dfein \u00df", "\ufb01n \ufb03", "\u0130zmir \u03a3\u039f\u03a3", "\u1f80 \u1f88 \u1fb3 \u0149", "\u00e4rger \u01c6 \u00fd", " ", "x  y"]
    rows = [(2 * i + 1, f"by {n}\nby other", "en", "src1", 9) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["titles_and_authors"](spark, str(tmp_path)).select("doc_id", "title", "author").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(registry.oracle_sql()["titles_and_authors"]).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert any("\u1e9e" in r.author for r in got)
