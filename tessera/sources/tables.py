"""Parquet tables, PDF bytes, gold sets and JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Intents of gold queries.
INTENTS = ["single_fact", "concept", "procedural", "comparison", "entity", "abstention", "heading"]
_CORPUS = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("corpus_fingerprint", T.StringType()), T.StructField("chunk_count", T.LongType())])
GOLD_SET = T.StructType([
    T.StructField("schema_version", T.StringType()), T.StructField("corpus", _CORPUS), T.StructField("documents", T.ArrayType(_CORPUS)),
    T.StructField("queries", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("intent", T.StringType()), T.StructField("query", T.StringType()),
        T.StructField("expected_chunk_ids", T.ArrayType(T.StringType())), T.StructField("expected_sections", T.ArrayType(T.StringType())),
        T.StructField("expected_no_evidence", T.BooleanType()),
    ]))),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pdf_status(content: Column) -> Column:
    """`ok`, `empty`, `not_pdf` or `encrypted`, by the bytes of a file."""
    body = F.decode(content, "ISO-8859-1")
    return (
        F.when(F.octet_length(content) == 0, "empty")
        .when(~F.substring(body, 1, 1024).contains("%PDF-"), "not_pdf")
        .when(body.contains("/Encrypt") & (body.contains("/Standard") | body.contains("/V ") | body.contains("/CF")), "encrypted")
        .otherwise("ok")
    )


def pdf_files(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """(path, length, status) of each file under path, `too_large` beyond most_bytes; Spark's scan leaves empty files out."""
    files = spark.read.format("binaryFile").load(path)
    status = pdf_status(F.col("content"))
    if most_bytes is not None:
        status = F.when(F.col("length") > most_bytes, "too_large").otherwise(status)
    return files.select("path", "length", status.alias("status"))


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    """(schema_version, id, intent, query, expected_chunk_ids, expected_sections, expected_no_evidence) of a JSON gold set."""
    return spark.read.schema(GOLD_SET).json(path, multiLine=True).select("schema_version", F.inline("queries"))


def gold_set_violations(gold: DataFrame) -> DataFrame:
    """(id, problem): repeated or empty ids, unknown intents, empty queries, and expected chunks that are there or lacking
    wrongly."""
    from pyspark.sql import Window as W

    n = F.size(F.coalesce("expected_chunk_ids", F.array().cast("array<string>")))
    none = F.coalesce("expected_no_evidence", F.lit(False))
    checked = gold.withColumn("_n", F.count("*").over(W.partitionBy("id")))
    problems = F.array_compact(F.array(
        F.when(F.coalesce("id", F.lit("")) == "", F.lit("empty id")), F.when(F.col("_n") > 1, F.lit("repeated id")),
        F.when(~F.coalesce("intent", F.lit("")).isin(*INTENTS), F.lit("unknown intent")),
        F.when(F.trim(F.coalesce("query", F.lit(""))) == "", F.lit("empty query")),
        F.when(none & (n > 0), F.lit("chunks expected of an abstention query")), F.when(~none & (n == 0), F.lit("no chunks expected")),
    ))
    return checked.select("id", F.explode(problems).alias("problem"))


RESULT_VERSION = "1.0.0"


def to_result(df: DataFrame) -> DataFrame:
    """(result): each row as a JSON object with its schema version, nulls kept."""
    rows = df.withColumn("schema_version", F.lit(RESULT_VERSION))
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("result"))


def from_result(results: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON results; one of another schema version, or that is no JSON object, is an error when it is met."""
    parsed = results.select(F.from_json("result", f"{schema}, schema_version string", {"mode": "PERMISSIVE"}).alias("r"))
    version = F.col("r.schema_version")
    checked = F.when(version.isNull() | (version != RESULT_VERSION), F.raise_error(F.concat(F.lit("results of schema version "), F.coalesce(version, F.lit("unknown"))))).otherwise(F.col("r"))
    return parsed.select(checked.alias("r")).select("r.*").drop("schema_version")


def write_result(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls kept, as the schema-versioned result sink."""
    to_result(df).write.mode("overwrite").text(path)


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return from_result(spark.read.text(path).withColumnRenamed("value", "result"), schema)


def pages_from_layout(raw: DataFrame) -> DataFrame:
    """(document_id, page_number, markdown) from a JSON layout: number falls back on place, markdown on text, and a
    document without pages is one page."""
    page = "array<struct<page_number:int,markdown:string,text:string>>"
    parsed = raw.withColumn("_pages", F.from_json(F.get_json_object("json_layout", "$.pages"), page))
    parsed = parsed.withColumn("_pages", F.when(F.size("_pages") > 0, F.col("_pages")).otherwise(F.array(F.struct(F.lit(1).alias("page_number"), F.col("markdown"), F.lit(None).cast("string").alias("text")))))
    exploded = parsed.select("document_id", F.posexplode("_pages").alias("_at", "p"))
    return exploded.select("document_id", F.coalesce("p.page_number", F.col("_at") + 1).alias("page_number"), F.coalesce("p.markdown", "p.text", F.lit("")).alias("markdown"))


#: A line without marks that is a heading if it is short: a number with a point, or capitals and digits up to a word's end.
PLAIN_HEADING = r"^(?:[0-9]+\.|[A-Z0-9][A-Z0-9 \t\x0B\f\r]{1,38}(?:[A-Z0-9](?:[^A-Za-z0-9_]|$)|[ \t\x0B\f\r][A-Za-z0-9_]))"
HEADING_CHARS = 60


def plain_markdown(text: Column) -> Column:
    """Markdown of a text whose extractor found no structure: trimmed lines that are not blank, a blank line between them,
    those that look like headings at level 2. Null is empty."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^[ \t\x0B\f\r]+|[ \t\x0B\f\r]+$", ""))
    marked = lambda x: F.when((F.length(x) < HEADING_CHARS) & x.rlike(PLAIN_HEADING), F.concat(F.lit("\n## "), x, F.lit("\n"))).otherwise(x)
    return F.array_join(F.transform(F.filter(lines, lambda x: x != ""), marked), "\n\n")


def plain_pages(texts: DataFrame) -> DataFrame:
    """(document_id, page_number, markdown) of texts (document_id, text, page_count): the lines of `plain_markdown` in equal
    shares, the last ones what is left; a page_count below 1 is 1."""
    lines = texts.select("document_id", F.split(plain_markdown(F.col("text")), "\n").alias("lines"), F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1)).alias("n"))
    share = F.ceil(F.size("lines") / F.col("n")).cast("int")
    pages = lines.select("document_id", "lines", share.alias("share"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("page_number"))
    return pages.select("document_id", "page_number", F.array_join(F.slice("lines", (F.col("page_number") - 1) * F.col("share") + 1, F.col("share")), "\n").alias("markdown"))
