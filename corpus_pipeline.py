"""The corpus pipeline: five stages over `documents`, each written as Parquet and reread as the next one's input.

Every stage but the last returns the columns of documents for the rows that it keeps; the last returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contamination
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.language_id import identify
from tessera.llm.mixing import mix_sources
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.shared import ascii_lower, materialise, new_folder, table

#: A document whose languages are so evenly mixed that none has this share of its words is rejected.
LEAST_SCORE = 0.3
#: Near duplicates on word shingles, where no contract says otherwise.
SHINGLE, PERCENT = 5, 80


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (or null) and those without a main language."""
    marked = identify(docs, keep=[c for c in docs.columns if c != "doc_id"])
    return marked.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays, and of rows that repeat its id and text one."""
    told = exact_dedup(docs).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("_twin"))
    told = materialise(told.distinct(), "exact-dropped")
    mine = docs.withColumn("_text_hash", F.xxhash64(F.coalesce(ascii_lower(F.col("text")), F.lit(""))))
    same = mine["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_th"))
    out = mine.join(told.where("NOT _twin"), same, "left_anti")
    twins = told.where("_twin")
    if not twins.isEmpty():  # some of these rows stay: one for each id and text
        once = out.join(twins, same, "left_semi").dropDuplicates(["doc_id", "_text_hash"])
        out = out.join(twins, same, "left_anti").unionByName(once)
    return out.select(*docs.columns)


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key: the doc_id where it names one row alone, else a number made of the row's id and text."""
    again = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("_again"), F.lit(True).alias("_odd"))
    again = materialise(again, "odd-ids")
    if again.isEmpty():
        return docs.withColumn("_key", F.col("doc_id").cast("long"))
    odd = docs.join(again, docs["doc_id"].eqNullSafe(F.col("_again")), "left")
    return odd.withColumn("_key", F.when(F.col("_odd"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id").cast("long"))).drop("_again", "_odd")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays (where ids are null or repeat, any one)."""
    mine = keyed(docs)
    dropped = near_duplicates(mine, id_col="_key", shingle=SHINGLE, percent=PERCENT).where("NOT kept").select(F.col("doc_id").alias("_key")).distinct()
    return mine.join(dropped, "_key", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go."""
    mine = keyed(docs)
    leaks = contamination(mine, table(spark, sf_dir, "benchmark"), id_col="_key").select(F.col("doc_id").alias("_key")).distinct()
    return mine.join(leaks, "_key", "left_anti").select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which words are taken, and how many."""
    return mix_sources(docs).where("taken > 0")


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: SQL can't express a trained model and a local alignment; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written in the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = new_folder(spark, f"pipeline-{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
