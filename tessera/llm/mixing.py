"""Mixing sources to target weights by a low-discrepancy schedule.

Each source gets a target number of words (weights share a multiple of all words; a target stops at a multiple of the
source's size, and the excess is shared again by weight). A source's documents are shuffled by a hash and laid end to
end, and the line is cut into blocks of equal numbers of words. The golden-ratio sequence ``frac(t * phi)`` is mapped
through the cumulative targets: point t belongs to the source in whose interval it falls, so every stretch of the
schedule mixes the sources near their weights. Slots are ranked per source, and slot k takes block k modulo the
number of blocks; a document's words are taken once for each time that a block with them is.

A source may hold any share of the rows: running totals and ranks are made of windows over parts whose number follows
the rows. Targets are found by rounds of one aggregate over the table of sources, which stays in Spark.

Defined cases: a null source is a source of its own, last in order; null and empty texts have size 0 and are never
taken; sources without words have target 0; rows that repeat are documents of their own; other columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import materialise, running_total, slices, table
from tessera.llm.wordscan import SPACE

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Words in a block, about.
BLOCK = 256
#: A source has so many blocks at least, or one for each word.
LEAST_BLOCKS = 64
#: Neighbouring slots that are ranked together; what came before them is a sum.
STRETCH = 4096
#: The golden ratio's fraction, as a 32-bit step: frac(t * phi) is t * STEP modulo 2^32, over 2^32.
STEP = 2654435769


@F.arrow_udf(T.LongType())
def word_count(text: pa.Array) -> pa.Array:
    """Runs of bytes outside space and 09-0D."""
    out = []
    for _, buf, off in slices(text):
        inside = ~SPACE[buf]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        first = off[:-1][off[:-1] < len(buf)]
        begins[first] = inside[first]
        so_far = np.append(0, np.cumsum(begins))
        out.append(so_far[off[1:]] - so_far[off[:-1]])
    return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): sources has source and source_size, a row for each source."""
    # the table of sources is as small as their number, so one ordered window over it is enough
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    rows = materialise(rows.withColumn("capped", F.lit(False)), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    while True:
        left = rows.agg(F.sum(F.when(F.col("capped"), F.col("source_size") * most).otherwise(0.0)).alias("given"), F.sum(F.when(~F.col("capped"), F.col("weight"))).alias("open")).first()
        level = max(0.0, share * total - (left["given"] or 0.0)) / left["open"] if left["open"] else 0.0
        over = ~F.col("capped") & (F.lit(level) * F.col("weight") > F.col("source_size") * most)
        if rows.where(over).isEmpty():
            target = F.when(F.col("capped"), (F.col("source_size") * most).cast("double")).otherwise(F.lit(level) * F.col("weight"))
            return rows.select("source", "source_size", target.alias("target"))
        rows = materialise(rows.withColumn("capped", F.col("capped") | over), "sources")


def slots(plan: DataFrame, n_slots: int) -> DataFrame:
    """(sid, k): the slots of each source, ranked from 0, in as many as the source needs.

    plan has sid, low, high (the source's interval of [0, 2^32)) and need. The schedule is longer than the sum of the
    needs, so that each source has enough slots; what rounding still leaves out is added at the end.
    """
    spark = plan.sparkSession
    cells = plan.where("high > low").select("sid", "low", "high", F.explode(F.sequence(F.shiftright("low", 20), F.shiftright(F.col("high") - 1, 20))).alias("cell"))
    point = (F.col("id") % 2**31) * F.lit(STEP) % 2**32
    line = spark.range(n_slots).select(F.col("id").alias("t"), point.alias("point"), F.shiftright(point, 20).alias("cell"), F.floor(F.col("id") / STRETCH).alias("stretch"))
    owned = line.join(cells, "cell").where("point >= low AND point < high")
    counts = owned.groupBy("sid", "stretch").agg(F.count("*").alias("n"))
    before = W.partitionBy("sid").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("sid", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("sid", "stretch").orderBy("t")
    ranked = owned.join(base, ["sid", "stretch"]).select("sid", "t", (F.col("base") + F.row_number().over(inside) - 1).alias("k"))
    ranked = ranked.join(plan.select("sid", "need"), "sid").where("k < need").select("sid", "k")
    had = counts.groupBy("sid").agg(F.sum("n").alias("had"))
    rest = plan.join(had, "sid", "left").where("need > coalesce(had, 0)").select("sid", F.explode(F.sequence(F.coalesce("had", F.lit(0)), F.col("need") - 1)).alias("k"))
    return ranked.unionByName(rest)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = materialise(rows, "sizes")  # from here on row is fixed
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = wanted.withColumns({"sid": F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()), "blocks": F.greatest(F.ceil(F.col("source_size") / block), F.least(F.col("source_size"), F.lit(LEAST_BLOCKS))).cast("long")})
    plan = plan.withColumn("need", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")), F.col("blocks") * most)).otherwise(0).cast("long"))
    up_to = F.sum("need").over(W.orderBy("sid"))  # over the table of sources
    plan = plan.withColumns({"up": up_to, "all": F.sum("need").over(W.partitionBy())})
    scale = lambda x: F.when(F.col("all") > 0, F.floor(x.cast("double") * 2**32 / F.col("all"))).otherwise(0).cast("long")
    plan = materialise(plan.withColumns({"low": scale(F.col("up") - F.col("need")), "high": scale(F.col("up"))}).drop("up", "all"), "mix-plan")
    total = plan.agg(F.sum("need")).first()[0] or 0
    schedule = slots(plan, int(total * 1.02) + 64)
    uses = schedule.join(plan.select("sid", "blocks"), "sid").groupBy("sid", (F.col("k") % F.col("blocks")).alias("block")).agg(F.count("*").alias("uses"))

    sid = F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())
    placed = running_total(rows.where("size > 0").select("doc_id", "row", sid.alias("sid"), "size", F.xxhash64("doc_id").alias("h")), "sid", "h", "size", "start", ("doc_id", "row"))
    placed = placed.join(plan.select("sid", "source_size", "blocks"), "sid")
    # block b starts at word b * source_size div blocks; the first and last blocks of a document are found to within one
    of = lambda word: F.floor(word.cast("double") * F.col("blocks") / F.col("source_size")).cast("long")
    cut = placed.select("row", "sid", "size", "start", "source_size", "blocks", F.explode(F.sequence(F.greatest(of(F.col("start")) - 1, F.lit(0)), F.least(of(F.col("start") + F.col("size")) + 1, F.col("blocks") - 1))).alias("block"))
    begin, end = (F.expr(f"cast((cast({b} as decimal(20,0)) * source_size) div blocks as bigint)") for b in ("block", "block + 1"))
    cut = cut.withColumn("words", F.least(F.col("start") + F.col("size"), end) - F.greatest("start", begin)).where("words > 0")
    taken = cut.join(uses, ["sid", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("uses")).cast("long").alias("taken"))
    sized = rows.withColumn("sid", sid).join(plan.select("sid", "source_size", "target"), "sid")
    out = sized.join(taken, "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
