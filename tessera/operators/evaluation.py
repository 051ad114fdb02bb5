"""Retrieval evaluation: ranked metrics, abstention, percentiles, gates and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ranked_metrics(hits: DataFrame, totals: DataFrame, k: int, places: int = 6) -> DataFrame:
    """(query_id, recall, precision, mrr, ndcg) of hits (query_id, rank, relevant); totals (query_id, n) has the number of
    relevant ids of each query, so the judgements themselves are not expanded."""
    found = hits.where("relevant").groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("hit"), F.min("rank").alias("first"),
        F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), places)
    return totals.where("n > 0").join(found, "query_id", "left").select(
        "query_id", r(F.col("hit") / F.col("n")).alias("recall"), r(F.col("hit") / F.lit(k)).alias("precision"),
        r(1 / F.col("first")).alias("mrr"), r(F.col("dcg") / ideal).alias("ndcg"),
    )


def no_evidence_precision(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """One row: the share of abstention queries for which nothing was retrieved."""
    n = queries.join(hits.select("query_id").distinct().withColumn("hit", F.lit(1)), "query_id", "left")
    return n.agg(F.avg(F.when(F.col("hit").isNull(), 1.0).otherwise(0.0)).alias("no_evidence_precision"))


def kill_gate(combinations: DataFrame, baseline: DataFrame, most_p95: float, most_rss: float, gain: float = 1.0, mrr_loss: float = 0.5, verified_loss: float = 1.0, tolerance: float = 0.05) -> DataFrame:
    """The accepted combination (model, candidates): the least candidate budget within tolerance of the best nDCG.

    Gains and losses are in percentage points against the one-row baseline.
    """
    b = baseline.select(*[F.col(c).alias(f"_{c}") for c in ("ndcg", "mrr", "verified")])
    ok = (
        F.col("aligned") & ((F.col("ndcg") - F.col("_ndcg")) * 100 >= gain) & ((F.col("mrr") - F.col("_mrr")) * 100 >= -mrr_loss)
        & ((F.col("verified") - F.col("_verified")) * 100 >= -verified_loss) & (F.col("p95_ms") <= most_p95) & (F.col("rss") <= most_rss)
    )
    accepted = combinations.crossJoin(F.broadcast(b)).where(ok)  # the baseline is one row
    best = accepted.agg(F.max("ndcg").alias("_best"))
    near = accepted.crossJoin(F.broadcast(best)).where(F.col("ndcg") >= F.col("_best") * (1 - tolerance))
    return near.orderBy("candidates", "model").limit(1).select("model", "candidates", "ndcg")


def bootstrap_interval(deltas: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """(mean, low, high): a 95 % interval of the mean of column delta, by Poisson resampling weights from a hash of row and
    resample, so that it is made of partial sums and repeats exactly. Resamples are summed side by side inside the scan's
    tasks: what is shuffled is two numbers a resample and task, not a row for each pair."""
    import numpy as np
    import pyarrow as pa

    def sums(batches):
        total, weight = np.zeros(resamples), np.zeros(resamples)
        step = np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for key, delta in zip(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False), strict=True):
                x = (step + key) ^ ((step + key) >> np.uint64(30))
                x = x * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)
                # the inverse of the Poisson distribution function with mean 1, without an end
                w, p, below, n = np.zeros(resamples), np.exp(-1.0), np.exp(-1.0), 0
                while (more := u >= below).any() and p > 0:
                    w[more] += 1
                    n += 1
                    p /= n
                    below += p
                total += w * delta
                weight += w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(total), pa.array(weight)], ["resample", "total", "weight"])

    rows = deltas.where("delta IS NOT NULL").select(F.xxhash64("query_id", F.lit(seed)).alias("key"), F.col("delta").cast("double").alias("delta"))
    parts = rows.mapInArrow(sums, "resample long, total double, weight double")
    means = parts.groupBy("resample").agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return deltas.agg(F.avg("delta").alias("mean")).crossJoin(ends)


def run_metrics(per_query: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of means over queries (query_id, recall, precision, mrr, ndcg, retrieved) of a gold set (query_id, abstain):
    abstention queries count for no_evidence_precision only, the others for the ranked measures only."""
    joined = gold.join(per_query, "query_id", "left")
    ranked = lambda c: F.round(F.coalesce(F.avg(F.when(~F.col("abstain"), F.coalesce(c, F.lit(0.0)))), F.lit(0.0)), 6).alias(c)
    nothing = F.avg(F.when(F.col("abstain"), (F.coalesce("retrieved", F.lit(0)) == 0).cast("double")))
    return joined.agg(F.count("*").alias("queries"), F.sum(F.col("abstain").cast("long")).alias("abstention_queries"), *map(ranked, ("recall", "precision", "mrr", "ndcg")), F.round(nothing, 6).alias("no_evidence_precision"))


def gate_repetition(runs: DataFrame) -> DataFrame:
    """(query_id, decision, latency_ms, retries) of repeated gate runs (query_id, run, decision, latency_ms, retries): the
    lower median decision, the mean latency of all runs, and the retries of the first run with that decision."""
    from tessera.operators.answers import lower_median_decision

    grouped = runs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("run", "decision", "retries"))).alias("r"), F.avg("latency_ms").alias("latency"))
    grouped = grouped.withColumn("decision", lower_median_decision(F.col("r.decision")))
    first = F.get(F.filter("r", lambda x: x["decision"] == F.col("decision")), F.lit(0))["retries"]
    return grouped.select("query_id", "decision", F.round("latency", 3).alias("latency_ms"), first.alias("retries"))


def representation_gate(results: DataFrame, base: str = "a", gain: float = 1.0, loss: float = 0.05) -> DataFrame:
    """(representation, ndcg_new, ndcg_old): the best representation that gains gain points of nDCG on the new set over the
    base and loses no more than the share loss of it on the old one; no row where none does. results has a row for each
    representation."""
    b = results.where(F.col("representation") == base).select(F.col("ndcg_new").alias("_new"), F.col("ndcg_old").alias("_old"))
    lost = F.when(F.col("_old") > 0, (F.col("_old") - F.col("ndcg_old")) / F.col("_old")).otherwise(0.0)
    ok = results.where(F.col("representation") != base).crossJoin(F.broadcast(b)).where(((F.col("ndcg_new") - F.col("_new")) * 100 >= gain) & (lost <= loss))  # the base is one row
    return ok.orderBy(F.col("ndcg_new").desc(), "representation").limit(1).select("representation", "ndcg_new", "ndcg_old")


def sweep(ranked: DataFrame, models: DataFrame, budgets: list[int], totals: DataFrame, k: int, gated: DataFrame | None = None) -> DataFrame:
    """(model, candidates, query_id, recall, precision, mrr, ndcg) of every model and candidate budget: the first budget hits
    (query_id, id, rank, relevant) of a query in the order of the model's scores (model, query_id, id, score). A query
    outside gated (query_id) keeps its order whatever the model."""
    hits = ranked.join(models, ["query_id", "id"]).withColumn("candidates", F.explode(F.array(*map(F.lit, budgets)))).where(F.col("rank") <= F.col("candidates"))
    if gated is not None:
        hits = hits.join(gated.select("query_id", F.lit(True).alias("_g")), "query_id", "left")
    own = F.when(F.col("_g").isNull(), -F.col("rank").cast("double")).otherwise(F.col("score")) if gated is not None else F.col("score")
    from pyspark.sql import Window as W

    order = W.partitionBy("model", "candidates", "query_id").orderBy(own.desc(), "id")
    again = hits.withColumn("rank", F.row_number().over(order)).withColumn("_q", F.struct("model", "candidates", "query_id"))
    combos = again.select("_q").distinct()
    n = combos.withColumn("query_id", F.col("_q.query_id")).join(totals, "query_id").select(F.col("_q").alias("query_id"), "n")
    found = ranked_metrics(again.select(F.col("_q").alias("query_id"), "rank", "relevant"), n, k)
    return found.select("query_id.*", "recall", "precision", "mrr", "ndcg")
