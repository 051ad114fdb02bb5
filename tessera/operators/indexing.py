"""Differential indexing: diff plans, upserts, content lookup and entity nodes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff_plan(existing: DataFrame, incoming: DataFrame, key: str = "point_id", signature: str = "signature") -> DataFrame:
    """(key, action): `unchanged`, `modified`, `new` or `deleted`, by one full outer join."""
    old = existing.select(key, F.col(signature).alias("_old"), F.lit(True).alias("_had"))
    new = incoming.select(key, F.col(signature).alias("_new"), F.lit(True).alias("_has"))
    action = (
        F.when(F.col("_had").isNull(), "new").when(F.col("_has").isNull(), "deleted")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("modified")
    )
    return old.join(new, key, "full").select(key, action.alias("action"))


def progress(plan: DataFrame, done: DataFrame, key: str = "point_id") -> DataFrame:
    """One row of a job's state from its plan and the keys that are done: indexed, skipped and deleted points, and the
    percentage of the incoming ones that are indexed or skipped, 100 where none come in."""
    joined = plan.join(done.select(key, F.lit(True).alias("_done")), key, "left")
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    work, same = F.col("action").isin("new", "modified"), F.col("action") == "unchanged"
    counts = joined.agg(n(work & F.col("_done")).alias("indexed"), n(same).alias("skipped"), n(F.col("action") == "deleted").alias("deleted"), n(work | same).alias("total"))
    return counts.withColumn("percent", F.when(F.col("total") == 0, 100.0).otherwise(F.round(100 * (F.col("indexed") + F.col("skipped")) / F.col("total"), 3)))


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows whose keys don't arrive, and all that arrive."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming.select(*stored.columns))


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    """Of each key's rows the last by order, without a window: a maximum of structs, combined before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(key).agg(best).select(key, "_r.*")


def entity_nodes(mentions: DataFrame, floor: float = 0.9) -> DataFrame:
    """(name, canonical_name, entity_type, score, evidence) of mentions (chunk_id, text, type): 0.8 and 0.1 for each
    further mention, 1 at most; below floor a node is left out. The first mention gives name and type, evidence is the
    number of chunks, which stay rows (`node_evidence`) however many there are."""
    return nodes_of_chunks(names_in_chunks(mentions), floor)


def names_in_chunks(mentions: DataFrame) -> DataFrame:
    """(name, chunk_id, f, n): each name of a chunk once, with its first mention and their number; name and chunk_id are
    what `node_evidence` gives."""
    name = F.lower(F.trim("text"))
    first = F.min_by(F.struct("text", "type"), F.struct("chunk_id", "text", "type"))
    return mentions.where(name != "").groupBy(name.alias("name"), "chunk_id").agg(first.alias("f"), F.count("*").alias("n"))


def nodes_of_chunks(per_chunk: DataFrame, floor: float = 0.9) -> DataFrame:
    """`entity_nodes` from `names_in_chunks`."""
    nodes = per_chunk.groupBy("name").agg(F.min_by("f", "chunk_id").alias("f"), F.sum("n").alias("n"), F.count("*").alias("evidence"))
    score = F.round(F.least(F.lit(1.0), 0.8 + 0.1 * (F.col("n") - 1)), 6)
    return nodes.select("name", F.col("f.text").alias("canonical_name"), F.col("f.type").alias("entity_type"), score.alias("score"), "evidence").where(F.col("score") >= floor)


def node_evidence(mentions: DataFrame) -> DataFrame:
    """(name, chunk_id): the chunks of each node, once each."""
    return mentions.select(F.lower(F.trim("text")).alias("name"), "chunk_id").where("name <> ''").distinct()


def merge_evidence(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(node_id, document_id, chunk_id, score): the union of evidence; a score never goes down."""
    both = stored.unionByName(incoming)
    return both.groupBy("node_id", "document_id", "chunk_id").agg(F.max("score").alias("score"))


def node_view(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("node_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("chunk_id")).alias("chunks"))


def forget_document(evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Evidence without that of the given documents; nodes without evidence are gone with it."""
    return evidence.join(documents.select("document_id"), "document_id", "left_anti")


def illegal_moves(states: DataFrame, moves: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """Rows whose state does not follow from the one before by a legal move (staying is legal)."""
    before = F.lag(state).over(W.partitionBy(key).orderBy(order))
    steps = states.withColumn("_from", before).where(F.col("_from").isNotNull() & (F.col("_from") != F.col(state)))
    legal = moves.select(F.col("from_state").alias("_from"), F.col("to_state").alias(state))
    return steps.join(legal, ["_from", state], "left_anti")


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth) within depth steps of the seeds along edges (src, dst).

    Each step joins the frontier with the edges, takes the nodes that were not seen before and writes them: a step's plan
    is as long as the last one's, a lost executor costs that step's tasks, and the search ends with an empty frontier.
    """
    from tessera.sources.storage import stored

    frontier = seen = stored(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")
    for d in range(1, depth + 1):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = stored(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        if frontier.isEmpty():
            break
        seen = stored(seen.unionByName(frontier), "seen")
    return seen


def content_put(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(chunk_id, content) with the incoming rows in place of those of the same id."""
    return upsert(stored, incoming, "chunk_id")


def content_get(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk_id, content) of the wanted ids; content is null where there is none."""
    return wanted.select("chunk_id").distinct().join(stored, "chunk_id", "left")


def content_delete(stored: DataFrame, gone: DataFrame) -> DataFrame:
    return stored.join(gone.select("chunk_id"), "chunk_id", "left_anti")


POINTS = "document_id bigint, chunk_id string, point_id string, signature string, content string"
VECTORS = "document_id bigint, point_id string, vector array<float>"
EVIDENCE = "document_id bigint, node_id string, chunk_id string, score double"


class Index:
    """The tables of an index, by document: points with content, vectors, term statistics and entity evidence. An index
    that is in the folder is opened as it was left."""

    def __init__(self, spark, path: str, parts: int = 64):
        from tessera.operators.statistics import Statistics
        from tessera.sources.storage import Table

        keys = ("document_id", "point_id")
        self.points, self.vectors = Table(spark, f"{path}/points", POINTS, keys, parts), Table(spark, f"{path}/vectors", VECTORS, keys, parts)
        self.evidence = Table(spark, f"{path}/evidence", EVIDENCE, ("document_id", "node_id", "chunk_id"), parts)
        self.statistics = Statistics(spark, f"{path}/statistics", parts)

    def tables(self) -> dict:
        s = self.statistics
        return {"points": self.points, "vectors": self.vectors, "evidence": self.evidence, "texts": s.texts, "frequencies": s.frequencies, "totals": s.totals}

    def compact(self, folders: int = 4) -> dict[str, list[int]]:
        """Rewrite, of every table, the parts that so many commits have touched."""
        return {name: t.compact(folders) for name, t in self.tables().items()}


@dataclass(frozen=True)
class Encoder:
    """What turns contents into vectors, and the names that go into a point's signature: with another encoder or
    version of it all points count as changed."""

    vector: Callable[[Column], Column]
    provider: str
    model: str
    version: str = "1"


def mock_encoder(dims: int = 32) -> Encoder:
    from tessera.operators.models import mock_embedding

    return Encoder(lambda content: mock_embedding(content, dims), "mock", "mock-embed")


def index_documents(index: Index, incoming: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """Bring the index to the state of incoming (document_id, chunk_id, content) and return the diff plan.

    The plan is a full outer join by signature. What is new or changed is written, embedded, counted and read for
    entities, what is deleted is marked as gone, and unchanged points are not touched: each table gets one commit of the
    rows that differ. The points come last: should a run end before them, the next one finds its work still to do, and
    what the tables hold beyond the incoming rows goes. Chunk ids need be unique inside a document only; of rows with the
    same ids the last by content counts.
    """
    from tessera.functions import text as X
    from tessera.operators import enrichment as N
    from tessera.sources.storage import released, stored

    encoder, spark = encoder or mock_encoder(), incoming.sparkSession
    keys = ["document_id", "point_id"]
    point = X.point_id(F.col("document_id").cast("string"), F.col("chunk_id"), F.lit(0))
    new = incoming.groupBy("document_id", "chunk_id").agg(F.max("content").alias("content"))
    new = new.withColumns({"point_id": point, "signature": X.index_signature(X.content_hash(F.col("content")), encoder.provider, encoder.model, encoder.version, "1.0.0")})
    old = index.points.read()
    both = diff_plan(old.withColumn("_k", F.struct(*keys, "chunk_id")), new.withColumn("_k", F.struct(*keys, "chunk_id")), "_k")
    plan = stored(both.select("_k.*", "action"), "plan")
    work = plan.where("action IN ('new', 'modified')").select(*keys)
    there = plan.where("action = 'deleted'").select(*keys)
    for table in (index.vectors, index.statistics.texts):  # also what an unfinished run left
        there = there.unionByName(table.read().select(*keys))
    gone = stored(there.distinct().join(new.select(*keys), keys, "left_anti"), "gone")
    fresh = stored(new.join(work, keys, "left_semi").select("document_id", "chunk_id", "point_id", "signature", "content"), "fresh")
    index.vectors.commit(fresh.select(*keys, encoder.vector(F.col("content")).alias("vector")), gone)
    released(spark)
    index.statistics.update(fresh.select(*keys, F.col("content").alias("text")), gone)
    chunk = F.struct("document_id", "chunk_id").alias("chunk_key")
    found = N.mentions(fresh.select(chunk, "content"), "chunk_key", "content").select(F.col("chunk_id.document_id").alias("document_id"), F.lower("text").alias("node_id"), F.col("chunk_id.chunk_id").alias("chunk_id"), F.col("confidence").alias("score"))
    evidence = stored(found.groupBy("document_id", "node_id", "chunk_id").agg(F.max("score").alias("score")), "evidence")
    same = plan.where("action = 'unchanged'").select("document_id", "chunk_id")
    before = index.evidence.read().join(same, ["document_id", "chunk_id"], "left_anti")
    index.evidence.commit(evidence, before.join(evidence, ["document_id", "node_id", "chunk_id"], "left_anti").select("document_id", "node_id", "chunk_id"))
    index.points.commit(fresh, gone)
    released(spark, gone, fresh, evidence)
    return plan.select("point_id", "action")
