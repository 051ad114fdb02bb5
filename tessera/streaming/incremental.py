"""Incremental indexing with Structured Streaming: each micro-batch is one commit of what it changes, and a keyed state
machine with timers.

Tables are `tessera.sources.storage.Table`: a batch appends its rows and a manifest, so what it writes follows its size;
reads merge, and `compact` is a job of its own that may run beside. A batch that is replayed is known by its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.lexicon import JOB_MOVES
from tessera.operators.indexing import diff_plan
from tessera.operators.statistics import Statistics
from tessera.sources.storage import Table, stored


def signature_table(spark: SparkSession, path: str, parts: int = 64) -> Table:
    return Table(spark, path, "point_id bigint, signature string", ("point_id",), parts)


def evidence_table(spark: SparkSession, path: str, parts: int = 64) -> Table:
    """Evidence by node; a score never goes down."""
    return Table(spark, path, "node_id string, document_id bigint, chunk_id bigint, score double", ("node_id", "document_id", "chunk_id"), parts, merge="max")


def _started(rows: DataFrame, step, checkpoint: str):
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_stream(documents: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", parts: int = 64):
    """Keep an index of (point_id, signature) up to date with a stream of documents, and write each batch's diff plan.

    A batch reads the parts that its ids fall in and appends new and changed signatures.
    """

    def step(batch: DataFrame, number: int) -> None:
        table = signature_table(batch.sparkSession, f"{path}/index", parts)
        if table.committed(("documents", number)):
            return
        # of rows for one document the last by text stands; arrival order is not known inside a batch
        new = stored(batch.groupBy(F.col(id_col).alias("point_id")).agg(F.sha2(F.max(F.coalesce(text_col, F.lit(""))), 256).alias("signature")), "batch")
        old = table.read_for(new).join(new.select("point_id"), "point_id", "left_semi")
        plan = stored(diff_plan(old, new), "plan")  # a batch holds what changed, not all there is
        plan.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/plans/v{number}")
        table.commit(new.join(plan.where("action <> 'unchanged'").select("point_id"), "point_id", "left_semi"), None, ("documents", number))

    return _started(documents, step, checkpoint)


def evidence_stream(evidence: DataFrame, path: str, checkpoint: str, parts: int = 64):
    """Merge a stream of (node_id, document_id, chunk_id, score) into a table; order and replays don't matter, since the
    union is distinct and a score is a maximum."""

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy("node_id", "document_id", "chunk_id").agg(F.max("score").alias("score"))
        evidence_table(batch.sparkSession, path, parts).commit(rows, None, ("evidence", number))

    return _started(evidence, step, checkpoint)


def statistics_stream(texts: DataFrame, path: str, checkpoint: str, order: str = "seq", parts: int = 64):
    """Keep BM25's statistics up to date with a stream of (document_id, point_id, text, gone, order): of a batch's rows for
    a text the last by order stands, and gone takes it away."""

    def step(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("document_id", "point_id").agg(F.max_by(F.struct("text", "gone"), F.struct(order, "text", "gone")).alias("r"))
        last = stored(last.select("document_id", "point_id", "r.text", F.coalesce("r.gone", F.lit(False)).alias("gone")), "batch")
        Statistics(batch.sparkSession, path, parts).update(last.where("NOT gone"), last.where("gone"), ("texts", number))

    return _started(texts, step, checkpoint)


MOVES = "job_id bigint, seq bigint, from_state string, to_state string, legal boolean"
#: States after which a job's own state is dropped, and milliseconds that events wait for one that is missing before them.
TERMINAL = frozenset(b for _, b in JOB_MOVES) - frozenset(a for a, _ in JOB_MOVES)
PATIENCE = 600_000


class JobMachine(StatefulProcessor):
    """Moves of one job, in the order of seq (from 1 on, without gaps) whatever the order of arrival.

    Events that come early wait in the state for those before them. Where one stays away, a timer ends the wait and the
    next one there is taken. An event that was taken before, or whose turn is over, is left out. What waits goes when the
    job is over, and the number of the last event stays until the timer runs out, so that stragglers are still known.
    """

    def __init__(self, patience: int = PATIENCE):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state string, next bigint")
        self.waiting = handle.getMapState("waiting", "seq bigint", "state string")

    def _held(self) -> tuple[str, int]:
        return tuple(self.now.get()) if self.now.exists() else ("pending", 1)

    def _advance(self, job: int, skip: bool) -> list[tuple]:
        """Take what follows without a gap; with skip, the first gap is passed over."""
        state, following = self._held()
        held = sorted((k[0], v[0]) for k, v in list(self.waiting.iterator()))
        if skip and held:
            following = max(following, held[0][0])
        moves = []
        for seq, new in held:
            if seq > following:
                break
            self.waiting.removeKey((seq,))
            if seq == following:
                legal = new == state or (state, new) in JOB_MOVES
                moves.append((job, seq, state, new, legal))
                state, following = new if legal else state, seq + 1
        self.now.update((state, following))
        return moves

    def _wait(self, milliseconds: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if list(self.waiting.keys()) or self._held()[0] in TERMINAL:
            self.handle.registerTimer(milliseconds + self.patience)

    def _frame(self, moves: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(moves, columns=["job_id", "seq", "from_state", "to_state", "legal"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for seq, new in zip(part["seq"].tolist(), part["state"].tolist(), strict=True):
                if seq >= self._held()[1]:
                    self.waiting.updateValue((seq,), (new,))
        moves = self._advance(key[0], False)
        self._wait(timerValues.getCurrentProcessingTimeInMs())
        yield self._frame(moves)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        moves = self._advance(key[0], True)
        more = list(self.waiting.keys())
        if self._held()[0] in TERMINAL and not more:
            self.now.clear()
        elif more:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
        yield self._frame(moves)

    def close(self) -> None:
        pass


def job_states(events: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Each event (job_id, seq, state) as a move from the state before it in its job, and whether the move is legal; an
    illegal move leaves the state as it was. Needs the RocksDB state store. Timers keep a query that takes what is there now
    from ending, unless spark.sql.streaming.noDataMicroBatches.enabled is off."""
    return events.groupBy("job_id").transformWithStateInPandas(statefulProcessor=JobMachine(patience), outputStructType=MOVES, outputMode="append", timeMode="processingTime")


def entity_rates(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events (ts, kind) counted by window and kind, with a watermark; an extra beside the reference's own streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("n")).select("window.start", "kind", "n")
