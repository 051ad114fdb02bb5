"""Tables of commits, the index on top of them, statistics that follow a corpus, and the streams that feed both."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import indexing as I
from tessera.operators import retrieval as R
from tessera.operators.statistics import Statistics
from tessera.sources.storage import Table
from tessera.streaming import incremental


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_table_by_document_reads_one_part(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t", "document_id bigint, x string", parts=5)
    assert t.read().count() == 0
    t.put(spark.createDataFrame([(k, str(k)) for k in range(40)], t.schema))
    assert t.read(7).collect() == [(7, "7")] and t.read().count() == 40
    assert "PartitionFilters: [isnotnull(_part" in t.read(7)._jdf.queryExecution().toString()
    t.put(t.read().where("document_id > 3"))
    assert t.version == 2 and t.read().count() == 36


@pytest.mark.parametrize("merge", ["last", "sum", "max"])
def test_a_log_of_commits_equals_a_plain_table(spark, tmp_path, merge):
    rng, plain = random.Random(merge), {}
    t = Table(spark, f"{tmp_path}/t", "k bigint, v bigint", ("k",), 4, merge=merge)
    for number in range(6):
        rows = {rng.randrange(40): rng.randrange(-3, 9) for _ in range(rng.choice((0, 3, 12)))}
        gone = {k for k in range(40) if k % 7 == number and k not in rows} if merge == "last" else set()
        assert t.commit(spark.createDataFrame(list(rows.items()), t.schema), spark.createDataFrame([(k,) for k in gone], "k bigint") if gone else None, ("s", number))
        assert not t.commit(spark.createDataFrame([(1, 100)], t.schema), None, ("s", number))  # a replay
        for k, v in rows.items():
            plain[k] = v if merge == "last" or k not in plain else plain[k] + v if merge == "sum" else max(plain[k], v)
        plain = {k: v for k, v in plain.items() if k not in gone and (merge != "sum" or v)}
        if number == 3:
            before = sorted(map(tuple, t.read().collect()))
            old = t.read()
            assert t.compact(2) and all(len(v) <= 2 for v in t.folders.values())
            assert sorted(map(tuple, t.read().collect())) == before == sorted(map(tuple, old.collect()))
        again = Table(spark, f"{tmp_path}/t", t.schema, ("k",), 4, merge=merge)  # as another session finds it
        assert again.version == t.version and dict(map(tuple, again.read().collect())) == plain
    t.compact(2)
    t.vacuum()
    assert dict(map(tuple, Table(spark, f"{tmp_path}/t", t.schema, ("k",), 4, merge=merge).read().collect())) == plain
    assert len(os.listdir(f"{tmp_path}/t/data")) <= len({f for v in t.folders.values() for f in v})


def test_a_commit_leaves_other_parts_alone_and_two_writers_do_not_lose_rows(spark, tmp_path):
    t = Table(spark, f"{tmp_path}/t", "document_id bigint, x string", parts=8)
    t.put(spark.createDataFrame([(k, "a") for k in range(100)], t.schema))
    other, had = Table(spark, f"{tmp_path}/t", t.schema, parts=8), files(f"{tmp_path}/t/data")
    t.commit(spark.createDataFrame([(3, "b")], t.schema))
    now = files(f"{tmp_path}/t/data")
    assert had.items() <= now.items() and len(now) == len(had) + 1
    with pytest.raises(RuntimeError, match="someone else"):
        other.commit(spark.createDataFrame([(4, "c")], t.schema))
    other.refresh()
    other.commit(spark.createDataFrame([(4, "c")], t.schema))
    t.refresh()
    assert t.read(3).collect() == [(3, "b")] and t.read(4).collect() == [(4, "c")] and t.read().count() == 100
    untouched = files(f"{tmp_path}/t/data")
    t.compact(2)
    assert untouched.items() <= files(f"{tmp_path}/t/data").items()


def snapshot(spark, *rows):
    return spark.createDataFrame(list(rows), "document_id long, chunk_id string, content string")


def test_an_index_follows_its_documents_and_is_found_again(spark, tmp_path):
    index = I.Index(spark, f"{tmp_path}/index", 4)
    I.index_documents(index, snapshot(spark, (1, "1/a", "Acme Corp grew"), (2, "2/a", "old words"), (3, "3/a", "gone")), I.mock_encoder(8))
    index = I.Index(spark, f"{tmp_path}/index", 4)
    assert index.points.read().count() == 3
    had = files(f"{tmp_path}/index")
    plan = I.index_documents(index, snapshot(spark, (1, "1/a", "Acme Corp grew"), (2, "2/a", "new words"), (4, "4/a", "Beta Holding")), I.mock_encoder(8))
    assert sorted(r.action for r in plan.collect()) == ["deleted", "modified", "new", "unchanged"]
    assert had.items() <= files(f"{tmp_path}/index").items()  # nothing is written over
    index = I.Index(spark, f"{tmp_path}/index", 4)
    assert {r.chunk_id: r.content for r in index.points.read().collect()} == {"1/a": "Acme Corp grew", "2/a": "new words", "4/a": "Beta Holding"}
    assert {r.node_id for r in index.evidence.read().collect()} == {"acme corp", "beta holding"}
    assert index.vectors.read().count() == 3 and index.statistics.postings().select("stats_version").distinct().count() == 1
    index.compact(2)
    assert I.Index(spark, f"{tmp_path}/index", 4).points.read().count() == 3


def test_chunk_ids_are_a_documents_own(spark, tmp_path):
    index = I.Index(spark, f"{tmp_path}/index", 4)
    I.index_documents(index, snapshot(spark, (1, "c1", "Rick Rubin made Acme Corp"), (2, "c1", "nobody")))
    assert {(r.document_id, r.chunk_id) for r in index.evidence.read().collect()} == {(1, "c1")}
    I.index_documents(index, snapshot(spark, (1, "c1", "nobody"), (2, "c1", "Rick Rubin made Acme Corp")))
    assert {r.document_id for r in index.evidence.read().collect()} == {2} and index.evidence.read().count() > 0


def test_another_encoder_changes_every_point(spark, tmp_path):
    index = I.Index(spark, f"{tmp_path}/index", 4)
    rows = snapshot(spark, (1, "a", "x y"), (2, "b", None))
    I.index_documents(index, rows)
    length = I.Encoder(lambda c: F.array(F.length(c).cast("float")), "own", "length")
    assert {r.action for r in I.index_documents(index, rows, length).collect()} == {"modified"}
    assert {r.document_id: r.vector for r in index.vectors.read().collect()} == {1: [3.0], 2: [None]}
    assert {r.action for r in I.index_documents(index, rows, length).collect()} == {"unchanged"}


def test_a_run_that_ended_early_is_made_up_for(spark, tmp_path, monkeypatch):
    index = I.Index(spark, f"{tmp_path}/index", 4)
    I.index_documents(index, snapshot(spark, (1, "a", "one two"), (2, "b", "two three")))
    lost = snapshot(spark, (1, "a", "one two"), (2, "b", "Acme Corp four"), (9, "z", "Beta Holding five"))
    monkeypatch.setattr(Table, "commit", lambda self, *a, _f=Table.commit, **b: (_ for _ in ()).throw(OSError("lost")) if self.path.endswith(("/frequencies", "/points")) else _f(self, *a, **b))
    with pytest.raises(OSError, match="lost"):
        I.index_documents(index, lost)
    monkeypatch.undo()
    index = I.Index(spark, f"{tmp_path}/index", 4)
    rows = [(1, "a", "one two"), (2, "b", "two six")]
    I.index_documents(index, snapshot(spark, *rows))
    assert {r.document_id for r in index.vectors.read().collect()} == {1, 2} and index.evidence.read().count() == 0
    check_statistics(spark, index.statistics, {(i, None): t for i, _, t in rows}, by_document=True)


def check_statistics(spark, stats, texts, by_document=False):
    words = {k: R_tokens(t) for k, t in texts.items()}
    df = Counter(w for ws in words.values() for w in set(ws))
    assert dict(map(tuple, stats.frequencies.read().collect())) == dict(df)
    full = [len(ws) for ws in words.values() if ws]
    s = stats.summary().first()
    assert (s.total_docs, s.avg_length) == (len(full), pytest.approx(sum(full) / len(full) if full else 0.0))
    docs = spark.createDataFrame([(f"{a}" if by_document else f"{a}/{b}", t) for (a, b), t in texts.items()], "id string, text string")
    terms = R.term_counts(docs, "id", F.col("text"))
    want = {(r.id, r.term): r.weight for r in R.postings(terms, R.document_frequencies(terms), R.corpus_stats(docs, F.col("text"))).collect()}
    got = stats.postings().collect()
    assert {(f"{r.document_id}" if by_document else f"{r.document_id}/{r.point_id}", r.term): r.weight for r in got} == pytest.approx(want)
    assert len({r.stats_version for r in got}) <= 1


def R_tokens(text):
    import re

    return re.findall("[a-z0-9]+", (text or "").lower())


def test_statistics_follow_updates_deletes_and_compaction(spark, tmp_path):
    rng, held = random.Random(2), {}
    stats = Statistics(spark, f"{tmp_path}/s", 3)
    for number in range(4):
        new = {(rng.randrange(9), f"p{rng.randrange(2)}"): rng.choice([None, "", "a b", "b c d", "e a a", "c"]) for _ in range(5)}
        gone = [k for k in held if k not in new and rng.random() < 0.3]
        up = spark.createDataFrame([(*k, t) for k, t in new.items()], "document_id long, point_id string, text string")
        down = spark.createDataFrame(gone, "document_id long, point_id string")
        assert stats.update(up, down, ("b", number)) and not stats.update(up, down, ("b", number))
        held = {k: t for k, t in {**held, **new}.items() if k not in gone}
        if number == 2:
            stats.frequencies.compact(2)
            stats.texts.compact(2)
        check_statistics(spark, Statistics(spark, f"{tmp_path}/s", 3), held)
    stats.reweigh()
    now = stats.summary().first().stats_version
    assert {r.stats_version for r in stats.texts.read().collect()} == {now}
    check_statistics(spark, stats, held)


def feed(spark, path, batches, schema, start):
    """Run a stream once for each batch of rows, each a file of its own."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in/{n}")
        start(spark.readStream.schema(schema).parquet(f"{path}/in/*")).awaitTermination()


def test_index_stream(spark, tmp_path):
    start = lambda rows: incremental.index_stream(rows, f"{tmp_path}/out", f"{tmp_path}/ck", parts=4)
    feed(spark, tmp_path, [[(1, "a"), (2, "b")], [(2, "c"), (3, None)], [(1, "a")]], "doc_id long, text string", start)
    assert {r.point_id for r in incremental.signature_table(spark, f"{tmp_path}/out/index", 4).read().collect()} == {1, 2, 3}
    plans = spark.read.parquet(f"{tmp_path}/out/plans/*")
    assert {(r.batch, r.point_id): r.action for r in plans.collect()} == {(0, 1): "new", (0, 2): "new", (1, 2): "modified", (1, 3): "new", (2, 1): "unchanged"}


def test_evidence_stream_appends_what_a_batch_has(spark, tmp_path):
    rng = random.Random(4)
    batches = [[(f"n{rng.randrange(9)}", rng.randrange(3), rng.randrange(4), float(rng.randrange(10))) for _ in range(n)] for n in (200, 1, 5)]
    sizes = []

    def start(rows):
        sizes.append(sum(map(os.path.getsize, files(f"{tmp_path}/out"))))
        return incremental.evidence_stream(rows, f"{tmp_path}/out", f"{tmp_path}/ck", 4)

    schema = "node_id string, document_id long, chunk_id long, score double"
    feed(spark, tmp_path, batches, schema, start)
    want: dict = {}
    for n, d, c, s in (r for b in batches for r in b):
        want[n, d, c] = max(s, want.get((n, d, c), s))
    table = incremental.evidence_table(spark, f"{tmp_path}/out", 4)
    assert {tuple(r)[:3]: r.score for r in table.read().collect()} == want and table.done == {"evidence": 2}
    assert sizes[2] - sizes[1] < sum(map(os.path.getsize, files(f"{tmp_path}/out"))) / 3
    # the same again from the first batch on: a lost checkpoint of the stream
    incremental.evidence_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), f"{tmp_path}/out", f"{tmp_path}/ck2", 4).awaitTermination()
    again = incremental.evidence_table(spark, f"{tmp_path}/out", 4)
    assert again.version == table.version and again.compact(1)
    assert {tuple(r)[:3]: r.score for r in again.read().collect()} == want


def test_statistics_stream(spark, tmp_path):
    schema = "seq long, document_id long, point_id string, text string, gone boolean"
    batches = [[(1, 1, "p", "a b", None), (2, 2, "p", "b", False)], [(4, 1, "p", "c c", None), (3, 1, "p", "x", None)], [(5, 2, "p", None, True), (6, 3, "q", "a", None)], [(7, 3, "q", None, True), (8, 3, "q", "d e", None)]]
    feed(spark, tmp_path, batches, schema, lambda rows: incremental.statistics_stream(rows, f"{tmp_path}/s", f"{tmp_path}/ck", parts=2))
    check_statistics(spark, Statistics(spark, f"{tmp_path}/s", 2), {(1, "p"): "c c", (3, "q"): "d e"})


@pytest.fixture
def rocks(spark):
    held = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k in held:
        spark.conf.unset(k)


def moves_of(spark, tmp_path, batches, patience=600_000):
    schema = "job_id long, seq long, state string"
    out = f"{tmp_path}/moves"
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/{n}")
    start = lambda rows: incremental.job_states(rows, patience).writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    feed(spark, tmp_path, batches, schema, start)
    return sorted(map(tuple, spark.read.parquet(f"{out}/*").collect()))


def test_job_events_in_any_order_over_batches(spark, tmp_path, rocks):
    events = [(1, 1, "running"), (1, 2, "completed"), (1, 3, "running"), (2, 1, "completed"), (2, 2, "running"), (2, 3, "retrying"), (3, 1, "running"), (3, 2, "failed")]
    once = moves_of(spark, tmp_path / "a", [events])
    assert {(j, s): ok for j, s, _, _, ok in once} == {(1, 1): True, (1, 2): True, (1, 3): False, (2, 1): False, (2, 2): True, (2, 3): True, (3, 1): True, (3, 2): True}
    random.Random(5).shuffle(events)
    assert moves_of(spark, tmp_path / "b", [events[:2], events[2:5], events[5:], events[:1]]) == once  # and one of them twice


def test_a_missing_event_is_waited_for_no_longer_than_patience(spark, tmp_path, rocks):
    got = moves_of(spark, tmp_path, [[(1, 1, "running"), (1, 3, "completed")], [(2, 1, "running")], [(2, 2, "completed")]], 1)
    assert [(j, s, a, b) for j, s, a, b, _ in got] == [(1, 1, "pending", "running"), (1, 3, "running", "completed"), (2, 1, "pending", "running"), (2, 2, "running", "completed")]
