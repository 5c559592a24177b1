"""What a stream costs as its tables grow: passes over the input, Python calls, joins."""

import datetime
import os

import duckdb
import pytest

import plenum.plans.streams as streams
from plenum.plans import documents
from plenum.streaming import conversations, delivery, recovery
from tests.test_catalog import rows as same

START = datetime.datetime(2026, 1, 1)


def jobs(spark, name, act):
    """How many Spark jobs act starts from this thread."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        act()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_slices_are_written_in_one_pass(spark, tmp_path):
    """Forty slices, one of them empty: few jobs, and one batch per slice in the order of time."""
    data = [(i, START + datetime.timedelta(hours=i % 40, minutes=i % 7)) for i in range(400) if i % 40 != 5] + [(-1, None)]
    rows = spark.createDataFrame(data, "id long, at timestamp")
    made, seen = [], []
    assert jobs(spark, "slices", lambda: made.append(streams.by_slices(rows, "at", 40))) < 15
    conversations.run_to_end(made[0], str(tmp_path), "append", lambda batch, n: seen.append(sorted(r.id for r in batch.collect())))
    assert len(seen) == 40 and seen[5] == [] and sorted(i for ids in seen for i in ids) == sorted(i for i, at in data if at)
    hours = [{i % 40 for i in ids} for ids in seen]
    assert all(max(a) < min(b) for a, b in zip([h for h in hours if h], [h for h in hours if h][1:]))


def test_resets_of_many_partners(spark, tmp_path):
    """The state has a row per part, not per partner; counts and last messages are those of one event after the other."""
    kinds = ("message", "message", "read", "message", "open", "message")
    batches = [[(kinds[(i * i + b + i // 900) % 6], f"u{i % 900}", f"m{b}-{i}", START + datetime.timedelta(hours=b, seconds=i)) for i in range(2700)] for b in range(3)]
    schema = "type string, partner_id string, text string, created_at timestamp"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keep = lambda rows, n: rows.write.parquet(f"{tmp_path}/rows/batch={n}")
    run = conversations.state_with_resets(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).foreachBatch(keep).start()
    run.awaitTermination()
    assert max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"]) <= conversations.PARTS
    unread, last = dict.fromkeys((f"u{i}" for i in range(900)), 0), {}
    for kind, partner, text, _ in (e for batch in batches for e in batch):
        unread[partner] = unread[partner] + 1 if kind == "message" else 0
        if kind == "message":
            last[partner] = text
    found = {r.partner_id: (r.last_message, r.unread) for r in conversations.latest_of_updates(spark.read.parquet(f"{tmp_path}/rows")).collect()}
    assert found == {p: (last.get(p), n) for p, n in unread.items()}


def test_a_batch_is_worked_off_once(spark, tmp_path):
    """A batch's rows, and so the stream's state, are read once though the merge reads its changes twice; each bucket is written by one task."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            read.add(len(rows))
            yield rows

    schema = "id string, partner_id string, text string, created_at timestamp, thread_open boolean"
    sent = spark.createDataFrame([(str(i), f"u{i % 50}", "x", START + datetime.timedelta(seconds=i), i % 2 == 0) for i in range(1000)], schema)
    table = recovery.state_table(spark, f"{tmp_path}/t", 4)
    take = recovery.take_up(table)
    take(sent.mapInPandas(counted, schema), 0)
    assert read.value == 1000
    take(sent.mapInPandas(counted, schema), 0)  # again: counts nothing
    found = {r.partner_id: r.unread for r in table.rows().collect()}
    assert found == {f"u{i}": 0 if i % 2 == 0 else 20 for i in range(50)}
    assert all(len([f for f in os.listdir(f"{tmp_path}/t/{d}") if f.endswith(".parquet")]) == 1 for d in os.listdir(f"{tmp_path}/t") if "=" in d)


def _sends(connection, payload):
    pass


def test_connections_are_reduced_once_and_finished_batches_need_no_join(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            read.add(len(rows))
            yield rows

    schema = "user string, connection string, open boolean"
    connections = spark.createDataFrame([(f"u{i % 20}", f"c{i}", i % 3 > 0) for i in range(120)], schema)
    event = lambda b: spark.createDataFrame([(f"u{i}", f"{b}-{i}", START) for i in range(25)], "to string, id string, created_at timestamp")
    live = delivery.kept(connections.mapInPandas(counted, schema))
    for n in range(3):
        delivery.deliver(event(n), n, live, _sends, f"{tmp_path}/log")
    live.unpersist()
    assert read.value == 120
    found = delivery.outcomes(spark, f"{tmp_path}/log")
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.batch, r.id, r.connection, r.sent) for r in found.collect()) == sorted((n, f"{n}-{i % 20}", f"c{i}", True) for n in range(3) for i in range(120) if i % 3)


def test_outcomes_of_unfinished_batches(spark, tmp_path):
    """One batch finished, one with claims only, one whose outcomes are there in part without being finished."""
    claim = lambda n: spark.createDataFrame([("u", str(i), START, "{}", "c") for i in range(3)], "to string, id string, created_at timestamp, payload string, connection string").write.parquet(f"{tmp_path}/claims/batch={n}")
    for n in range(3):
        claim(n)
    assert sorted({r.sent for r in delivery.outcomes(spark, str(tmp_path)).collect()}, key=str) == [None]
    for n, ids in ((0, range(3)), (2, range(1))):
        spark.createDataFrame([(str(i), "c", True) for i in ids], "id string, connection string, sent boolean").write.parquet(f"{tmp_path}/outcomes/batch={n}")
    os.remove(f"{tmp_path}/outcomes/batch=2/_SUCCESS")
    found = sorted((r.batch, r.id, r.sent) for r in delivery.outcomes(spark, str(tmp_path)).collect())
    assert found == [(0, "0", True), (0, "1", True), (0, "2", True), (1, "0", None), (1, "1", None), (1, "2", None), (2, "0", True), (2, "1", None), (2, "2", None)]


@pytest.mark.parametrize("name", ["cached_answers", "message_stream_state"])
def test_many_slices(spark, monkeypatch, name):
    """Twenty slices: few jobs besides those of the batches, and the rows of the SQL."""
    monkeypatch.setattr(streams, "SLICE_ROWS", 50)
    data, found = "/root/testdata/sf0.001", []
    query, sql = (streams.QUERIES | documents.QUERIES)[name]
    assert jobs(spark, name, lambda: found.append(query(spark, data))) < 15
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{data}/events.parquet'")
    theirs = con.sql(f"SELECT {', '.join(found[0].columns)} FROM ({sql})")
    assert same([tuple(r) for r in found[0].collect()], found[0].columns) == same(theirs.fetchall(), theirs.columns)
