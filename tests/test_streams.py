"""Streams with state, deliveries, stored tables and writes with constraints, beyond what the registered queries show."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import plenum.plans.streams as streams
from plenum.sources import guarded
from plenum.sources.stored import StoredTable
from plenum.streaming import cache, delivery, frames, recovery
from tests.test_catalog import rows

DATA = "/root/testdata/sf0.001"
START = datetime.datetime(2026, 1, 1)


@pytest.mark.parametrize("name", streams.QUERIES)
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    query, sql = streams.QUERIES[name]
    ours, theirs = query(spark, DATA), con.sql(sql)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows([tuple(r) for r in ours.collect()], ours.columns) == rows(theirs.fetchall(), theirs.columns)


def feed(spark, folder, schema, batches):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_cache_drops_entries_by_timer(spark, tmp_path):
    """Ten queries a batch that never come back: the state holds those of the last hour and of the lateness only."""
    at = lambda minutes: START + datetime.timedelta(minutes=minutes)
    batches = [[(f" Q{k}-{i} ", 10 * k + i, at(30 * k + i), f"answer {k}") for i in range(10)] for k in range(12)]
    stream = feed(spark, f"{tmp_path}/in", "query string, id long, asked_at timestamp, found string", batches)
    run = cache.answered(stream).writeStream.format("memory").queryName("cached").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert max(held) <= 50 and held[-1] <= 50 and spark.table("cached").filter("hit").isEmpty() and spark.table("cached").count() == 120


def test_cache_edges(spark, tmp_path):
    """Exactly one hour later is a new fetch; case and white space don't tell queries apart; null is a query of its own; a fetch may bring nothing."""
    at = lambda s: START + datetime.timedelta(seconds=s)
    batches = [[("a", 1, at(0), "x"), (" A\t", 2, at(3599), "y")], [("a", 3, at(3600), "z"), (None, 4, at(3601), None)], [("A", 5, at(7199), "w"), (None, 6, at(3602), "late but in time")]]
    stream = feed(spark, f"{tmp_path}/in", "query string, id long, asked_at timestamp, found string", batches)
    cache.answered(stream).writeStream.format("memory").queryName("edges").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.id, r.answer, r.hit) for r in spark.table("edges").collect()) == [(1, "x", False), (2, "x", True), (3, "z", False), (4, None, False), (5, "z", True), (6, None, True)]


def _fails_on_b(connection, payload):
    if connection == "b":
        raise ConnectionError


def test_deliveries(spark, tmp_path):
    events = spark.createDataFrame([("u", "1", START, "hi"), ("v", "2", START, "ho"), ("w", "3", START, "hu"), (None, "4", START, "he")], "to string, id string, created_at timestamp, text string")
    connections = spark.createDataFrame([("u", "a", True), ("u", "b", True), ("u", "c", False), ("v", "d", True), ("u", "a", True)], "user string, connection string, open boolean")
    for _ in range(2):  # the same batch again sends nothing
        delivery.deliver(events, 0, connections, _fails_on_b, f"{tmp_path}/log")
    found = sorted((r.batch, r.id, r.connection, r.sent) for r in delivery.outcomes(spark, f"{tmp_path}/log").collect())
    assert found == [(0, "1", "a", True), (0, "1", "b", False), (0, "2", "d", True)]
    assert '"text":"hi"' in delivery.fan_out(events, connections).filter("connection = 'a'").head().payload


def _dies(connection, payload):
    raise SystemExit


def test_claims_without_an_outcome_are_not_sent_again(spark, tmp_path):
    events = spark.createDataFrame([("u", "1", START)], "to string, id string, created_at timestamp")
    connections = spark.createDataFrame([("u", "a", True)], "user string, connection string, open boolean")
    with pytest.raises(Exception):  # noqa: B017 whatever Spark makes of a worker that dies
        delivery.deliver(events, 0, connections, _dies, f"{tmp_path}/log")
    delivery.deliver(events, 0, connections, _fails_on_b, f"{tmp_path}/log")
    delivery.deliver(events.withColumn("id", F.lit("2")), 1, connections, _fails_on_b, f"{tmp_path}/log")
    assert sorted((r.id, r.sent) for r in delivery.outcomes(spark, f"{tmp_path}/log").collect()) == [("1", None), ("2", True)]


def test_frames(spark, tmp_path):
    values = ['{"type":"message","partner_id":"u","text":"x","created_at":"2026-01-01T00:00:00Z"}', '{"type":"message"}', '{"type":"typing","partner_id":"u"}', "{", "[1]", "7", "", None, '{"type":"message","partner_id":"u","created_at":"never"}', '{"type":"message","partner_id":"v","more":1}']
    raw = spark.createDataFrame([(v,) for v in values], "value string")
    kinds = {r.value: r.kind for r in frames.sorted_frames(raw).collect()}
    assert [kinds[v] for v in values] == ["good", "foreign", "foreign", "malformed", "malformed", "malformed", "malformed", "malformed", "malformed", "good"]
    for _ in range(2):  # a repeated batch replaces itself
        frames.into_two(raw, 0, f"{tmp_path}/e", f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/e").count() == 2 and spark.read.parquet(f"{tmp_path}/r").count() == 8


def test_a_repeated_batch_counts_once(spark, tmp_path):
    table = recovery.state_table(spark, f"{tmp_path}/t", 4)
    sent = lambda *r: spark.createDataFrame(list(r), "id string, partner_id string, text string, created_at timestamp, thread_open boolean")
    at = lambda m: START + datetime.timedelta(minutes=m)
    take = recovery.take_up(table)
    for n, batch in ((0, sent(("1", "u", "a", at(0), False), ("2", "v", "b", at(1), True))), (0, sent(("1", "u", "a", at(0), False), ("2", "v", "b", at(1), True))), (1, sent(("3", "u", "c", at(-5), None)))):
        take(batch, n)
    state = lambda: sorted((r.partner_id, r.last_message, r.unread) for r in table.rows().collect())
    assert state() == [("u", "a", 2), ("v", "b", 0)]
    recovery.refresh(table, sent(("1", "u", "a", at(0), False), ("3", "u", "c", at(-5), None), ("4", "w", "lost", at(3), False)), at(3), 1)
    recovery.take_up(table, at(3))(sent(("4", "w", "lost", at(3), False), ("5", "w", "new", at(4), False)), 2)
    assert state() == [("u", "a", 2), ("v", "b", 0), ("w", "new", 2)]


def files(path):
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if "=" in d}


def test_changes_write_touched_partitions_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = StoredTable(spark, path, ["id"], 8).create(spark.createDataFrame([(i, f"n{i}", i) for i in range(200)], "id long, name string, n long"))
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "id long")
    change = lambda: {r.id: (r.name, r.n) for r in table.rows().collect()}
    for act in (lambda: table.upsert(spark.createDataFrame([(3, "three", 0), (900, "new", 1)], "id long, name string, n long")), lambda: table.update(keys(5, 77, 4000), n=F.col("n") * 2), lambda: table.delete(keys(6, 5000)), lambda: table.upsert(keys().selectExpr("id", "'x' AS name", "id AS n"))):
        before = files(path)
        touched = act()
        after = files(path)
        assert {d for d in before.keys() | after.keys() if before.get(d) != after.get(d)} <= {f"_bucket={b}" for b in touched} and len(touched) <= 3
    found = change()
    assert len(found) == 200 and found[3] == ("three", 0) and found[900] == ("new", 1) and found[5] == ("n5", 10) and found[77] == ("n77", 154) and 6 not in found
    table.delete(table.rows().select("id"))
    assert files(path) == {} or table.rows().isEmpty()


def test_constraints_at_write_time(spark, tmp_path):
    data = [("1", "u1", "c", "saved", START), ("2", "u1", "c", "saved", START), ("3", "u9", "c", "liked", START), (None, None, "c", None, None), ("1", "u1", "d", "saved", START)]
    new = spark.createDataFrame(data, "id string, user_id string, conference_id string, type string, created_at timestamp")
    users = spark.createDataFrame([("u1",), ("u1",)], "id string")
    counts = guarded.write(new, "conference_interactions", f"{tmp_path}/w", {"users": users}, F.col("created_at"), F.col("id"), F.col("conference_id"))
    assert {k: n for k, n in counts.items() if n} == {"rows": 5, "accepted": 1, "id is null": 1, "user_id is null": 1, "type is null": 1, "created_at is null": 1, "type is not allowed": 1, "id is taken": 1, "user_id conference_id type is taken": 1, "user_id is not in users": 1}
    assert counts.keys() - {"rows", "accepted"} == set(guarded.rules_of(new.columns, "conference_interactions", {"users": users}))
    assert [r.id for r in guarded.accepted(spark, f"{tmp_path}/w").collect()] == ["1"]
    reasons = {(r.id, r.conference_id): r["_reasons"] for r in guarded.quarantined(spark, f"{tmp_path}/w").collect()}
    assert reasons == {("2", "c"): ["user_id conference_id type is taken"], ("3", "c"): ["type is not allowed", "user_id is not in users"], (None, "c"): ["id is null", "user_id is null", "type is null", "created_at is null"], ("1", "d"): ["id is taken"]}
    plan = guarded.judged(spark.read.parquet(f"{DATA}/events.parquet").selectExpr("CAST(event_id AS STRING) AS id", "CAST(user_id AS STRING) AS user_id", "'c' AS conference_id", "event_type AS type", "CAST(ts AS timestamp) AS created_at"), "conference_interactions")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
