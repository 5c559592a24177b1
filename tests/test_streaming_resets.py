"""State with resets over several batches, delivery, and a failed receiver."""

from datetime import datetime, timedelta

from plenum.streaming import conversations

START = datetime(2025, 1, 1)
SCHEMA = "type string, partner_id string, text string, created_at timestamp"


def test_batches_in_any_order(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    batches = [
        [("message", "a", "one", at(1)), ("message", "a", "two", at(3)), ("read", "a", None, at(2)), ("open", "b", None, at(9))],
        [("message", "a", "late", at(1)), ("message", "b", "old", at(8)), ("message", "c", "x", at(1)), ("message", "c", "x", at(1))],
        [("read", "c", None, at(1)), ("message", "b", "new", at(10))],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    seen = []
    conversations.run_to_end(conversations.state_with_resets(stream), f"{tmp_path}/out", "update", lambda rows, n: rows.selectExpr("*", f"{n} AS batch").write.mode("append").parquet(f"{tmp_path}/rows") or seen.append(n))
    found = {r.partner_id: (r.last_message, r.unread) for r in conversations.latest_of_updates(spark.read.parquet(f"{tmp_path}/rows")).collect()}
    assert found == {"a": ("two", 1), "b": ("new", 1), "c": ("x", 0)} and len(seen) == 3


def test_delivery_is_in_order_and_survives_a_failure(spark, tmp_path):
    rows = spark.createDataFrame([("u", "2", START + timedelta(1)), ("u", "1", START), ("gone", "3", START), ("v", "4", START)], "to string, text string, created_at timestamp")
    folder = str(tmp_path)

    def send(user, event):
        if user == "gone":
            raise OSError("no socket")
        with open(f"{folder}/{user}", "a") as f:
            f.write(event["text"])

    conversations.deliver(rows, send)
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"u": "12", "v": "4"}


def test_malformed_frames(spark):
    raw = spark.createDataFrame([('{"type":"message","partner_id":"a","text":"t"}',), ("{",), ('{"type":"ping","partner_id":"a"}',), ('{"type":"read","partner_id":"a"}',), ('{"type":"message"}',), (None,)], "value string")
    assert conversations.messages(raw).count() == 1 and conversations.frames(raw, "message", *conversations.RESETS).count() == 2
