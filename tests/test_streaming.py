import json

from plenum.streaming import conversations


def test_the_stream_agrees_with_the_batch(spark, tmp_path):
    frames = [json.dumps({"type": t, "partner_id": f"u{i % 3}", "text": f"m{i}", "created_at": f"2024-01-01 00:00:{i:02d}", "thread_open": i % 4 == 0}) for i in range(12) for t in ("message", "typing")]
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        (source / f"{k}.txt").write_text("\n".join([*frames[k::3], "{not json"]))
    stream = conversations.state(conversations.messages(spark.readStream.text(str(source))))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("talks").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    found = {tuple(r) for r in spark.table("talks").collect()}
    assert found == {tuple(r) for r in conversations.state(conversations.messages(spark.read.text(str(source)))).collect()}
    assert {(r[0], r[1], r[3]) for r in found} == {("u0", "m9", 3), ("u1", "m10", 3), ("u2", "m11", 3)}
