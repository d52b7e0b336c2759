"""Streams of run events."""

from quillon.streaming import runs


def test_replays_are_dropped_and_other_events_pass(spark, tmp_path):
    rows = [(1, "r", "delta", 1, "a"), (2, "r", "delta", 2, "b"), (3, "r", "delta", 2, "b"), (4, "r", "tool", 1, "t"), (5, "r", "delta", 3, "c"), (6, "s", "delta", 1, "z")]
    src = tmp_path / "in"
    kinds = "arrival long, run_id string, event string, seq long, content string"
    spark.createDataFrame(rows[:3], kinds).coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(kinds).parquet(str(src))

    def drain():
        q = runs.without_replays(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    drain()
    spark.createDataFrame([(2, "r", "delta", 2, "b"), *rows[3:]], kinds).coalesce(1).write.mode("append").parquet(str(src))
    drain()
    got = sorted((r.run_id, r.event, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("r", "delta", 1), ("r", "delta", 2), ("r", "delta", 3), ("r", "tool", 1), ("s", "delta", 1)]


def test_stored_and_replayed(spark):
    kinds = "arrival long, run_id string, event string, seq long, content string"
    df = spark.createDataFrame([(1, "r", "delta", 1, "a"), (2, "r", "delta", 1, "a"), (3, "r", "message", 2, "b")], kinds)
    assert runs.to_store(df).count() == 1
    assert runs.replayed(df).first().text == "ab"
