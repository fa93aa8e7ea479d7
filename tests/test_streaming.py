"""Structured Streaming against the batch plans."""

from pyspark.sql import functions as F

from tidemill.streaming import stateful
from tidemill.streaming.runtime import CheckpointConfig, state_backend, status


def feed(spark, tmp_path, batches):
    """A stream that gets one file a batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "key string, seq bigint, ms bigint, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i:03d}")
    return spark.readStream.schema("key string, seq bigint, ms bigint, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")


def drain(df, tmp_path, mode):
    got = []
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert status(q)["batch"] is not None
    return got


def test_count_trigger_keeps_the_rest_in_state(spark, tmp_path):
    CheckpointConfig(str(tmp_path)).apply(spark)
    batches = [[("a", 1, 0, 1.0), ("a", 2, 0, 2.0)], [("a", 3, 0, 3.0), ("b", 4, 0, 9.0)], [("a", 5, 0, 4.0), ("a", 6, 0, 5.0), ("a", 7, 0, 6.0)]]
    out = drain(stateful.run(feed(spark, tmp_path, batches), stateful.CountTrigger(3)), tmp_path, "update")
    assert sorted(out) == [("a", 0, 6.0), ("a", 1, 15.0)]


def test_exact_window_fires_at_its_last_millisecond_and_reopens(spark, tmp_path):
    batches = [[("a", 1, 500, 10.0)], [("a", 2, 999, 1.0)], [("a", 3, 800, 5.0)], [("a", 4, 2500, 7.0)], [("a", 5, 9000, 0.0)]]
    out = drain(stateful.run(feed(spark, tmp_path, batches), stateful.ExactWindow(1000), timed=True), tmp_path, "append")
    assert sum(v for _, s, v in out if s == 0) == 16.0 and ("a", 2000, 7.0) in out


def test_state_backend_names(spark):
    state_backend(spark, "memory")
    assert "HDFSBacked" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state_backend(spark, "rocksdb")
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_lists_of_last_values(spark, tmp_path):
    batches = [[("a", 1, 0, 1.0), ("a", 2, 0, 3.0)], [("a", 3, 0, 8.0), ("b", 4, 0, 9.0)], [("a", 5, 0, None)]]
    out = drain(stateful.run(feed(spark, tmp_path, batches), stateful.LastValues(2)), tmp_path, "update")
    assert sorted(out) == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 5.5), ("a", 5, 4.0), ("b", 4, 9.0)]


def test_a_trigger_policy_in_a_stream(spark, tmp_path):
    from tidemill.functions.triggers import Every, EventTime

    batches = [[("a", 1, 100, 1.0), ("a", 2, 200, 2.0), ("a", 3, 300, 4.0)], [("a", 4, 400, 8.0), ("a", 5, 9000, 16.0)], [("a", 6, 9100, 32.0)]]
    out = drain(stateful.run(feed(spark, tmp_path, batches), stateful.TriggeredWindow(1000, Every(rows=2)), timed=True), tmp_path, "append")
    assert sorted(out) == [("a", 0, 3.0), ("a", 0, 12.0), ("a", 9000, 48.0)]
    out = drain(stateful.run(feed(spark, tmp_path / "t", batches), stateful.TriggeredWindow(1000, EventTime()), timed=True), tmp_path / "t", "append")
    assert ("a", 0, 15.0) in out


def test_state_and_offsets_survive_a_restart(spark, tmp_path):
    from tidemill.streaming.runtime import offsets

    got = []

    def go(rows, i):
        spark.createDataFrame(rows, "key string, seq bigint, ms bigint, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        df = spark.readStream.schema("key string, seq bigint, ms bigint, value double").parquet(f"{tmp_path}/in/*")
        q = stateful.run(df, stateful.RunningSum()).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
        return offsets(q)

    first = go([("a", 1, 0, 1.0), ("b", 2, 0, 5.0)], 0)
    second = go([("a", 3, 0, 2.0)], 1)  # a new query on the same checkpoint: neither state nor position is lost
    assert sorted(got) == [("a", 1, 1.0), ("a", 3, 3.0), ("b", 2, 5.0)] and first != second


def test_checkpoints_begin_by_their_interval_and_have_a_life(spark, tmp_path):
    import time

    from tidemill.streaming.runtime import Checkpoints

    log = Checkpoints(retain=3)
    spark.streams.addListener(log)
    try:
        df = feed(spark, tmp_path, [[("a", 1, 0, 1.0)], [("a", 2, 0, 2.0)]])
        seen = []
        q = CheckpointConfig(f"{tmp_path}/c", interval="300 milliseconds").start(df, lambda b, n: seen.append((n, b.count())))
        until = time.time() + 60
        while (len(seen) < 2 or log.latest() is None or log.latest().batch < 1) and time.time() < until:
            time.sleep(0.2)
        q.stop()
        assert seen == [(0, 1), (1, 1)] and log.latest().state == "COMPLETED" and status(q)["late_rows"] == 0

        def fail(b, n):
            raise ValueError("no")

        q = CheckpointConfig(f"{tmp_path}/d", interval="100 milliseconds").start(feed(spark, tmp_path / "f", [[("a", 1, 0, 1.0)]]), fail)
        while q.isActive and time.time() < until:
            time.sleep(0.2)
        while not log.failed and time.time() < until:
            time.sleep(0.2)
        assert log.failed[-1].state == "FAILED" and "no" in log.failed[-1].error
    finally:
        spark.streams.removeListener(log)


def test_late_rows_are_counted(spark, tmp_path):
    from tidemill.functions.windows import Tumbling
    from tidemill.streaming import windows as live

    df = feed(spark, tmp_path, [[("a", 1, 100_000, 1.0)], [("a", 2, 200_000, 1.0)], [("a", 3, 1, 1.0)], [("a", 4, 300_000, 1.0)]])
    q = live.aggregate(df, "ms", Tumbling(1000), ["key"], [F.sum("value").alias("s")], 0).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/s").format("memory").queryName("late_rows").trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    late = sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in [dict(x.asDict() if hasattr(x, "asDict") else x.__dict__) if not isinstance(x, dict) else x for x in p["stateOperators"]])
    q.stop()
    assert late == 1


def test_barriers_align(spark):
    from tidemill.streaming.barriers import Alignment, Barrier

    both = Barrier(1, 1000).align_with(Barrier(2, 2000))
    assert (both.number, both.ms, both.priority) == (2, 2000, 1)
    done = []
    a = Alignment(("x", "y"), done.append)
    a.record("x", 1)
    assert not a.barrier("x", Barrier(1, 0)) and a.progress == 0.5
    a.record("x", 2)
    a.record("y", 3)
    assert a.records() == [1, 3]
    assert a.barrier("y", Barrier(1, 0)) and done == [1] and a.records() == [2]
    a.barrier("x", Barrier(2, 0))
    a.record("x", 4)
    assert not a.barrier("y", Barrier(3, 0)) and a.aborted == [2] and a.records() == [4]
    assert not a.barrier("x", Barrier(2, 0)) and a.barrier("x", Barrier(3, 0)) and done == [1, 3]


def test_a_socket_is_read(spark):
    import socket
    import threading

    from tidemill.sources.readers import socket_text

    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        while True:
            try:
                c, _ = server.accept()
            except OSError:
                return
            c.sendall(b"one\ntwo\n")

    threading.Thread(target=serve, daemon=True).start()
    q = socket_text(spark, "127.0.0.1", server.getsockname()[1]).writeStream.format("memory").queryName("socket_rows").start()
    try:
        import time

        until = time.time() + 30
        while spark.table("socket_rows").count() < 2 and time.time() < until:
            time.sleep(0.2)
        assert sorted(r.value for r in spark.table("socket_rows").collect()) == ["one", "two"]
    finally:
        q.stop()
        server.close()
