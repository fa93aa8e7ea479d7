import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import statistics as st
from tidemill.operators import control, store
from tidemill.sources.readers import KafkaConfig, collection, file_topic
from tidemill.sources.sinks import idempotent


def test_optimal_window():
    assert st.optimal_window(5000, 2000, 2000) == pytest.approx(10_000)
    assert st.optimal_window(5000, 200, 3000) > st.optimal_window(5000, 2000, 2200)


def test_ewma_matches_its_recurrence(spark):
    r = random.Random(1)
    values = [r.random() * 100 for _ in range(2000)]
    df = collection(spark, values, "x double")
    got = [row.y for row in control.ewma(df.withColumn("k", F.lit(1)), ["k"], ["sequence_number"], F.col("x"), "y", block=256).orderBy("sequence_number").collect()]
    y, want = 0.0, []
    for x in values:
        y = 0.3 * x + 0.7 * y
        want.append(y)
    assert got == pytest.approx(want, rel=1e-9)


def test_rate_limit_falls_under_load_and_recovers():
    falls = control.rate_limits([(5000, 900)] * 30)
    assert falls[-1][0] < falls[0][0] and falls[-1][1] == "CRITICAL"
    assert control.rate_limits([(5000, 0)]) == [(control.UNLIMITED, "NORMAL")]
    assert control.rate_limits([(0.5, 250), (0.5, 250)]) == [(100_000.0, "NORMAL"), (100_000.0, "NORMAL")]
    back = control.rate_limits([(5000, 900)] * 30 + [(5000, 1)] * 400)
    assert back[-1][0] > falls[-1][0]


def test_window_size_changes_only_by_more_than_a_tenth():
    out = control.window_sizes([(i * 20_000, 5000.0, 200.0) for i in range(40)])
    sizes = [s for s, _ in out]
    assert all(a == b or abs(a - b) / a > 0.1 for a, b in zip(sizes, sizes[1:]))
    assert out[0] == (5833.0, 240.0)


def test_constant_values_are_normal(spark):
    df = collection(spark, [100.0] * 100, "x double").withColumn("k", F.lit(1)).withColumn("at", F.col("sequence_number") * 1000)
    out = control.anomalies(df, ["k"], ["sequence_number"], "at", "x").groupBy("level").count().collect()
    assert [(r.level, r["count"]) for r in out] == [("NORMAL", 100)]


def test_copies_of_a_history_leave_its_seasonal_mean(spark):
    histories = {"a": [23.8], "b": [13.3, 21.5], "c": [100.01, 150.02, 119.77], "d": [1e300], "e": [1 / 3], "f": [None], "g": [None, 7.25]}
    rows = [(k, c, v) for k, vs in histories.items() for c in (1, 7, 60) for v in vs * c]
    df = spark.createDataFrame([(k, c, 0, v) for k, c, v in rows] + [(k, c, control.HOUR, 0.0) for k in histories for c in (1, 7, 60)], "k string, copies int, ms bigint, x double")
    out = control.seasonal_mean(df, ["k", "copies"], "ms", "x", "m").where(F.col("ms") > 0).select("k", "copies", "m").collect()
    got = {(r.k, r.copies): r.m for r in out}
    exact = {"a": 23.8, "b": 17.4, "c": 36980 / 300, "f": None, "g": 7.25}
    assert len(got) == 21 and all(got[k, c] == want for k, want in exact.items() for c in (1, 7, 60))
    assert all(got["d", c] == pytest.approx(1e300, rel=1e-13) and got["e", c] == pytest.approx(1 / 3, rel=1e-15) for c in (1, 7, 60))


def test_store_on_disk(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "kv"))
    rows = lambda data: spark.createDataFrame(data, "key string, value string, seq bigint, deleted boolean")
    s.flush(rows([(f"key{i:03d}", str(i), i, False) for i in range(100)]))
    s.flush(rows([("key001", "new", 200, False), ("key002", None, 201, True)]))
    assert store.get(s.log(), "key001").first().value == "new"
    assert store.get(s.log(), "key002").count() == 0
    assert [r.key for r in store.scan(s.log(), "key010", "key020").collect()] == [f"key{i:03d}" for i in range(10, 21)]
    s.compact()
    assert store.latest(s.log()).count() == 99 and s.stats().first().versions == 100
    s.flush(rows([("key002", "back", 300, False)]))
    assert store.get(s.log(), "key002").first().value == "back"


def test_compaction_choices():
    seg = [store.Segment(str(i), n) for i, n in enumerate([100, 10, 11, 12, 13, 200])]
    assert [s.name for s in store.size_tiered(seg)] == ["1", "2", "3", "4"]
    assert store.size_tiered(seg[:3]) == []
    assert [s.name for s in store.leveled([store.Segment("a", 1, 0), store.Segment("b", 1, 1), store.Segment("c", 1, 1)])] == ["b", "c"]


def test_kafka_options():
    c = KafkaConfig("h:1", "orders", "g", exactly_once=True)
    assert c.source().options()["kafka.isolation.level"] == "read_committed"
    assert c.sink("out").options()["topic"] == "out" and c.sink().options()["kafka.acks"] == "all"


def test_file_topic_and_idempotent_batches(spark, tmp_path):
    rows = [("a-b", 0, i, i, f"k{i}".encode(), f"v{i}".encode()) for i in range(5)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, t bigint, key binary, value binary")
    df.select("topic", "partition", "offset", F.timestamp_millis("t").alias("timestamp"), "key", "value").write.parquet(str(tmp_path / "topic"))
    out = file_topic(spark, str(tmp_path / "topic"), streaming=False)
    assert out.where("value = 'v3'").first().attributes == {"topic": "a-b", "offset": "3", "partition": "0"}
    write = idempotent(str(tmp_path / "out"))
    write(out.select("key"), 4)
    write(out.select("key"), 4)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_segments_of_like_sizes_merge(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "kv"))
    rows = lambda data: spark.createDataFrame(data, "key string, value string, seq bigint, deleted boolean")
    for i in range(4):
        s.flush(rows([(f"k{j}", f"{i}", 10 * i + j, False) for j in range(5)]))
    assert s.compact_some() == ["1", "2", "3", "4"] and [x.name for x in s.segments()] == ["4"]
    assert s.compact_some() == [] and {r.value for r in store.latest(s.log()).collect()} == {"3"} and s.stats().first().versions == 5


def test_memory_table_and_log(spark, tmp_path):
    from tidemill.operators.memtable import Log, Tree

    kv = store.Store(spark, str(tmp_path / "kv"))
    t = Tree(kv, tmp_path / "wal", limit=50)
    for i in range(60):
        t.put(f"key{i:03d}", str(i))
    assert len(t.table) == 10 and len(kv.segments()) == 1
    t.put("key001", "new")
    t.delete("key002")
    again = Tree(kv, tmp_path / "wal")  # after a crash: the log gives the unflushed writes back
    for tree in (t, again):
        assert tree.get("key001") == "new" and tree.get("key002") is None and tree.get("key055") == "55" and tree.get("none") is None
        assert tree.range("key000", "key003") == [("key000", "0"), ("key001", "new"), ("key003", "3")]
    assert again.seq == t.seq == 62
    again.flush()
    assert store.get(kv.log(), "key002").count() == 0 and list(Log(tmp_path / "wal").replay()) == []
    log = Log(tmp_path / "other")
    log.append("a", "1", 1), log.append("b", None, 2)
    with (tmp_path / "other").open("ab") as f:
        f.write(b"half a record")
    assert list(Log(tmp_path / "other").replay()) == [("a", "1", 1), ("b", None, 2)]
    log = Log(tmp_path / "other")
    log.append("c", "", 3)
    assert list(log.replay())[-1] == ("c", "", 3)


def test_pull_sources(spark):
    from tidemill.sources.pull import pull, pull_source

    source = pull_source("numbers", "part int, n bigint", lambda i: ((i, n) for n in range(3)), 2, poll=lambda at: ([(0, n) for n in range(at, min(at + 2, 5))], min(at + 2, 5)))
    assert sorted(tuple(r) for r in pull(spark, source).collect()) == [(i, n) for i in range(2) for n in range(3)]
    q = pull(spark, source, streaming=True).writeStream.format("memory").queryName("pulled").trigger(processingTime="0 seconds").start()
    try:
        import time

        until = time.time() + 30
        while spark.table("pulled").count() < 5 and time.time() < until:
            time.sleep(0.2)
    finally:
        q.stop()
    assert sorted(r.n for r in spark.table("pulled").collect()) == [0, 1, 2, 3, 4]


def test_file_formats_and_jdbc_options(spark, tmp_path):
    from tidemill.sources.readers import files, jdbc_options

    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    for fmt in ("parquet", "orc", "json", "csv"):
        df.write.format(fmt).save(f"{tmp_path}/{fmt}")
        assert sorted((r.n, r.s) for r in files(spark, fmt, f"{tmp_path}/{fmt}", "n int, s string").collect()) == [(1, "a"), (2, None)]
    assert jdbc_options("jdbc:x", "t", "id", (0, 100), 4)["numPartitions"] == "4"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", "id")


def test_offsets_of_topics_with_any_name():
    import json

    c = KafkaConfig("h:1", "a-b-c", "g").source().at({"a-b-c": {0: 5, "1": 7}})
    assert json.loads(c.options()["startingOffsets"]) == {"a-b-c": {"0": 5, "1": 7}}
