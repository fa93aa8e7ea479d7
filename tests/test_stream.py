"""Small exact cases of the fluent interface."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions import aggregates as agg
from tidemill.functions.windows import Count, Global, Session, Sliding, Tumbling
from tidemill.operators import keyed, watermarks, windowed
from tidemill.operators.ordered import framed, next_min, numbered, running_max
from tidemill.plans.stream import Stream, StreamConfig
from tidemill.sources.readers import collection
from tidemill.sources.sinks import Collect, fan_out


def made(spark, rows, delay=0, ttl=0):
    """rows: (value, ms) in arrival order."""
    df = collection(spark, rows, "value int, t bigint", event_time_ms=lambda r: r[1])
    return Stream(df, config=StreamConfig(delay=delay, ttl=ttl))


def results(stream, column="result"):
    return sorted(r[column] for r in stream.collect())


def test_running_sum_by_parity(spark):
    s = made(spark, [(v, 0) for v in (1, 2, 3, 4, 1, 2)]).key_by(parity=F.col("value") % 2)
    assert results(s.aggregate(agg.sum_long(), F.col("value"))) == [1, 2, 4, 5, 6, 8]


def test_only_closed_windows_are_emitted(spark):
    s = made(spark, [(10, 500), (20, 800), (30, 1500)])
    assert results(s.window(Tumbling(1000)).aggregate(F.sum("value").alias("result"))) == [30]
    assert results(s.window(Tumbling(1000)).flushed().aggregate(F.sum("value").alias("result"))) == [30, 30]


def test_window_closes_at_its_last_millisecond(spark):
    assert results(made(spark, [(10, 500), (1, 999)]).window(Tumbling(1000)).aggregate(F.sum("value").alias("result"))) == [11]
    assert results(made(spark, [(10, 500), (1, 998)]).window(Tumbling(1000)).aggregate(F.sum("value").alias("result"))) == []


def test_window_reduce_max(spark):
    assert results(made(spark, [(5, 100), (3, 200), (8, 1200)]).window(Tumbling(1000)).reduce(F.col("value"), builtin=F.max)) == [5]


def test_keyed_window(spark):
    s = made(spark, [(10, 100), (20, 200), (30, 500)]).key_by(k=F.when(F.col("value") > 15, "A").otherwise("B"))
    assert results(s.window(Tumbling(500)).aggregate(F.sum("value").alias("result"))) == [10, 20]


def test_late_row_opens_a_fresh_pane(spark):
    s = made(spark, [(10, 500), (0, 999), (5, 800), (0, 1200)])
    out = s.window(Tumbling(1000)).panes().aggregate(F.sum("value").alias("result"))
    assert results(out) == [5, 10]


def test_map_drops_nulls_and_keeps_order_of_operations(spark):
    s = made(spark, [(v, 0) for v in range(1, 11)]).filter(F.col("value") % 2 == 0).map(square=F.col("value") * F.col("value"))
    assert results(s, "square") == [4, 16, 36, 64, 100]
    assert results(made(spark, [(1, 0), (2, 0)]).map(x=F.when(F.col("value") > 1, F.col("value"))), "x") == [2]


def test_count_windows_fire_when_complete(spark):
    s = made(spark, [(v, v) for v in range(10)])
    assert results(s.window(Count(4)).aggregate(F.sum("value").alias("result"))) == [6, 22]
    assert results(s.window(Count(4, 2)).aggregate(F.sum("value").alias("result"))) == [6, 14, 22, 30]
    assert results(s.window(Global()).trigger(5).aggregate(F.sum("value").alias("result"))) == [10, 35]


def test_sliding_windows_with_gaps_leave_rows_out(spark):
    s = made(spark, [(1, 0), (2, 500), (4, 1500), (8, 3100)])
    assert results(s.window(Sliding(1000, 3000)).flushed().aggregate(F.sum("value").alias("result"))) == [3, 8]
    assert results(s.window(Sliding(1000, 400)).flushed().aggregate(F.count(F.lit(1)).alias("result"))).count(1) > 0


def test_sessions_merge(spark):
    s = made(spark, [(1, 0), (2, 900), (4, 1800), (8, 9000)])
    assert results(s.window(Session(1000)).flushed().aggregate(F.sum("value").alias("result"))) == [7, 8]
    assert results(s.window(Session(1000, merge=False)).flushed().aggregate(F.sum("value").alias("result"))) == [1, 2, 4, 8]


def test_fold_and_apply_see_each_row_once_in_arrival_order(spark):
    w = made(spark, [(3, 10), (1, 5), (2, 7), (0, 5000)]).window(Tumbling(1000))
    assert results(w.fold(F.lit(""), lambda a, v: F.concat(a, v.cast("string")), F.col("value"))) == ["312"]
    assert results(w.apply(lambda xs: F.size(xs), F.col("value"))) == [3]


def test_side_output_holds_the_late_rows(spark):
    w, late = made(spark, [(1, 5000), (2, 100), (3, 6000)]).window(Tumbling(1000)).side_output_late()
    assert [r.value for r in late.collect()] == [2]
    assert results(w.flushed().aggregate(F.sum("value").alias("result"))) == [1, 3]


def test_sinks_do_not_stop_each_other(spark):
    kept = Collect()

    def bad(df):
        raise ValueError("no")

    failed = fan_out(made(spark, [(1, 0), (2, 0)]).df, [bad, kept])
    assert len(failed) == 1 and len(kept.take()) == 2 and kept.take() == []


def test_empty_and_null_inputs(spark):
    s = made(spark, [(1, 0)]).filter(F.lit(False))
    assert results(s.window(Tumbling(1000)).aggregate(F.sum("value").alias("result"))) == []
    s = made(spark, [(None, 0), (4, 1), (0, 5000)])
    out = s.window(Tumbling(1000)).aggregate(agg.sum_long().column(F.col("value")).alias("result"), agg.average().column(F.col("value")).alias("mean"))
    assert [(r.result, r.mean) for r in out.collect()] == [(4, 2.0)]


def simulated(rows, size, delay):
    """Panes by replaying row by row."""
    wm, open_, out = None, {}, []
    for value, ms in rows:
        start = ms - ms % size
        open_[start] = open_.get(start, 0) + value
        new = ms - delay if wm is None else max(wm, ms - delay)
        if wm is None or new > wm:
            wm = new
            for s in [s for s in open_ if s + size - 1 <= wm]:
                out.append((s, open_.pop(s)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_panes_match_a_replay(spark, seed):
    r = random.Random(seed)
    rows = [(r.randint(1, 9), max(0, i * 40 + r.randint(-600, 600))) for i in range(120)]
    df = numbered(collection(spark, rows, "value int, t bigint", event_time_ms=lambda x: x[1]), ["sequence_number"], block=16)
    df = watermarks.bounded_out_of_orderness(df, delay=200, block=16)
    out = watermarks.panes(windowed.assign(df, Tumbling(500)), block=160).groupBy("window_start", "pane").agg(F.sum("value").alias("v"))
    assert sorted((x.window_start, x.v) for x in out.collect()) == simulated(rows, 500, 200)


def test_ttl_matches_a_replay(spark):
    r = random.Random(7)
    rows = [(r.randint(1, 9), max(0, i * 40 + r.randint(-600, 600)), r.randint(0, 3)) for i in range(150)]
    df = collection(spark, rows, "value int, t bigint, k int", event_time_ms=lambda x: x[1])
    df = watermarks.replay(df, ["sequence_number"], watermarks.WatermarkStrategy.bounded(F.col("ms"), 100), block=16)
    got = [x.s for x in keyed.running_with_ttl(df, ["k"], 300, agg.sum_long(), F.col("value"), "s").orderBy("rn").collect()]
    state, wm, want = {}, None, []
    for value, ms, k in rows:
        total = state.get(k, (0, 0))[0] + value
        state[k] = (total, ms)
        want.append(total)
        new = ms - 100 if wm is None else max(wm, ms - 100)
        if wm is None or new > wm:
            wm = new
            state = {key: v for key, v in state.items() if v[1] + 300 >= wm}
    assert got == want


def test_blocks_give_the_same_as_one_window(spark):
    df = collection(spark, [(random.Random(i).randint(0, 1000),) for i in range(200)], "v int")
    rows = sorted((r.sequence_number, r.v) for r in df.collect())
    up = {r.sequence_number: r.m for r in running_max(df, ["sequence_number"], F.col("v"), "m", block=16).collect()}
    down = {r.sequence_number: r.m for r in next_min(df, ["sequence_number"], F.col("v"), "m", block=16).collect()}
    assert all(up[i] == max(v for j, v in rows if j <= i) and down[i] == min(v for j, v in rows if j >= i) for i, _ in rows)
    from pyspark.sql import Window

    out = framed(numbered(df, ["sequence_number"]), "rn", 9, lambda d, p: d.withColumn("s", F.sum("v").over(Window.partitionBy(*p).orderBy("rn").rowsBetween(-9, 0))), block=32)
    assert {r.sequence_number: r.s for r in out.collect()} == {i: sum(v for _, v in rows[max(0, i - 9) : i + 1]) for i, _ in rows}


def test_rows_without_an_order_stay_and_come_first(spark):
    df = spark.createDataFrame([(1, 5), (None, 7), (2, 1)], "k long, v long")
    got = {(r.k, r.v): (r.rn, r.m) for r in running_max(numbered(df, ["k"]), ["k"], F.col("v"), "m").collect()}
    assert got == {(None, 7): (1, 7), (1, 5): (2, 7), (2, 1): (3, 7)}
    assert {r.v: r.least for r in next_min(df, ["k"], F.col("v"), "least").collect()} == {7: 1, 5: 1, 1: 1}


def test_running_values_of_keys_cross_blocks(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", None]), r.randint(-9, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, k string, v int")
    for make, total in ((agg.sum_long(), sum), (agg.average(), lambda x: sum(x) / len(x)), (agg.maximum(), max), (agg.minimum(), min), (agg.count(), len)):
        got = {x.i: x.out for x in keyed.running_aggregate(df, ["k"], ["i"], make, F.col("v"), "out", block=32).collect()}
        for i, k, _ in rows:
            assert got[i] == pytest.approx(total([w for j, q, w in rows if j <= i and q == k]))
    assert {x.i: x.n for x in numbered(df, ["i"], "n", 32, ["k"]).collect()} == {i: sum(q == k for j, q, _ in rows if j <= i) for i, k, _ in rows}


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_frames_in_blocks(spark, block):
    from tidemill.operators import control

    r = random.Random(4)
    rows = [(i, i % 2, r.choice([None, float(r.randint(0, 50))]) if i % 17 == 0 else float(r.randint(0, 50))) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, k int, v double")
    got = {x.i: x for x in control.sliding_stats(df, ["k"], ["i"], "v", 20, block).collect()}
    for i, k, _ in rows:
        every = [v for j, q, v in rows if j <= i and q == k][-20:]
        own = [v for v in every if v is not None]
        if own:
            mean = sum(own) / len(own)
            assert (got[i].n, got[i].low, got[i].high, got[i].oldest) == (len(own), min(own), max(own), every[0])
            assert got[i].mean == pytest.approx(mean) and got[i].std == pytest.approx((sum(v * v for v in own) / len(own) - mean * mean) ** 0.5, abs=1e-6)


def test_sessions_have_merged_panes(spark):
    s = made(spark, [(1, 0), (2, 900), (4, 1800), (0, 9000), (3, 1000), (0, 20_000)])
    out = s.window(Session(1000)).panes().aggregate(F.sum("value").alias("result")).df
    assert sorted((r.window_start, r.window_end, r.result) for r in out.collect()) == [(0, 2800, 3), (0, 2800, 7), (9000, 10_000, 0)]


def test_an_explicit_lateness_of_zero_holds(spark):
    rows = [(1, 5000), (2, 4900), (3, 9000)]
    s = made(spark, rows).with_config(StreamConfig(delay=0, lateness=1000))
    w = s.window(Tumbling(1000)).flushed()
    assert results(w.allowed_lateness(0).aggregate(F.sum("value").alias("result"))) == [1, 3]
    assert results(w.allowed_lateness(200).aggregate(F.sum("value").alias("result"))) == [1, 2, 3]
    _, late = s.window(Tumbling(1000)).allowed_lateness(0).side_output_late()
    assert [r.value for r in late.collect()] == [2]


def test_plans_are_lazy(spark):
    def boom(batches):
        raise RuntimeError("ran")
        yield

    df = spark.range(3).selectExpr("id AS sequence_number", "id AS ms", "1 AS value").mapInPandas(boom, "sequence_number long, ms long, value int")
    s = Stream(df)
    for w in (s.window(Tumbling(10)), s.window(Tumbling(10)).panes(), s.window(Tumbling(10)).allowed_lateness(0)):
        assert w.aggregate(F.sum("value").alias("result")).df.columns  # nothing has run


def test_triggers_by_a_replay():
    from tidemill.functions.triggers import EventTime, Every, ProcessingTime, Result, Trigger, firings

    rows = [(10, None, 5), (20, 5, 15), (99, 12, 99), (30, 150, 120)]
    assert firings(EventTime(), rows, 100, 150) == [[0, 1], [0, 1], [0, 1], []]  # the row in the last millisecond fires early, then the watermark; a late row waits for the next
    assert firings(EventTime(), rows, 100, 151) == [[0, 1], [0, 1], [0, 1], [2]]
    assert firings(Every(rows=2), rows, 100, None) == [[0], [0], [1], [1]]
    assert firings(Every(rows=3), rows, 100, None, flush=True) == [[0], [0], [0], [1]]
    assert firings(ProcessingTime(), rows, 100, 500) == [[0], [0], [0], [1]]

    class Drop(Trigger):
        def on_element(self, ms, end, state):
            return Result.PURGE if ms == 20 else Result.CONTINUE

    assert firings(Drop(), rows, 100, 500, flush=True) == [[], [], [0], [0]]


def test_ttl_of_reductions(spark):
    s = made(spark, [(5, 0), (1, 10), (0, 5000), (2, 6000)], ttl=100).key_by(k=F.col("value") == 0)  # the other key's row lets the watermark pass
    assert [r.result for r in s.reduce(F.col("value"), builtin=F.max).df.orderBy("sequence_number").collect()] == [5, 5, 0, 2]
    assert [r.result for r in s.reduce(F.col("value"), add=lambda a, b: a + b).df.orderBy("sequence_number").collect()] == [5, 6, 0, 2]


def test_accumulators_combine(spark):
    words = agg.Accumulator(F.array().cast("array<int>"), lambda a, v: F.array_union(a, F.array(v)), F.array_union, F.size)
    df = spark.createDataFrame([(i, i % 3, i % 7) for i in range(500)], "i long, k int, v int").repartition(3)
    from tidemill.operators.keyed import combined

    assert {r.k: r.n for r in combined(df, ["k"], words, F.col("v"), "n", piece=16).collect()} == {0: 7, 1: 7, 2: 7}
    assert combined(df.where("false"), ["k"], words, F.col("v"), "n").count() == 0
