import pytest

from tidemill.plans.catalogue import QUERIES, SQL
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_interval_trace_is_greedy(spark, sf):
    from tidemill.plans import catalogue

    moved = sorted(tuple(r) for r in catalogue.watermark_trace(spark, sf).collect())
    want, last = [], None
    for i, (rn, wm) in enumerate(moved):
        if last is None or wm >= last + 24 * catalogue.H or i == len(moved) - 1:
            want.append((rn, wm))
            last = wm
    assert sorted(tuple(r) for r in catalogue.watermark_trace_interval(spark, sf).collect()) == want


def samples(spark, sf):
    """The samples of the controllers, by type, in order."""
    from tidemill.plans import catalogue

    by = {}
    for r in catalogue.samples(spark, sf).orderBy("event_type", "at").collect():
        by.setdefault(r.event_type, []).append((r.at, r.rate, r.latency))
    return by


def trunc(x):
    return int(x)  # whole numbers are cut towards zero


def test_backpressure_replays_its_rules(spark, sf):
    from tidemill.plans import catalogue

    want = {}
    for kind, rows in samples(spark, sf).items():
        limit, level, total, last_error, integral, previous = None, "NORMAL", 0, 0.0, 0.0, 0.0
        for n, (at, rate, latency) in enumerate(rows, 1):
            total += trunc(latency)
            mean = total // n
            if mean > 0:
                error = (500 - mean) / 500
                if last_error <= 0 and error > 0:
                    integral = previous = 0.0
                last_error = error
                if rate < 1:
                    predicted = trunc(100_000 * (500 / mean))
                else:
                    integral = min(30.0, max(-30.0, integral + error))
                    steer = 0.3 * error + 0.05 * integral + 0.02 * (error - previous)
                    previous = error
                    predicted = trunc(rate * 500 / mean * (1 + steer))
                current = 100_000 if limit is None else limit
                limit = min(100_000, max(1000, trunc(current + 0.1 * (predicted - current))))
                level = next(x for bound, x in ((-0.1, "NORMAL"), (-0.3, "MEDIUM"), (-0.6, "HIGH"), (float("-inf"), "CRITICAL")) if error > bound)
            want[kind, at] = (2147483647 if limit is None else limit, level)
    assert {(r.event_type, r.at): (r.rate_limit, r.severity) for r in catalogue.backpressure_trace(spark, sf).collect()} == want


def test_adaptive_windows_replay_their_rules(spark, sf):
    from tidemill.plans import catalogue

    want = {}
    for kind, rows in samples(spark, sf).items():
        size, disorder, integral, previous, kept = 5000, 5000, 0.0, 0.0, []
        for at, rate, latency in rows:  # samples are an hour apart, so each is looked at
            kept = [*kept, trunc(latency)][-1000:]
            s = sorted(kept)
            median, p95, p99 = (s[len(s) // 2], s[trunc(len(s) * 0.95)], s[trunc(len(s) * 0.99)])
            error = (2000 - median) / 2000
            integral += error
            best = trunc(2000 * (rate * 3600) / 1000 * (1 + 0.3 * error + 0.05 * integral + 0.02 * (error - previous)))
            previous = error
            if p99 / max(median, 1) > 3:
                best = trunc(best * (1 + min((p99 / max(median, 1) - 3) * 0.1, 0.3)))
            new = min(300_000, max(1000, trunc(size + 0.1 * (best - size))))
            if abs(new - size) > 0.1 * size:
                size, disorder = new, min(60_000, max(100, trunc(1.2 * p95)))
            want[kind, at] = (size, disorder)
    got = {(r.event_type, r.at): (r.window_size, r.disorder) for r in catalogue.adaptive_window_trace(spark, sf).collect()}
    assert got == want and len({s for s, _ in want.values()}) > 1
    # and the assigner that is fed with them
    by = {}
    for r in catalogue.events(spark, sf).collect():
        s = int(want[r.event_type, r.ms - r.ms % catalogue.H][0])
        k = (r.event_type, r.ms - r.ms % s, r.ms - r.ms % s + s)
        by[k] = by.get(k, 0) + 1
    assert {(r.event_type, r.window_start, r.window_end): r.cnt for r in catalogue.adaptive_windows(spark, sf).collect()} == by


def test_idle_partitions_by_a_replay(spark, sf):
    from tidemill.plans import catalogue

    rows = catalogue.arrived(spark, sf).selectExpr("rn", "ms", "user_id % 10 AS p", "ms + event_id * 7919 % 5000 AS clock").orderBy("rn").collect()
    mark, moved, low, began, want = {}, {}, None, None, {}
    for r in rows:
        began = r.clock if began is None else min(began, r.clock)
        if r.ms > mark.get(r.p, -1):
            mark[r.p] = r.ms
            moved[r.p] = max(moved.get(r.p, -1), r.clock)
        active = [p for p in range(10) if r.clock - moved.get(p, began) <= catalogue.H]
        if active and all(p in mark for p in active):
            now = min(mark[p] for p in active) - catalogue.DELAY
            low = now if low is None else max(low, now)
        want[r.rn] = low
    got = {r.rn: r.global_wm for r in catalogue.partitioned_watermark_idle(spark, sf).collect()}
    assert got == want and len(set(want.values())) > 10


def test_plans_of_the_watermark_family_are_flat(spark, sf):
    from tidemill.plans import catalogue

    for name, scans, exchanges in (("watermark_trace", 2, 4), ("late_panes", 4, 16), ("late_panes_keyed", 4, 16), ("keyed_running_ttl", 2, 8), ("partitioned_watermark_min", 4, 12)):
        plan = getattr(catalogue, name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") <= scans and plan.count("Exchange") <= exchanges, (name, plan.count("Scan parquet"), plan.count("Exchange"))


def test_latencies_reach_back_1000_rows(spark, tmp_path):
    rows = spark.range(1200).selectExpr("id AS event_id", "timestamp_millis(id) AS ts", "1L AS user_id", "'a' AS event_type", "double(id * 7919 % 1201) AS value", "'' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    values = [float(i * 7919 % 1201) for i in range(1200)]
    for r in QUERIES["latency_percentiles"](spark, str(tmp_path)).collect():
        own = sorted(values[max(0, r.event_id - 999) : r.event_id + 1])
        assert [r.median, r.p95, r.p99] == [own[int(len(own) * p)] for p in (0.5, 0.95, 0.99)]
