"""The queries of this engine over the test tables, each with the SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import statistics as st
from ..functions.time import epoch_ms, is_late
from ..functions.triggers import ProcessingTime, Result, Trigger
from ..functions.windows import Count, Global, Session, Sliding, Tumbling
from ..operators import control, keyed, store, watermarks, windowed
from ..sources.readers import files, records, table
from ..streaming import stateful
from ..streaming import windows as live
from ..streaming.runtime import run_available, shared_folder
from . import scenarios
from .stream import Stream, StreamConfig

H = 3_600_000
DELAY = H


@dataclass(frozen=True)
class FireOnTime(Trigger):
    """Fires and purges when a watermark reaches the window's last millisecond."""

    def on_event_time(self, watermark: int, end: int, state: dict) -> Result:
        return Result.FIRE_AND_PURGE if watermark >= end - 1 else Result.CONTINUE


@dataclass(frozen=True)
class EachRow(Trigger):
    """Fires for every row and keeps them all."""

    def on_element(self, ms: int, end: int, state: dict) -> Result:
        return Result.FIRE


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EV = "ev AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id, event_type, value, props FROM events)"
#: Arrival order, out of step with event time by up to 50 rows; watermarks as a replay sees them.
AR = f"""{EV}, ar AS (SELECT *, row_number() OVER (ORDER BY event_id + (event_id * 7919) % 50, event_id) AS rn FROM ev),
t AS (SELECT *, max(ms) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) - {DELAY} AS wm FROM ar),
w AS (SELECT *, lag(wm) OVER (ORDER BY rn) AS previous_wm FROM t),
e AS (SELECT *, (previous_wm IS NULL OR wm > previous_wm) AS emits FROM w)"""
LAST = f"(SELECT max(ms) FROM ev) - {DELAY}"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ms", epoch_ms("ts"))


def stream(spark: SparkSession, sf: str) -> Stream:
    return Stream(events(spark, sf).drop("ts"), order=("event_id",), config=StreamConfig(delay=DELAY))


def disordered(spark: SparkSession, sf: str, **config) -> Stream:
    """Events that arrive out of step with event time by up to 50 rows."""
    df = events(spark, sf).drop("ts").withColumn("arrival", F.col("event_id") + F.pmod(F.col("event_id") * 7919, F.lit(50)))
    return Stream(df, order=("arrival", "event_id"), config=StreamConfig(delay=DELAY, **config))


def arrived(spark: SparkSession, sf: str) -> DataFrame:
    """Events in arrival order with rn, wm, previous_wm and emits."""
    return disordered(spark, sf).with_watermarks()


#: Added before rounding, so that exact halves round alike whatever the order of a sum.
EPS = 1e-7


def r4(c):
    return F.round((F.col(c) if isinstance(c, str) else c) + EPS, 4)


SUMS = "count(*) AS cnt, round(sum(value) + 1e-7, 4) AS sum_value"


def sums() -> list:
    return [F.count(F.lit(1)).alias("cnt"), r4(F.sum("value")).alias("sum_value")]


# --- projections, records ---------------------------------------------------------------------------------------------


@query("SELECT event_id, round(value * value + 1e-7, 4) AS squared FROM events WHERE event_id % 2 = 0")
def filter_map(spark, sf):
    return stream(spark, sf).filter(F.col("event_id") % 2 == 0).map(squared=r4(F.col("value") * F.col("value"))).df.select("event_id", "squared")


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE value > 50")
def map_drops_nulls(spark, sf):
    return stream(spark, sf).map(doubled=F.when(F.col("value") > 50, F.col("value") * 2)).df.select("event_id", "doubled")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, true AS processed, CAST(json_extract(props, '$.k') AS BIGINT) ** 2 AS squared FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_rows(spark, sf):
    df = events(spark, sf).withColumn("k", F.from_json("props", "k bigint")["k"]).where(F.col("k").isNotNull())
    return df.select("event_id", "k", F.lit(True).alias("processed"), F.pow("k", F.lit(2)).cast("double").alias("squared"))


@query("SELECT CAST(event_type AS VARCHAR) AS key, CAST(event_id AS BIGINT) AS sequence_number, CAST(event_id * 7919 % 5000 AS BIGINT) AS latency FROM events")
def record_envelope(spark, sf):
    """Envelopes of events that are processed up to five seconds after they happened; latency is processing time minus event time."""
    df = table(spark, sf, "events").withColumn("seen", F.col("ts") + F.make_dt_interval(secs=F.pmod(F.col("event_id") * 7919, F.lit(5000)) / F.lit(1000).cast("decimal(9,0)")))
    out = records(df, "event_type", "value", "ts", "event_id", processing="seen")
    return out.select("key", "sequence_number", (F.unix_millis("processing_time") - F.unix_millis("event_time")).alias("latency"))


@query(f"WITH {EV} SELECT user_id, count(*) AS n FROM (SELECT user_id FROM ev WHERE event_type = 'click' UNION ALL SELECT user_id FROM ev WHERE event_type = 'purchase') GROUP BY 1")
def union_streams(spark, sf):
    s = stream(spark, sf)
    both = s.filter(F.col("event_type") == "click").union(s.filter(F.col("event_type") == "purchase"))
    return both.key_by("user_id").totals(F.count(F.lit(1)).alias("n")).df


# --- aggregates and keyed state ---------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT event_type, round(sum(value) + 1e-7, 4) AS sum_value, round(avg(value) + 1e-7, 4) AS avg_value, max(value) AS max_value, min(value) AS min_value, count(*) AS cnt, arg_max(event_id, event_id) AS last_event FROM ev GROUP BY 1")
def keyed_final_stats(spark, sf):
    return stream(spark, sf).key_by("event_type").totals(*agg.stats(F.col("value")), agg.last_by(F.col("event_id")).column(F.col("event_id")).alias("last_event")).df


@query("SELECT event_type, round(sum(coalesce(CASE WHEN event_id % 3 > 0 THEN value END, 0)) + 1e-7, 4) AS s, round(sum(coalesce(CASE WHEN event_id % 3 > 0 THEN value END, 0)) / count(*) + 1e-7, 4) AS a, round(avg(CASE WHEN event_id % 3 > 0 THEN value END) + 1e-7, 4) AS sql_a, CAST(sum(CASE WHEN event_id % 3 > 0 THEN event_id ELSE 0 END) AS BIGINT) AS l FROM events GROUP BY 1")
def null_aggregates(spark, sf):
    v, n = F.when(F.col("event_id") % 3 > 0, F.col("value")), F.when(F.col("event_id") % 3 > 0, F.col("event_id"))
    cols = [r4(agg.sum_double().column(v)).alias("s"), r4(agg.average().column(v)).alias("a"), r4(agg.average(ignore_nulls=True).column(v)).alias("sql_a"), agg.sum_long().column(n).alias("l")]
    return stream(spark, sf).key_by("event_type").totals(*cols).df


@query("SELECT user_id, CAST(sum(CAST(floor(value) AS BIGINT) % 7) AS BIGINT) AS folded FROM events GROUP BY 1")
def user_defined_aggregate(spark, sf):
    add = agg.user_defined("mod", F.lit(0).cast("bigint"), lambda a, v: a + F.floor(v).cast("bigint") % 7, order=F.col("event_id"))
    return stream(spark, sf).key_by("user_id").totals(add.column(F.col("value")).alias("folded")).df


@query("SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + 1e-7, 4) AS result FROM events")
def keyed_running_sum(spark, sf):
    return stream(spark, sf).key_by("user_id").aggregate(agg.sum_double(), F.col("value")).df.select("event_id", "user_id", r4("result").alias("result"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + 1e-7, 4) AS result, count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM events")
def keyed_running_average(spark, sf):
    s = stream(spark, sf).key_by("user_id").aggregate(agg.average(), F.col("value"))
    return s.key_by("user_id").aggregate(agg.count(), F.col("value"), into="n").df.select("event_id", r4("result").alias("result"), "n")


@query("SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS result FROM events")
def keyed_running_reduce_max(spark, sf):
    return stream(spark, sf).key_by("user_id").reduce(F.col("value"), builtin=F.max).df.select("event_id", "user_id", "result")


@query(
    f"""WITH {AR}, s AS (SELECT *, max(CASE WHEN emits THEN rn END) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_emit FROM e),
k AS (SELECT *, lag(ms) OVER (PARTITION BY user_id ORDER BY rn) AS pms, lag(rn) OVER (PARTITION BY user_id ORDER BY rn) AS prn FROM s),
b AS (SELECT *, CASE WHEN previous_wm > pms + {6 * H} AND last_emit >= prn THEN 1 ELSE 0 END AS brk FROM k),
l AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS life FROM b)
SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id, life ORDER BY rn ROWS UNBOUNDED PRECEDING) + 1e-7, 4) AS result FROM l"""
)
def keyed_running_ttl(spark, sf):
    out = keyed.running_with_ttl(arrived(spark, sf), ["user_id"], 6 * H, agg.sum_double(), F.col("value"), "result")
    return out.select("event_id", "user_id", r4("result").alias("result"))


@query(SQL["keyed_running_ttl"].replace("round(sum(value) OVER (PARTITION BY user_id, life ORDER BY rn ROWS UNBOUNDED PRECEDING) + 1e-7, 4)", "max(value) OVER (PARTITION BY user_id, life ORDER BY rn ROWS UNBOUNDED PRECEDING)"))
def keyed_reduce_ttl(spark, sf):
    return disordered(spark, sf, ttl=6 * H).key_by("user_id").reduce(F.col("value"), builtin=F.max).df.select("event_id", "user_id", "result")


@query("SELECT event_type, round(sum(value) / count(*) + 1e-7, 4) AS mean FROM events GROUP BY 1")
def user_defined_combined(spark, sf):
    """A user's aggregate with a merge: pieces of a key are folded apart and combined."""
    zero = F.struct(F.lit(0.0).alias("total"), F.lit(0).cast("bigint").alias("n"))
    add = lambda a, v: F.struct((a["total"] + v).alias("total"), (a["n"] + 1).alias("n"))
    merge = lambda a, b: F.struct((a["total"] + b["total"]).alias("total"), (a["n"] + b["n"]).alias("n"))
    mean = agg.Accumulator(zero, add, merge, lambda a: a["total"] / a["n"])
    return stream(spark, sf).key_by("event_type").combine(mean, F.col("value"), "mean").df.select("event_type", r4("mean").alias("mean"))


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE event_type = 'click'")
def keyed_map_filter(spark, sf):
    """map and filter of keyed and windowed streams work on the stream below."""
    s = stream(spark, sf).key_by("user_id").filter(F.col("event_type") == "click").window(Tumbling(H)).map(doubled=F.col("value") * 2)
    return s.df.select("event_id", "doubled")


@query("SELECT event_id, unnest(string_split(event_type, 'i')) AS piece FROM events")
def flat_map(spark, sf):
    return stream(spark, sf).flat_map("piece", F.split("event_type", "i")).df.select("event_id", "piece")


# --- windows ----------------------------------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT ms - ms % {H} AS window_start, ms - ms % {H} + {H} AS window_end, {SUMS} FROM ev GROUP BY 1, 2 HAVING window_end - 1 <= {LAST}")
def tumbling_agg(spark, sf):
    return stream(spark, sf).window(Tumbling(H)).aggregate(*sums()).df


@query(f"WITH {EV} SELECT user_id, ms - ms % {H} AS window_start, ms - ms % {H} + {H} AS window_end, {SUMS}, round(avg(value) + 1e-7, 4) AS avg_value FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2, 3 HAVING window_end - 1 <= (SELECT max(ms) FROM ev WHERE event_type = 'purchase') - {DELAY}")
def tumbling_keyed_agg(spark, sf):
    return stream(spark, sf).filter(F.col("event_type") == "purchase").key_by("user_id").window(Tumbling(H)).aggregate(*sums(), r4(F.avg("value")).alias("avg_value")).df


@query(f"WITH {EV} SELECT ms - ms % {H} AS window_start, ms - ms % {H} + {H} AS window_end, {SUMS} FROM ev GROUP BY 1, 2")
def tumbling_agg_all(spark, sf):
    return stream(spark, sf).window(Tumbling(H)).flushed().aggregate(*sums()).df


@query(f"WITH {EV}, x AS (SELECT *, unnest([ms - ms % {H}, ms - ms % {H} - {H}, ms - ms % {H} - {2 * H}]) AS s FROM ev) SELECT event_type, s AS window_start, s + {3 * H} AS window_end, {SUMS} FROM x GROUP BY 1, 2, 3 HAVING window_end - 1 <= {LAST}")
def sliding_agg(spark, sf):
    return stream(spark, sf).key_by("event_type").window(Sliding(3 * H, H)).aggregate(*sums()).df


@query(f"WITH {EV} SELECT ms - ms % {3 * H} AS window_start, ms - ms % {3 * H} + {H} AS window_end, {SUMS} FROM ev WHERE ms < ms - ms % {3 * H} + {H} GROUP BY 1, 2 HAVING window_end - 1 <= {LAST}")
def sliding_gap_agg(spark, sf):
    return stream(spark, sf).window(Sliding(H, 3 * H)).aggregate(*sums()).df


SESSIONS = f"g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) <= {2 * H} THEN 0 ELSE 1 END AS fresh FROM ev), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)"


@query(f"WITH {EV}, {SESSIONS} SELECT user_id, min(ms) AS window_start, max(ms) + {2 * H} AS window_end, {SUMS} FROM i GROUP BY user_id, island HAVING max(ms) + {2 * H} - 1 <= {LAST}")
def session_merged(spark, sf):
    return stream(spark, sf).key_by("user_id").window(Session(2 * H)).aggregate(*sums()).df


@query(f"WITH {EV}, {SESSIONS} SELECT event_id, min(ms) OVER (PARTITION BY user_id, island) AS window_start, max(ms) OVER (PARTITION BY user_id, island) + {2 * H} AS window_end FROM i")
def session_members(spark, sf):
    return windowed.sessions(events(spark, sf), 2 * H, ["user_id"]).select("event_id", "window_start", "window_end")


@query(f"WITH {EV} SELECT user_id, ms AS window_start, ms + {2 * H} AS window_end, {SUMS} FROM ev GROUP BY 1, 2, 3 HAVING window_end - 1 <= {LAST}")
def session_raw(spark, sf):
    return stream(spark, sf).key_by("user_id").window(Session(2 * H, merge=False)).aggregate(*sums()).df


@query(f"SELECT {SUMS} FROM events")
def global_window(spark, sf):
    return stream(spark, sf).window(Global()).aggregate(*sums()).df


@query("WITH r AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS n FROM events) SELECT event_type, n, round(sum(value) + 1e-7, 4) AS sum_value FROM r GROUP BY 1, 2 HAVING count(*) = 100")
def global_count_trigger(spark, sf):
    return stream(spark, sf).key_by("event_type").window(Global()).trigger(100).aggregate(r4(F.sum("value")).alias("sum_value")).df


@query("WITH r AS (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS n FROM events) SELECT user_id, n, round(sum(value) + 1e-7, 4) AS sum_value, max(event_id) AS last_event FROM r GROUP BY 1, 2 HAVING count(*) = 10")
def count_tumbling_keyed(spark, sf):
    return stream(spark, sf).key_by("user_id").window(Count(10)).aggregate(r4(F.sum("value")).alias("sum_value"), F.max("event_id").alias("last_event")).df


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s FROM events) SELECT user_id, (rn - 10) // 5 AS n, round(s + 1e-7, 4) AS sum_value FROM r WHERE rn >= 10 AND rn % 5 = 0")
def count_sliding_keyed(spark, sf):
    return stream(spark, sf).key_by("user_id").window(Count(10, 5)).aggregate(r4(F.sum("value")).alias("sum_value")).df


@query(f"WITH {EV} SELECT ms - ms % {H} AS window_start, ms - ms % {H} + {H} AS window_end, max(value) AS result FROM ev GROUP BY 1, 2 HAVING window_end - 1 <= {LAST}")
def window_reduce_max(spark, sf):
    return stream(spark, sf).window(Tumbling(H)).reduce(F.col("value"), builtin=F.max).df


@query(f"WITH {EV} SELECT user_id, ms - ms % {24 * H} AS window_start, ms - ms % {24 * H} + {24 * H} AS window_end, count(*) AS n, list_reduce(list(value ORDER BY event_id), lambda a, v: v - a) AS result FROM ev GROUP BY 1, 2, 3 HAVING window_end - 1 <= {LAST}")
def window_reduce_custom(spark, sf):
    """A reduction that depends on the order, over all closed windows."""
    w = stream(spark, sf).key_by("user_id").window(Tumbling(24 * H))
    return w.aggregate(F.count(F.lit(1)).alias("n"), windowed.reduce(lambda a, v: v - a, F.col("value"), F.struct("event_id")).alias("result")).df


@query(f"WITH {EV} SELECT ms - ms % {H} AS window_start, ms - ms % {H} + {H} AS window_end, string_agg(event_type, ',' ORDER BY event_id) AS result FROM ev GROUP BY 1, 2 HAVING window_end - 1 <= {LAST}")
def window_fold_concat(spark, sf):
    return stream(spark, sf).window(Tumbling(H)).fold(F.lit(""), lambda a, v: F.when(a == "", v).otherwise(F.concat(a, F.lit(","), v)), F.col("event_type")).df


@query(f"WITH {EV} SELECT event_type, ms - ms % {H} AS window_start, ms - ms % {H} + {H} AS window_end, list_sort(list(value))[count(*) // 2 + 1] AS result FROM ev GROUP BY 1, 2, 3 HAVING window_end - 1 <= {LAST}")
def window_apply_median(spark, sf):
    return stream(spark, sf).key_by("event_type").window(Tumbling(H)).apply(lambda values: st.percentile_of(F.array_sort(values), 0.5), F.col("value")).df


@query(f"WITH {EV} SELECT ms - ms % {H} AS window_start, sum_value || '/' || cnt AS label FROM (SELECT ms, count(*) OVER w AS cnt, CAST(round(sum(floor(value)) OVER w, 0) AS BIGINT) AS sum_value, row_number() OVER (PARTITION BY ms // {H} ORDER BY event_id) AS k FROM ev WINDOW w AS (PARTITION BY ms // {H})) WHERE k = 1 AND ms - ms % {H} + {H} - 1 <= {LAST}")
def window_aggregate_mapped(spark, sf):
    label = lambda df: df.select("window_start", F.concat_ws("/", "s", "cnt").alias("label"))
    return stream(spark, sf).window(Tumbling(H)).aggregate(F.count(F.lit(1)).alias("cnt"), F.sum(F.floor("value")).cast("bigint").alias("s"), then=label).df


@query(f"WITH {EV}, x AS (SELECT *, ms - ms % 1000 AS s, sum(value) OVER (PARTITION BY ms // 1000 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS r FROM ev) SELECT event_id, s AS window_start, round(r + 1e-7, 4) AS result FROM x WHERE ms = s + 999")
def early_fire_last_ms(spark, sf):
    out = windowed.early(events(spark, sf), Tumbling(1000), [], F.col("value"), F.sum, ["event_id"])
    return out.select("event_id", "window_start", r4("result").alias("result"))


# --- watermarks and late rows -----------------------------------------------------------------------------------------


@query(f"WITH {AR} SELECT rn, wm FROM e WHERE emits")
def watermark_trace(spark, sf):
    return watermarks.trace(arrived(spark, sf)).select("rn", "wm")


@query(f"WITH {AR} SELECT rn, wm - previous_wm AS step FROM e WHERE emits AND previous_wm IS NOT NULL AND wm - previous_wm >= 60000")
def watermark_steps(spark, sf):
    df = arrived(spark, sf).where(F.col("emits") & F.col("previous_wm").isNotNull())
    return df.select("rn", (F.col("wm") - F.col("previous_wm")).alias("step")).where("step >= 60000")


@query(None)
def watermark_trace_interval(spark, sf):
    """At most one watermark a day; the greedy choice has no simple SQL and is tested against a loop."""
    return watermarks.trace(arrived(spark, sf), interval=24 * H).select("rn", "wm")


@query(f"WITH {AR} SELECT event_id, rn, ms, previous_wm FROM e WHERE ms < previous_wm")
def late_records(spark, sf):
    return arrived(spark, sf).where(is_late(F.col("ms"), F.col("previous_wm"))).select("event_id", "rn", "ms", "previous_wm")


@query(f"WITH {AR} SELECT 'late' AS side, count(*) AS cnt, round(sum(value) + 1e-7, 4) AS sum_value FROM e WHERE ms < previous_wm - {H} UNION ALL SELECT 'main', count(*), round(sum(value) + 1e-7, 4) FROM e WHERE NOT coalesce(ms < previous_wm - {H}, false)")
def late_side_output(spark, sf):
    windows, late = disordered(spark, sf, lateness=H).window(Tumbling(H)).side_output_late()
    main = windows.stream.df
    return late.agg(*sums()).withColumn("side", F.lit("late")).unionByName(main.agg(*sums()).withColumn("side", F.lit("main")))


PANES = f"""n AS (SELECT *, min(CASE WHEN emits THEN rn END) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_emit, ms - ms % {H} AS ws, ms - ms % {H} + {H} AS we FROM e),
c AS (SELECT we, min(m.rn) AS first_close FROM (SELECT DISTINCT we FROM n) d JOIN (SELECT rn, wm FROM e WHERE emits) m ON m.wm >= d.we - 1 GROUP BY we)"""


@query(f"WITH {AR}, {PANES} SELECT ws AS window_start, we AS window_end, greatest(next_emit, first_close) AS pane, {SUMS} FROM n JOIN c USING (we) WHERE next_emit IS NOT NULL GROUP BY 1, 2, 3")
def late_panes(spark, sf):
    rows = watermarks.panes(windowed.assign(arrived(spark, sf), Tumbling(H)))
    return rows.groupBy("window_start", "window_end", "pane").agg(*sums())


@query(f"WITH {AR}, {PANES} SELECT user_id, ws AS window_start, we AS window_end, greatest(next_emit, first_close) AS pane, {SUMS} FROM n JOIN c USING (we) WHERE next_emit IS NOT NULL GROUP BY 1, 2, 3, 4")
def late_panes_keyed(spark, sf):
    return disordered(spark, sf).key_by("user_id").window(Tumbling(H)).panes().aggregate(*sums()).df


@query(f"WITH {AR} SELECT ms - ms % {H} AS window_start, ms - ms % {H} + {H} AS window_end, {SUMS} FROM e WHERE NOT coalesce(ms < previous_wm - {H // 2}, false) GROUP BY 1, 2 HAVING window_end - 1 <= {LAST}")
def allowed_lateness(spark, sf):
    return disordered(spark, sf).window(Tumbling(H)).allowed_lateness(H // 2).aggregate(*sums()).df


@query(f"WITH {AR} SELECT ms - ms % {H} AS window_start, ms - ms % {H} + {H} AS window_end, {SUMS} FROM e WHERE NOT coalesce(ms < previous_wm, false) GROUP BY 1, 2 HAVING window_end - 1 <= {LAST}")
def allowed_lateness_zero(spark, sf):
    """An explicit 0 holds against the configuration's hour."""
    return disordered(spark, sf, lateness=H).window(Tumbling(H)).allowed_lateness(0).aggregate(*sums()).df


@query(f"WITH {AR} SELECT count(*) AS records, count(*) FILTER (WHERE ms < previous_wm) AS late, count(*) FILTER (WHERE ms < previous_wm - {H}) AS dropped FROM e")
def late_counts(spark, sf):
    return watermarks.late_counts(arrived(spark, sf), H)


@query(f"WITH {AR}, {PANES} SELECT user_id, ws AS window_start, we AS window_end, {SUMS} FROM n JOIN c USING (we) WHERE next_emit IS NOT NULL GROUP BY user_id, ws, we, greatest(next_emit, first_close)")
def trigger_event_time(spark, sf):
    """Windows by an event-time trigger object: late rows fire again, in a firing of their own."""
    out = disordered(spark, sf).key_by("user_id").window(Tumbling(H)).trigger(FireOnTime()).aggregate(*sums())
    return out.df.drop("firing")


@query(f"WITH {EV}, r AS (SELECT *, ms - ms % {24 * H} AS ws, row_number() OVER (PARTITION BY event_type, ms - ms % {24 * H} ORDER BY event_id) - 1 AS k FROM ev) SELECT event_type, ws AS window_start, ws + {24 * H} AS window_end, k // 7 AS firing, {SUMS} FROM r GROUP BY 1, 2, 3, 4 HAVING count(*) = 7")
def trigger_count_in_window(spark, sf):
    return stream(spark, sf).key_by("event_type").window(Tumbling(24 * H)).trigger(7).aggregate(*sums()).df


@query(f"WITH {EV}, r AS (SELECT *, ms - ms % {24 * H} AS ws, row_number() OVER (PARTITION BY user_id, ms - ms % {24 * H} ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id, ms - ms % {24 * H}) AS m FROM ev), f AS (SELECT *, unnest(range(k - 1, m)) AS firing FROM r) SELECT user_id, ws AS window_start, ws + {24 * H} AS window_end, firing, {SUMS} FROM f GROUP BY 1, 2, 3, 4")
def trigger_every_row_keeps(spark, sf):
    """A trigger that fires for every row and purges nothing: each firing holds all rows so far."""
    return stream(spark, sf).key_by("user_id").window(Tumbling(24 * H)).trigger(EachRow()).aggregate(*sums()).df


@query(f"WITH {EV}, r AS (SELECT *, ms - ms % {H} AS ws FROM ev), c AS (SELECT ws, min(event_id) AS first FROM (SELECT DISTINCT ws FROM r) d JOIN (SELECT event_id, ms + event_id * 7919 % 5000 AS clock, ms FROM ev) p ON p.clock >= d.ws + {H} - 1 AND p.ms - p.ms % {H} = d.ws GROUP BY 1) SELECT ws AS window_start, {SUMS} FROM r JOIN c USING (ws) WHERE event_id <= first GROUP BY ws")
def trigger_processing_time(spark, sf):
    """The first firing of each hour by a clock that runs up to five seconds behind the events."""
    s = stream(spark, sf).map(clock=F.col("ms") + F.pmod(F.col("event_id") * 7919, F.lit(5000)))
    return s.window(Tumbling(H)).trigger(ProcessingTime(clock="clock")).aggregate(*sums()).df.where("firing = 0").drop("firing", "window_end")


@query(f"WITH {AR}, {SESSIONS.replace('FROM ev)', 'FROM e)')}, s AS (SELECT *, max(ms) OVER (PARTITION BY user_id, island) + {2 * H} AS we, min(ms) OVER (PARTITION BY user_id, island) AS ws FROM i), q AS (SELECT *, greatest(we - 1, coalesce(previous_wm + 1, we - 1)) AS ask FROM s), m AS (SELECT rn AS pane, wm FROM e WHERE emits) SELECT user_id, ws AS window_start, we AS window_end, pane, {SUMS} FROM q ASOF JOIN m ON q.ask <= m.wm GROUP BY 1, 2, 3, 4")
def session_panes(spark, sf):
    return disordered(spark, sf).key_by("user_id").window(Session(2 * H)).panes().aggregate(*sums()).df


@query(f"WITH {AR}, p AS (SELECT rn, max(CASE WHEN event_type = 'error' THEN ms - {2 * H} END) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS wm FROM ar) SELECT rn, wm FROM (SELECT *, lag(wm) OVER (ORDER BY rn) AS before FROM p) WHERE wm IS NOT NULL AND (before IS NULL OR wm > before)")
def watermark_punctuated(spark, sf):
    """A watermark strategy of one's own: only errors carry watermarks."""
    strategy = watermarks.WatermarkStrategy.punctuated(F.col("ms"), F.col("event_type") == "error", 2 * H)
    return watermarks.trace(disordered(spark, sf).assign_watermarks(strategy).with_watermarks()).select("rn", "wm")


@query(f"WITH {AR}, a AS (SELECT rn, max(ms) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS wm, max(ms) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ar) SELECT rn, wm FROM a WHERE before IS NULL OR wm > before")
def watermark_ascending(spark, sf):
    strategy = watermarks.WatermarkStrategy.ascending(F.col("ms"))
    return watermarks.trace(disordered(spark, sf).assign_watermarks(strategy).with_watermarks()).select("rn", "wm")


@query(None)
def partitioned_watermark_idle(spark, sf):
    """The smallest watermark of ten partitions, those idle for over an hour left out; a replay row by row is the test."""
    df = arrived(spark, sf).withColumns({"p": F.col("user_id") % 10, "clock": F.col("ms") + F.pmod(F.col("event_id") * 7919, F.lit(5000))})
    return watermarks.partitioned_min(df, "p", list(range(10)), delay=DELAY, idle=H, clock="clock").select("rn", "global_wm")


@query(f"WITH {EV}, c AS (SELECT user_id % 10 AS p, ms, ms + event_id * 7919 % 5000 AS clock FROM ev), s AS (SELECT p, max(ms) - {DELAY} AS watermark, arg_max(clock, ms) AS moved_at FROM c GROUP BY 1) SELECT *, (SELECT max(clock) FROM c) - moved_at > {H} AS idle FROM s")
def partition_status(spark, sf):
    df = events(spark, sf).withColumns({"p": F.col("user_id") % 10, "clock": F.col("ms") + F.pmod(F.col("event_id") * 7919, F.lit(5000))})
    return watermarks.partition_status(df, "p", delay=DELAY, idle=H)


@query(f"WITH {AR}, p AS (SELECT rn, max(CASE WHEN user_id % 3 = 0 THEN ms END) OVER o AS a, max(CASE WHEN user_id % 3 = 1 THEN ms END) OVER o AS b, max(CASE WHEN user_id % 3 = 2 THEN ms END) OVER o AS c FROM e WINDOW o AS (ORDER BY rn ROWS UNBOUNDED PRECEDING)) SELECT rn, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL THEN least(a, b, c) - {DELAY} END AS global_wm FROM p")
def partitioned_watermark_min(spark, sf):
    df = arrived(spark, sf).withColumn("p", F.col("user_id") % 3)
    return watermarks.partitioned_min(df, "p", [0, 1, 2], delay=DELAY).select("rn", "global_wm")


# --- store ------------------------------------------------------------------------------------------------------------

LOG = "lg AS (SELECT user_id AS key, value, event_id AS seq, event_type = 'error' AS deleted FROM events), nw AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS r FROM lg)"


def change_log(spark, sf) -> DataFrame:
    """Every event writes its user's value; an error deletes it."""
    ev = table(spark, sf, "events")
    written = store.put(None, ev.where("event_type <> 'error'").select(F.col("user_id").alias("key"), "value", F.col("event_id").alias("seq")))
    return store.delete(written, ev.where("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq")))


@query(f"WITH {LOG} SELECT key, value, seq FROM nw WHERE r = 1 AND NOT deleted")
def kv_latest(spark, sf):
    return store.latest(change_log(spark, sf))


@query(f"WITH {LOG} SELECT key, value, seq FROM nw WHERE r = 1 AND NOT deleted AND key = 7")
def kv_get(spark, sf):
    return store.get(change_log(spark, sf), 7)


@query(f"WITH {LOG} SELECT key, value, seq FROM nw WHERE r = 1 AND NOT deleted AND key BETWEEN 10 AND 20")
def kv_range(spark, sf):
    return store.scan(change_log(spark, sf), 10, 20)


@query(f"WITH {LOG} SELECT key, seq FROM nw WHERE r = 1 AND deleted")
def kv_deleted(spark, sf):
    return store.newest(change_log(spark, sf)).where("deleted").select("key", "seq")


@query(f"WITH {LOG} SELECT key, CASE WHEN deleted THEN NULL ELSE value END AS value, seq, deleted FROM nw WHERE r = 1")
def kv_compact(spark, sf):
    return store.compact(change_log(spark, sf))


def rolled(spark, sf) -> DataFrame:
    ev = events(spark, sf).withColumn("hour", F.col("ms") - F.pmod(F.col("ms"), F.lit(H)))
    return store.rollup(ev, "event_type", "user_id", "hour", sums())


@query(f"WITH {EV} SELECT event_type AS partition_key, user_id AS primary_key, ms - ms % {H} AS ts_ms, {SUMS} FROM ev GROUP BY 1, 2, 3")
def mergetree_insert(spark, sf):
    return rolled(spark, sf)


@query(f"WITH {EV} SELECT event_id // 500 AS batch, event_type AS partition_key, user_id AS primary_key, max(ms) AS ts_ms, {SUMS} FROM ev GROUP BY 1, 2, 3")
def mergetree_batch(spark, sf):
    return store.rollup_batches(events(spark, sf), F.expr("event_id div 500"), "event_type", "user_id", "ms", sums())


@query(f"WITH {EV} SELECT event_type AS partition_key, user_id AS primary_key, ms - ms % {H} AS ts_ms, {SUMS} FROM ev WHERE event_type = 'click' AND user_id BETWEEN 5 AND 25 GROUP BY 1, 2, 3")
def mergetree_range(spark, sf):
    return store.rollup_scan(rolled(spark, sf), "click", 5, 25)


@query(f"WITH {EV}, m AS (SELECT event_type, user_id, ms - ms % {H} AS h, count(*) AS n FROM ev GROUP BY 1, 2, 3) SELECT event_type AS partition_key, CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS merged_rows, round(1 - count(*) / sum(n), 6) AS ratio FROM m GROUP BY 1")
def mergetree_stats(spark, sf):
    ev = events(spark, sf).withColumn("hour", F.col("ms") - F.pmod(F.col("ms"), F.lit(H)))
    return store.merge_ratio(ev, "event_type", "user_id", "hour")


@query(f"WITH {EV}, r AS (SELECT event_type, user_id, ms - ms % {H} AS h, count(*) AS n, sum(value) AS s FROM ev GROUP BY 1, 2, 3) SELECT event_type AS partition_key, user_id AS primary_key, CAST(sum(n) AS BIGINT) AS cnt, round(sum(s), 2) AS sum_value FROM r GROUP BY 1, 2")
def mergetree_merge(spark, sf):
    return rolled(spark, sf).groupBy("partition_key", "primary_key").agg(F.sum("cnt").alias("cnt"), F.round(F.sum("sum_value"), 2).alias("sum_value"))


# --- statistics and control -------------------------------------------------------------------------------------------

LAST1000 = "PARTITION BY event_type ORDER BY event_id ROWS 999 PRECEDING"
ANOMALY = f"""an AS (SELECT event_id, event_type, ms, value, avg(value) OVER r AS m, sqrt(greatest(0, avg(value * value) OVER r - (avg(value) OVER r) ** 2)) AS s, first_value(value) OVER r AS o,
avg(value) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN {H + 59_999} PRECEDING AND {H - 59_999} PRECEDING) AS h FROM ev WINDOW r AS ({LAST1000})),
sc AS (SELECT event_id, CASE WHEN s > 1e-9 THEN abs(value - m) / s ELSE 0.0 END AS z, CASE WHEN o = 0 THEN CASE WHEN value > 0 THEN 1.7976931348623157e308 ELSE 0 END ELSE (value - o) / o END AS c,
CASE WHEN h IS NULL THEN 0.0 WHEN h = 0 THEN CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END ELSE abs(value - h) / abs(h) END AS d FROM an)"""


def scored(spark, sf, s=st.DEFAULT) -> DataFrame:
    return control.anomalies(events(spark, sf), ["event_type"], ["event_id"], "ms", "value", s)


@query(f"WITH {EV} SELECT event_id, round(avg(value) OVER r + 1e-7, 4) AS mean, round(sqrt(greatest(0, avg(value * value) OVER r - (avg(value) OVER r) ** 2)), 3) AS std, min(value) OVER r AS low, max(value) OVER r AS high, count(value) OVER r AS n FROM ev WINDOW r AS ({LAST1000})")
def sliding_stats(spark, sf):
    out = control.sliding_stats(events(spark, sf), ["event_type"], ["event_id"], "value")
    return out.select("event_id", r4("mean").alias("mean"), F.round("std", 3).alias("std"), "low", "high", "n")


@query(f"WITH {EV}, {ANOMALY} SELECT event_id, round(z, 3) AS z FROM sc WHERE z > 3")
def anomaly_3sigma(spark, sf):
    return scored(spark, sf).where("z > 3").select("event_id", F.round("z", 3).alias("z"))


@query(f"WITH {EV}, {ANOMALY} SELECT event_id, round(c + 1e-7, 4) AS change FROM sc WHERE abs(c) > 0.5")
def anomaly_change_rate(spark, sf):
    return scored(spark, sf).where("abs(change) > 0.5").select("event_id", r4("change").alias("change"))


@query(f"WITH {EV}, {ANOMALY} SELECT event_id, round(d + 1e-7, 4) AS seasonal FROM sc WHERE d > 0.3")
def anomaly_seasonal(spark, sf):
    return scored(spark, sf).where("seasonal > 0.3").select("event_id", r4("seasonal").alias("seasonal"))


LEVEL = "CASE WHEN p >= 3 THEN 'CRITICAL' WHEN p = 2 THEN 'HIGH' WHEN p = 1 THEN 'MEDIUM' ELSE 'NORMAL' END"


@query(f"WITH {EV}, {ANOMALY}, q AS (SELECT event_id, CASE WHEN z > 3 THEN 1 ELSE 0 END + CASE WHEN abs(c) > 0.5 THEN 2 ELSE 0 END + CASE WHEN d > 0.3 THEN 1 ELSE 0 END AS p FROM sc) SELECT event_id, {LEVEL} AS level FROM q")
def anomaly_level(spark, sf):
    return scored(spark, sf).select("event_id", "level")


@query(f"WITH {EV}, {ANOMALY}, q AS (SELECT CASE WHEN z > 2 THEN 1 ELSE 0 END + CASE WHEN abs(c) > 0.3 THEN 2 ELSE 0 END + CASE WHEN d > 0.2 THEN 1 ELSE 0 END AS p FROM sc) SELECT {LEVEL} AS level, count(*) AS cnt FROM q GROUP BY 1")
def anomaly_level_sensitive(spark, sf):
    return scored(spark, sf, st.SENSITIVE).groupBy("level").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"WITH {EV} SELECT event_type, ms - ms % {60_000} AS bucket_start, count(*) AS cnt, count(*) * 1000.0 / 60000 AS rate FROM ev GROUP BY 1, 2".replace("count(*) * 1000.0 / 60000", "round(CAST(count(*) * 1000 AS DOUBLE) / 60000, 6)"))
def arrival_rate(spark, sf):
    return control.arrival_rate(events(spark, sf), ["event_type"], "ms", 60_000).withColumn("rate", F.round("rate", 6))


@query(
    f"""WITH {EV}, g AS (SELECT event_id, event_type, CASE WHEN lag(ms) OVER o IS NOT NULL THEN 1000.0 / greatest(ms - lag(ms) OVER o, 1) END AS x FROM ev WINDOW o AS (PARTITION BY event_type ORDER BY event_id)),
l AS (SELECT event_id, event_type, list(x) FILTER (WHERE x IS NOT NULL) OVER (PARTITION BY event_type ORDER BY event_id ROWS 119 PRECEDING) AS v FROM g)
SELECT event_id, event_type, round(coalesce(list_sum(list_transform(v, lambda x, i: 0.3 * x * pow(0.7, len(v) - i))), 0) + 1e-7, 4) AS ewma FROM l"""
)
def ewma_rate(spark, sf):
    """All events, by type. The SQL sums the last 120 rates, whose weights beyond are under 1e-18."""
    return control.ewma_rate(events(spark, sf), ["event_type"], ["event_id"], "ms").select("event_id", "event_type", r4("ewma").alias("ewma"))


@query("WITH x AS (SELECT event_id, user_id, (200 - value) / 200 AS e FROM events) SELECT event_id, round(0.3 * e + 0.05 * sum(e) OVER (o ROWS UNBOUNDED PRECEDING) + 0.02 * (e - lag(e, 1, 0) OVER o) + 1e-8, 6) AS pid FROM x WINDOW o AS (PARTITION BY user_id ORDER BY event_id)")
def pid_trace(spark, sf):
    out = control.pid(events(spark, sf), ["user_id"], ["event_id"], (200 - F.col("value")) / 200, "pid")
    return out.select("event_id", F.round(F.col("pid") + 1e-8, 6).alias("pid"))


@query("WITH x AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 999 PRECEDING)) AS l FROM events) SELECT event_id, l[len(l) // 2 + 1] AS median, l[CAST(floor(len(l) * 0.95) AS BIGINT) + 1] AS p95, l[CAST(floor(len(l) * 0.99) AS BIGINT) + 1] AS p99 FROM x")
def latency_percentiles(spark, sf):
    return control.latency_percentiles(events(spark, sf), ["user_id"], ["event_id"], "value").select("event_id", "median", "p95", "p99")


@query("SELECT event_id, CASE WHEN e > -0.1 THEN 'NORMAL' WHEN e > -0.3 THEN 'MEDIUM' WHEN e > -0.6 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, round(value * 50 / 1000, 6) AS queue FROM (SELECT *, (50 - value) / 50 AS e FROM events)")
def latency_severity(spark, sf):
    return events(spark, sf).select("event_id", st.latency_severity((50 - F.col("value")) / 50).alias("severity"), F.round(st.queue_length(F.lit(50.0), F.col("value")), 6).alias("queue"))


def samples(spark, sf) -> DataFrame:
    """Hourly rate and mean value of each event type, the samples of the controllers."""
    by = events(spark, sf).groupBy("event_type", (F.col("ms") - F.pmod(F.col("ms"), F.lit(H))).alias("at"))
    return by.agg(F.count(F.lit(1)).cast("double").alias("rate"), r4(F.avg("value")).alias("latency"))


@query(None)
def backpressure_trace(spark, sf):
    """A controller that branches on its own state: a replay of its rules is the test."""
    out = control.folded(samples(spark, sf), ["event_type"], ["at"], ["rate", "latency"], control.rate_limits, "rate_limit double, severity string")
    return out.select("event_type", "at", F.round("rate_limit", 4).alias("rate_limit"), "severity")


@query(None)
def adaptive_window_trace(spark, sf):
    """Window sizes as if every event stood for one a second; a replay of the rules is the test."""
    busy = samples(spark, sf).withColumn("rate", F.col("rate") * 3600)
    out = control.folded(busy, ["event_type"], ["at"], ["at", "rate", "latency"], control.window_sizes, "window_size double, disorder double")
    return out.select("event_type", "at", F.round("window_size", 4).alias("window_size"), F.round("disorder", 4).alias("disorder"))


@query(None)
def adaptive_windows(spark, sf):
    """Tumbling windows whose size is the adaptive one of the hour and type: the sizes of adaptive_window_trace, fed to an assigner."""
    sizes = adaptive_window_trace(spark, sf).select(F.col("event_type").alias("t"), F.col("at").alias("hour"), F.col("window_size").cast("bigint").alias("size"))
    ev = events(spark, sf).withColumn("at", F.col("ms") - F.pmod(F.col("ms"), F.lit(H)))
    rows = ev.join(sizes, (F.col("event_type") == F.col("t")) & (F.col("at") == F.col("hour")))
    start = control.adaptive_starts(F.col("ms"), F.col("size"))
    return rows.groupBy("event_type", start.alias("window_start"), (start + F.col("size")).alias("window_end")).agg(*sums())


@query(
    f"""WITH {EV}, x AS (SELECT event_type, ms - ms % {H} AS hour, count(*)::DOUBLE AS rate, list_sort(list(value)) AS l FROM ev GROUP BY 1, 2),
y AS (SELECT event_type, hour, rate, l[len(l) // 2 + 1] * 10 AS m, l[CAST(floor(len(l) * 0.99) AS BIGINT) + 1] * 10 AS t FROM x),
z AS (SELECT *, 2 * rate * (1 + 0.37 * (2000 - m) / 2000) AS s, t / greatest(m, 1) AS r FROM y)
SELECT event_type, hour, round(CASE WHEN r > 3 THEN s * (1 + least((r - 3) * 0.1, 0.3)) ELSE s END + 1e-7, 4) AS size FROM z"""
)
def optimal_window(spark, sf):
    """The optimal window size of each type and hour, from the number of its events and the median and 99th percentile of ten times their values."""
    by = events(spark, sf).groupBy("event_type", (F.col("ms") - F.pmod(F.col("ms"), F.lit(H))).alias("hour"))
    seen = by.agg(F.count(F.lit(1)).cast("double").alias("rate"), F.array_sort(F.collect_list("value")).alias("l"))
    size = st.optimal_window_column(F.col("rate"), st.percentile_of(F.col("l"), 0.5) * 10, st.percentile_of(F.col("l"), 0.99) * 10)
    return seen.select("event_type", "hour", r4(size).alias("size"))


@query(f"WITH {EV}, n AS (SELECT event_type, max(ms) AS newest FROM ev GROUP BY 1) SELECT event_id FROM ev JOIN n USING (event_type) WHERE ms >= newest - {24 * H}")
def history_retained(spark, sf):
    return control.retained(events(spark, sf), ["event_type"], "ms").select("event_id")


# --- business queries -------------------------------------------------------------------------------------------------


@query("SELECT round(sum(o_totalprice), 2) AS gmv, count(*) AS order_count FROM orders")
def gmv(spark, sf):
    return scenarios.gmv(table(spark, sf, "orders"))


@query("SELECT p_type, round(sum(l_extendedprice), 2) AS sales FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY sales DESC, p_type LIMIT 5")
def category_ranking(spark, sf):
    sold = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return scenarios.ranking(sold, "p_type", [F.round(F.sum("l_extendedprice"), 2).alias("sales")], "sales", 5)


@query("SELECT n_name, count(*) AS order_count, round(sum(o_totalprice), 2) AS gmv FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_cities(spark, sf):
    placed = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return scenarios.ranking(placed, "n_name", [F.count(F.lit(1)).alias("order_count"), F.round(F.sum("o_totalprice"), 2).alias("gmv")], "order_count", 10)


@query("SELECT event_type, round(avg(value) + 1e-7, 4) AS avg_value, max(value) AS max_value, count(*) AS cnt FROM events GROUP BY 1")
def device_stats(spark, sf):
    return stream(spark, sf).key_by("event_type").totals(r4(F.avg("value")).alias("avg_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).alias("cnt")).df


@query("SELECT user_id, round(avg(value) + 1e-7, 4) AS avg_value, min(value) AS low, max(value) AS high, count(*) AS cnt, arg_max(value, event_id) AS latest FROM events GROUP BY 1")
def sensor_latest(spark, sf):
    return stream(spark, sf).key_by("user_id").totals(r4(F.avg("value")).alias("avg_value"), F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("cnt"), F.max_by("value", "event_id").alias("latest")).df


@query("SELECT count(*) AS cnt, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)), 0) AS BIGINT) AS total FROM orders WHERE o_totalprice >= 100000")
def large_tx(spark, sf):
    return scenarios.large(table(spark, sf, "orders"), "o_totalprice", 100_000)


@query(f"WITH {EV} SELECT user_id, count(*) AS n, (max(ms) - min(ms)) // (count(*) - 1) AS mean_gap FROM ev GROUP BY 1 HAVING count(*) >= 2 AND (max(ms) - min(ms)) // (count(*) - 1) < 36000000")
def high_freq_users(spark, sf):
    return scenarios.frequent_users(events(spark, sf), "user_id", "ms", 36_000_000)


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders o WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND NOT EXISTS (SELECT 1 FROM orders h WHERE h.o_orderdate < TIMESTAMP '1997-01-01' AND h.o_custkey = o.o_custkey AND h.o_orderpriority = o.o_orderpriority)")
def abnormal_location(spark, sf):
    o = table(spark, sf, "orders")
    cut = F.lit("1997-01-01").cast("timestamp_ntz")
    return scenarios.unusual_places(o.where(F.col("o_orderdate") >= cut), o.where(F.col("o_orderdate") < cut), "o_custkey", "o_orderpriority").select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT * FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'LARGE_AMOUNT' WHEN hour(o_orderdate) BETWEEN 2 AND 5 THEN 'ODD_HOUR' WHEN contains(o_orderpriority, 'URGENT') THEN 'SUSPICIOUS_MERCHANT' END AS rule FROM orders) WHERE rule IS NOT NULL")
def risk_rules(spark, sf):
    return scenarios.risk(table(spark, sf, "orders"), "o_totalprice", "o_orderdate", "o_orderpriority").select("o_orderkey", "rule")


@query(f"WITH {EV}, c AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {24 * H - 1} PRECEDING AND CURRENT ROW) AS recent FROM ev) SELECT * FROM c WHERE recent > 3")
def sliding_fraud(spark, sf):
    return scenarios.bursts(events(spark, sf), "user_id", "ms", 24 * H, 3).select("event_id", "user_id", "recent")


@query(f"WITH {EV}, o AS (SELECT user_id, ms, CAST(json_extract(props, '$.k') AS BIGINT) AS amount FROM ev), v AS (SELECT * FROM o WHERE user_id IS NOT NULL AND amount > 0) SELECT '{{\"user_id\":' || user_id || ',\"window_end\":' || (ms - ms % {H} + {H}) || ',\"order_count\":' || count(*) || ',\"total_amount\":' || CAST(sum(amount) AS BIGINT) || '}}' AS value FROM v GROUP BY user_id, ms - ms % {H} HAVING ms - ms % {H} + {H} - 1 <= (SELECT max(ms) FROM v) - {DELAY}")
def order_json_pipeline(spark, sf):
    s = Stream(scenarios.parsed_orders(table(spark, sf, "events")), order=("event_id",), config=StreamConfig(delay=DELAY))
    out = s.key_by("user_id").window(Tumbling(H)).aggregate(F.count(F.lit(1)).alias("order_count"), F.sum("amount").alias("total_amount"))
    return out.df.select(F.to_json(F.struct("user_id", "window_end", "order_count", "total_amount")).alias("value"))


# --- the same, streaming ----------------------------------------------------------------------------------------------

LIVE = f"HAVING window_end <= {LAST}"


def _folder(spark) -> str:
    """A folder for a run of a streaming query."""
    return f"{shared_folder(spark)}/tidemill-stream-{uuid.uuid4().hex}"


def live_events(spark, sf) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return files(spark, "parquet", f"{sf}/event[s].parquet", schema, streaming=True).withColumn("ms", epoch_ms("ts")).drop("ts")


@query(f"WITH {EV} SELECT event_type, ms - ms % {H} AS window_start, ms - ms % {H} + {H} AS window_end, {SUMS} FROM ev GROUP BY 1, 2, 3 {LIVE}")
def streaming_tumbling(spark, sf):
    at = _folder(spark)
    out = live.aggregate(live_events(spark, sf), "ms", Tumbling(H), ["event_type"], sums(), DELAY)
    return run_available(out, f"{at}/out", f"{at}/state")


@query("SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) + 1e-7, 4) AS result FROM events")
def streaming_running_sum(spark, sf):
    at = _folder(spark)
    rows = live_events(spark, sf).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "ms", "value")
    out = stateful.run(rows, stateful.RunningSum())
    seen = []
    out.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(lambda df, n: (df.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), seen.append(n))).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out/batch=*").select("key", "seq", r4("result").alias("result"))
