"""Control and statistics operators: anomaly levels, arrival rates, controllers, adaptive windows.

Linear recurrences run as windows. The two controllers that branch on their own state fold a series of samples in order; feed them pre-aggregated samples
(one a second, say), not raw rows.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import statistics as st
from .ordered import framed, numbered

HOUR = 3_600_000
DAY = 24 * HOUR
FRAME = 1 << 16  # rows of a block in which frames are computed
UNITS, EXACT = 1e4, float(1 << 53)  # fractions of one that sums count in; whole doubles under EXACT add up without rounding


def framed_by_key(df: DataFrame, keys: list[str], order: list[str], rows: int, compute, block: int = FRAME) -> DataFrame:
    """compute(df, partition columns), which may look `rows` rows of the key back by the column _n (numbered from 0), in blocks: neither a hot key nor a long history is one task."""
    df = numbered(df, order, "_n", keys=keys).withColumn("_n", F.col("_n") - 1)
    return framed(df, "_n", rows, compute, block, keys).drop("_n")


def _frame_stats(x: str, rows: int):
    """Adds mean, std (population), low, high, n and oldest of the last `rows` rows, in time linear in the rows.

    Sums are differences of running sums; extremes are those of two halves: from the frame's first row to the end of its stretch of `rows` rows, and from the
    beginning of the own stretch to the row.
    """

    def compute(df: DataFrame, part: list[str]) -> DataFrame:
        v = F.col(x).cast("double")
        line = Window.partitionBy(*part).orderBy("_n")
        far = line.rowsBetween(Window.unboundedPreceding, 0)
        zero = F.lit(0.0)
        df = df.withColumns({"_s": F.sum(F.coalesce(v, zero)).over(far), "_ss": F.sum(F.coalesce(v * v, zero)).over(far), "_c": F.count(x).over(far), "_f": F.floor(F.col("_n") / rows)})
        stretch = Window.partitionBy(*part, "_f")
        up, down = stretch.orderBy("_n").rowsBetween(Window.unboundedPreceding, 0), stretch.orderBy(F.col("_n").desc()).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({"_lo": F.min(x).over(up), "_hi": F.max(x).over(up)})
        df = df.withColumns({"_lo2": F.min(x).over(down), "_hi2": F.max(x).over(down)})
        less = lambda c: F.col(c) - F.coalesce(F.lag(c, rows).over(line), F.lit(0))
        df = df.withColumns({"_a": less("_s"), "_b": less("_ss"), "n": less("_c"), "_l": F.lag("_lo2", rows - 1).over(line), "_h": F.lag("_hi2", rows - 1).over(line), "_o": F.lag(x, rows - 1).over(line), "_first": F.first(x).over(far)})
        mean = F.when(F.col("n") > 0, F.col("_a") / F.col("n"))
        df = df.withColumns({"mean": mean, "std": F.sqrt(F.greatest(zero, F.col("_b") / F.col("n") - mean * mean)), "low": F.least("_lo", "_l"), "high": F.greatest("_hi", "_h"), "oldest": F.when(F.col("_n") < rows - 1, F.col("_first")).otherwise(F.col("_o"))})
        return df.drop("_s", "_ss", "_c", "_f", "_lo", "_hi", "_lo2", "_hi2", "_a", "_b", "_l", "_h", "_o", "_first")

    return compute


def sliding_stats(df: DataFrame, keys: list[str], order: list[str], x: str, rows: int = 1000, block: int = FRAME) -> DataFrame:
    """df with mean, std (population), low, high, n and oldest of the last rows of the key, this one included; nulls count for none but n's rows."""
    return framed_by_key(df, keys, order, rows, _frame_stats(x, rows), block)


def seasonal_mean(df: DataFrame, keys: list[str], ms: str, x: str, into: str, season: int = HOUR, reach: int = 60_000, keep: int = DAY) -> DataFrame:
    """df with the mean of x over the key's rows whose time is less than reach away from one season before this row's, and not more than keep before it; null without any.

    Times are cut into blocks of six seasons, each with what it needs of the one before. Values are summed as whole units and what is left of them, so the mean of
    values with up to four decimals is rounded once: neither the order of the rows nor copies of them change it.
    """
    back, long = min(season + reach - 1, keep), 6 * (season + reach)
    own = F.floor(F.col(ms) / long)
    places = F.when(F.pmod(F.col(ms), F.lit(long)) >= long - back, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(places))
    around = Window.partitionBy(*keys, "_block").orderBy(ms).rangeBetween(-back, -season + reach - 1)
    v = F.col(x).cast("double")
    spread = spread.withColumn("_u", F.when(F.abs(v) < EXACT / UNITS, F.rint(v * UNITS)).otherwise(F.lit(0.0)))
    spread = spread.withColumn("_r", v - F.col("_u") / UNITS)
    n = F.count(x).over(around)
    mean = F.when(n > 0, F.sum("_u").over(around) / (n * UNITS) + F.avg("_r").over(around))
    return spread.withColumn(into, mean).where("_block = _own").drop("_block", "_own", "_u", "_r")


def anomalies(df: DataFrame, keys: list[str], order: list[str], ms: str, x: str, s: st.Sensitivity = st.DEFAULT, rows: int = 1000, keep: int = DAY, block: int = FRAME) -> DataFrame:
    """df with z, change, seasonal, points and level of each value against its key's last rows and what came an hour ago; history older than keep counts for nothing there."""
    out = seasonal_mean(sliding_stats(df, keys, order, x, rows, block), keys, ms, x, "_season", keep=keep)
    v = F.col(x)
    out = out.withColumns({"z": st.z_score(v, F.col("mean"), F.col("std")), "change": st.change_rate(v, F.col("oldest")), "seasonal": st.seasonal_deviation(v, F.col("_season"))})
    out = out.withColumn("points", st.score(F.col("z"), F.col("change"), F.col("seasonal"), s)).drop("_season", "mean", "std", "low", "high", "n", "oldest")
    return out.withColumn("level", st.level(F.col("points")))


def retained(df: DataFrame, keys: list[str], ms: str, keep: int = DAY) -> DataFrame:
    """The rows that are not more than keep ms older than their key's latest."""
    newest = df.groupBy(*keys).agg(F.max(ms).alias("_newest"))
    own = newest.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_newest")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(own, same).where(F.col(ms) >= F.col("_newest") - keep).select(*df.columns)


def arrival_rate(df: DataFrame, keys: list[str], ms: str, bucket: int = 1000) -> DataFrame:
    """Rows a second in each time bucket that has any."""
    at = (F.col(ms) - F.pmod(F.col(ms), F.lit(bucket))).alias("bucket_start")
    return df.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("cnt")).withColumn("rate", F.col("cnt") * 1000.0 / bucket)


def ewma(df: DataFrame, keys: list[str], order: list[str], x: Column, into: str, alpha: float = 0.3, block: int = 512) -> DataFrame:
    """df with y = alpha * x + (1 - alpha) * previous y, from 0, per key; rows with a null x keep what was.

    The recurrence is linear: within blocks of rows it is a weighted running sum, and a block takes only the value its predecessor ended with, since
    (1 - alpha) ** block is below the precision of a double.
    """
    keep = 1 - alpha
    key = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_x", x).withColumn("_i", F.sum(F.col("_x").isNotNull().cast("long")).over(key.rowsBetween(Window.unboundedPreceding, 0)))
    at, place = F.floor((F.col("_i") - 1) / block), F.pmod(F.col("_i") - 1, F.lit(block))
    df = df.withColumn("_b", at).withColumn("_p", place)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = F.sum(F.coalesce(alpha * F.col("_x") * F.pow(F.lit(1 / keep), F.col("_p")), F.lit(0.0))).over(inside) * F.pow(F.lit(keep), F.col("_p"))
    df = df.withColumn("_y", local)
    ends = df.where(F.col("_x").isNotNull()).groupBy(*keys, "_b").agg(F.max_by("_y", "_p").alias("_end")).withColumn("_b", F.col("_b") + 1)
    same = ends.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_b2"), "_end")
    cond = F.col("_b") == F.col("_b2")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = df.join(same, cond, "left").withColumn(into, F.when(F.col("_i") == 0, F.lit(0.0)).otherwise(F.col("_y") + F.coalesce(F.col("_end"), F.lit(0.0)) * F.pow(F.lit(keep), F.col("_p") + 1)))
    return out.drop("_x", "_i", "_b", "_p", "_y", "_end", "_b2", *[f"_k_{k}" for k in keys])


def ewma_rate(df: DataFrame, keys: list[str], order: list[str], ms: str, into: str = "ewma") -> DataFrame:
    """Smoothed arrival rate: 1000 over the gap to the key's previous row (1 ms at least), the first row of a key being skipped."""
    gap = F.col(ms) - F.lag(ms).over(Window.partitionBy(*keys).orderBy(*order))
    df = df.withColumn("_gap", gap)
    return ewma(df, keys, order, F.when(F.col("_gap").isNotNull(), 1000.0 / F.greatest(F.col("_gap"), F.lit(1))), into).drop("_gap")


def pid(df: DataFrame, keys: list[str], order: list[str], error: Column, into: str, kp: float = 0.3, ki: float = 0.05, kd: float = 0.02) -> DataFrame:
    """df with kp * e + ki * (sum of errors so far) + kd * (e - previous e, 0 at first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_e", error)
    out = kp * F.col("_e") + ki * F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)) + kd * (F.col("_e") - F.coalesce(F.lag("_e").over(w), F.lit(0.0)))
    return df.withColumn(into, out).drop("_e")


def latency_percentiles(df: DataFrame, keys: list[str], order: list[str], latency: str, rows: int = 1000, block: int = FRAME) -> DataFrame:
    """df with median, p95 and p99 of the key's last latencies: element int(n * share) of the sorted ones."""

    def compute(part: DataFrame, by: list[str]) -> DataFrame:
        frame = Window.partitionBy(*by).orderBy("_n").rowsBetween(1 - rows, 0)
        part = part.withColumn("_seen", F.array_sort(F.collect_list(latency).over(frame)))
        return part.withColumns({n: st.percentile_of(F.col("_seen"), p) for n, p in (("median", 0.5), ("p95", 0.95), ("p99", 0.99))}).drop("_seen")

    return framed_by_key(df, keys, order, rows, compute, block)


@dataclass
class Pid:
    """A controller with state, for the sequential folds."""

    kp: float = 0.3
    ki: float = 0.05
    kd: float = 0.02
    clamp: float | None = None
    total: float = field(default=0.0, init=False)
    last: float = field(default=0.0, init=False)

    def step(self, error: float) -> float:
        self.total += error
        if self.clamp is not None:
            self.total = max(-self.clamp, min(self.clamp, self.total))
        out = self.kp * error + self.ki * self.total + self.kd * (error - self.last)
        self.last = error
        return out

    def reset(self) -> None:
        self.total = self.last = 0.0


UNLIMITED = float(2**31 - 1)


def rate_limits(samples: list[tuple[float, float]], target: int = 500, top: int = 100_000, bottom: int = 1000) -> list[tuple[float, str]]:
    """(rate limit, severity) after each (rate, latency) sample; unlimited and NORMAL before the first.

    The mean latency is that of all samples so far, in whole milliseconds; while it is 0 nothing changes. The limit moves a tenth of the way to what would meet the
    target, steered by a controller that starts anew when the error turns positive; below one row a second the latency alone decides and the
    controller rests. Limits are whole numbers within their bounds, and begin at the top.
    """
    control, limit, level, total, was, out = Pid(clamp=30.0), None, "NORMAL", 0, 0.0, []
    for seen, (rate, latency) in enumerate(samples, 1):
        total += int(latency)
        average = total // seen
        if average > 0:
            error = (target - average) / target
            if was <= 0 < error:
                control.reset()
            was = error
            wanted = int(top * (target / average)) if rate < 1 else int(rate * target / average * (1 + control.step(error)))
            now = top if limit is None else limit
            limit = max(bottom, min(top, int(now + 0.1 * (wanted - now))))
            level = "NORMAL" if error > -0.1 else "MEDIUM" if error > -0.3 else "HIGH" if error > -0.6 else "CRITICAL"
        out.append((UNLIMITED if limit is None else float(limit), level))
    return out


def window_sizes(samples: list[tuple[int, float, float]], start: int = 5000, every: int = 10_000, low: int = 1000, high: int = 300_000, keep: int = 1000, target: int = 2000) -> list[tuple[float, float]]:
    """(window size, allowed disorder) in whole ms after each (ms, rate, latency) sample, from the last `keep` latencies.

    Looked at at the first sample and then when more than `every` ms have passed: a tenth of the way to the optimal size (statistics.optimal_window, with a
    controller that remembers); both change only if that moves the size by over a tenth.
    """
    control, size, disorder, looked, recent_, out = Pid(), start, 5000, None, deque(maxlen=keep), []
    for ms, rate, latency in samples:
        recent_.append(int(latency))
        if looked is None or ms - looked > every:
            looked, s = ms, sorted(recent_)
            n = len(s)
            median, p95, p99 = s[n // 2], s[int(n * 0.95)], s[int(n * 0.99)]
            best = int(target * rate / 1000 * (1 + control.step((target - median) / target)))
            tail = p99 / max(median, 1)
            if tail > 3:
                best = int(best * (1 + min((tail - 3) * 0.1, 0.3)))
            new = max(low, min(high, int(size + 0.1 * (best - size))))
            if abs(new - size) > size * 0.1:
                size, disorder = new, max(100, min(60_000, int(p95 * 1.2)))
        out.append((float(size), float(disorder)))
    return out


def adaptive_starts(ms: Column, size: Column) -> Column:
    """The start of the window of a row's time, by the size that holds for it: tumbling windows of a changing size."""
    return ms - F.pmod(ms, size)


def folded(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], fold, outputs: str) -> DataFrame:
    """df with the outputs of a sequential fold over each key's rows in order (fold: list of input tuples to list of output tuples)."""
    names = [p.split()[0] for p in outputs.split(",")]
    kinds = [{"double": pa.float64(), "string": pa.string()}[p.split()[1]] for p in outputs.split(",")]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        got = fold(list(zip(*[table[c].to_pylist() for c in inputs], strict=True)))
        for i, (name, kind) in enumerate(zip(names, kinds, strict=True)):
            table = table.append_column(name, pa.array([g[i] for g in got], kind))
        return table

    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(outputs).fields])
    return df.groupBy(*keys).applyInArrow(run, schema)
