"""Statistics for anomaly detection, rates and severities, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sensitivity:
    """Thresholds: standard deviations, change rate, seasonal deviation."""

    sigma: float = 3.0
    change: float = 0.5
    seasonal: float = 0.3


DEFAULT, SENSITIVE = Sensitivity(), Sensitivity(2.0, 0.3, 0.2)
LEVELS = ("NORMAL", "MEDIUM", "HIGH", "CRITICAL")


def z_score(x: Column, mean: Column, std: Column) -> Column:
    """Distance from the mean in standard deviations; 0 without spread."""
    return F.when(std > 1e-9, F.abs(x - mean) / std).otherwise(F.lit(0.0))


def change_rate(x: Column, old: Column) -> Column:
    """Relative change against an older value; from 0, the largest double for a positive value and 0 for others."""
    return F.when(old == 0, F.when(x > 0, F.lit(1.7976931348623157e308)).otherwise(F.lit(0.0))).otherwise((x - old) / old)


def seasonal_deviation(x: Column, mean: Column) -> Column:
    """Relative deviation from the mean of what came one season ago; 0 without history (a null mean)."""
    return F.when(mean.isNull(), F.lit(0.0)).when(mean == 0, F.when(x > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.abs(x - mean) / F.abs(mean))


def score(z: Column, change: Column, seasonal: Column, s: Sensitivity = DEFAULT) -> Column:
    return F.when(z > s.sigma, 1).otherwise(0) + F.when(F.abs(change) > s.change, 2).otherwise(0) + F.when(seasonal > s.seasonal, 1).otherwise(0)


def level(points: Column) -> Column:
    return F.when(points >= 3, LEVELS[3]).when(points == 2, LEVELS[2]).when(points == 1, LEVELS[1]).otherwise(LEVELS[0])


def latency_severity(error: Column) -> Column:
    """Severity of the relative latency error (target - average) / target."""
    return F.when(error > -0.1, LEVELS[0]).when(error > -0.3, LEVELS[1]).when(error > -0.6, LEVELS[2]).otherwise(LEVELS[3])


def queue_length(rate: Column, latency_ms: Column) -> Column:
    """Little's law."""
    return rate * latency_ms / 1000


def percentile_of(sorted_values: Column, share: float) -> Column:
    """Element int(n * share), counted from 0, of an ascending array; null when empty."""
    n = F.size(sorted_values)
    return F.get(sorted_values, F.least(F.floor(n * share), n - 1).cast("int"))


def optimal_window(rate: float, median: float, p99: float, target: float = 2000.0) -> float:
    """Window size in ms for a rate (rows a second) and latencies in ms: larger for high rates, low latencies and long tails."""
    error = (target - median) / target
    steer = 0.3 * error + 0.05 * error + 0.02 * error  # the first step of a controller: proportional, integral, derivative
    size = target * rate / 1000 * (1 + steer)
    tail = p99 / max(median, 1.0)
    return size * (1 + min((tail - 3) * 0.1, 0.3)) if tail > 3 else size


def optimal_window_column(rate: Column, median: Column, p99: Column, target: float = 2000.0) -> Column:
    """optimal_window() of columns."""
    size = target * rate / 1000 * (1 + 0.37 * (target - median) / target)
    tail = p99 / F.greatest(median, F.lit(1.0))
    return F.when(tail > 3, size * (1 + F.least((tail - 3) * 0.1, F.lit(0.3)))).otherwise(size)
