"""Indicators over a group's bars in order of time, as plain aggregates.

Smoothing recursions are written out: after the seed, the value before the last one
counts (1 - a) as much as the last, and so on. With the position of each value and
the number of values known, a smoothed value is a weighted sum, which Spark combines
like any sum; no array per group is built.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smoothed(value: Column, at: Column, count: Column, seed: int, alpha: float) -> Column:
    """The exponentially smoothed value of ``value`` (``at`` counts from 1 to ``count``), seeded by the mean of the first ``seed`` values; null if there are fewer."""
    seeds = F.sum(F.when(at <= seed, value)) / float(seed)
    later = F.sum(F.when(at > seed, value * F.pow(F.lit(1.0 - alpha), count - at)))
    n = F.max(count)
    return F.when(n >= seed, seeds * F.pow(F.lit(1.0 - alpha), n - seed) + alpha * F.coalesce(later, F.lit(0.0)))


def rsi_of(gain: Column, loss: Column) -> Column:
    """Relative strength index of the average gain and loss: 100 for gains only, 50 for no movement."""
    return F.when(loss == 0, F.when(gain > 0, 100.0).otherwise(50.0)).otherwise(100.0 - 100.0 / (1.0 + gain / F.nullif(loss, F.lit(0.0))))


def pct_change(last: Column, reference: Column) -> Column:
    """Change in percent; null without a reference other than 0."""
    return (last - reference) / F.nullif(reference, F.lit(0.0)) * 100.0


def gap_pct(opened: Column, previous: Column) -> Column:
    """Change from the previous close to the open in percent; null if either is missing or 0."""
    return F.when(opened != 0, pct_change(opened, previous))


def range_position(last: Column, high: Column, low: Column) -> Column:
    """0 at the low, 1 at the high; null without a range."""
    return F.when(high > low, (last - low) / (high - low))


def relative_volume(today: Column, usual: Column, fraction: Column) -> Column:
    """Volume against the usual day's volume up to the same part of the session."""
    part = F.least(F.greatest(fraction, F.lit(1.0 / 390.0)), F.lit(1.0))
    return F.when((today > 0) & (usual * part > 0), today / F.nullif(usual * part, F.lit(0.0)))
