"""Per-period aggregates over a stream, corrected by retractions as late records arrive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import floor_to
from tidemark.operators.revisions import Lateness


def stream_changelog(records: DataFrame, key: str, event_us: str, arrival_us: str, measure: str, rule: Lateness, disorder: str = "1 hour") -> DataFrame:
    """The changelog of counts and sums of the integer ``measure`` per ``key`` and period.

    State per key and period is its version, count and sum. Each micro-batch that
    brings records of a period retracts the stated value (weight -1) and asserts the
    new one (weight +1) under the next version. Whether a record is too late is decided by
    its period and the cut-off alone. The watermark runs on arrival, ``disorder`` behind the newest one, which must
    cover how far files come out of the order of arrival; once it has passed the cut-off
    no record can count any more, and the state goes.
    """
    period = floor_to(F.col(event_us), rule.period_us)
    present = F.col(key).isNotNull() & F.col(event_us).isNotNull() & F.col(arrival_us).isNotNull()
    rows = records.filter(present).select(
        F.col(key).alias("key"), period.alias("period_us"), F.col(arrival_us).alias("arrival_us"), F.coalesce(F.col(measure), F.lit(0)).cast("long").alias("value"), F.timestamp_micros(arrival_us).alias("arrival")
    )
    rows = rows.filter(F.col("arrival_us") < F.col("period_us") + rule.period_us + rule.cutoff_us)
    timed = rows.withWatermark("arrival", disorder)
    end_us = rule.period_us + rule.cutoff_us

    def step(group, frames, state):
        name, start = group[0], int(group[1])
        if state.hasTimedOut:
            state.remove()
            return
        version, n, total = state.get if state.exists else (0, 0, 0)
        values = pd.concat([f["value"] for f in frames])
        old = (n, total)
        n, total = n + len(values), total + int(values.sum())
        out = [(name, start, version + 1, 1, n, total)]
        if version:
            out.insert(0, (name, start, version + 1, -1, *old))
        state.update((version + 1, n, total))
        state.setTimeoutTimestamp(max((start + end_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "period_us", "version", "weight", "n", "total"])

    kind = dict(records.dtypes)[key]
    return timed.groupBy("key", "period_us").applyInPandasWithState(
        step, f"key {kind}, period_us long, version long, weight int, n long, total long", "version long, n long, total long", "append", "EventTimeTimeout"
    )
