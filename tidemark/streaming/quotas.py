"""Suppression of alerts over a stream: repeats of a key, and hourly quotas."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.triggers import Quota


def stream_leading_edge(alerts: DataFrame, key: str, time: str, window: int) -> DataFrame:
    """Alerts (``key``, ``time`` in seconds) without those within less than ``window`` after a kept one of the key; state is one time per key."""

    def step(group, frames, state):
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(set(pd.concat([f["at"] for f in frames]))):
            if last is None or t - last >= window:
                last = t
                kept.append(t)
        state.update((int(last),))
        state.setTimeoutTimestamp(max((int(last) + window) * 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": [group[0]] * len(kept), "at": kept})

    def guarded(group, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        yield from step(group, frames, state)

    rows = alerts.select(F.col(key).cast("string").alias("key"), F.col(time).cast("long").alias("at")).dropna()
    timed = rows.withColumn("event_time", F.timestamp_seconds("at")).withWatermark("event_time", f"{window} seconds")
    return timed.groupBy("key").applyInPandasWithState(guarded, "key string, at long", "last long", "append", "EventTimeTimeout")


def stream_within_quota(alerts: DataFrame, time: str, limit: int = 10, span: int = 3600) -> DataFrame:
    """Alerts (``alert_id``, ``category``, ``severity``, ``symbols``) within the quota of their symbols; per category one state holds the payments of the last ``span`` seconds."""

    def step(group, frames, state):
        quota = Quota(limit, span)
        if state.exists:
            for symbol, paid in zip(*state.get, strict=True):
                quota.paid.setdefault(symbol, deque()).append(paid)
        rows = pd.concat(list(frames)).sort_values(["at", "alert_id"])
        keep = [r.severity == "critical" or quota.admit(list(r.symbols) if r.symbols is not None else [], int(r.at)) is not None for r in rows.itertuples()]
        now = int(rows["at"].max())
        paid = [(s, t) for s, times in quota.paid.items() for t in times if now - t <= span]
        state.update(([s for s, _ in paid], [t for _, t in paid]))
        yield rows[keep][["alert_id", "category", "at"]]

    rows = alerts.select("alert_id", "category", "severity", "symbols", F.col(time).cast("long").alias("at"))
    return rows.groupBy("category").applyInPandasWithState(step, "alert_id string, category string, at long", "symbol array<string>, paid array<long>", "append", "NoTimeout")
