"""Price and volume triggers over minute bars, and the leading-edge suppression of repeats."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sessions import exchange_day


@dataclass(frozen=True)
class TriggerRule:
    """Thresholds; the defaults are those of a minute feed."""

    move_pct: float = 3.0
    window_s: int = 300
    spike_ratio: float = 5.0
    spike_min: int = 10
    spike_span: int = 60
    break_min: int = 30
    #: with it, range breaks need that many bars inside the move window, as a feed does that keeps no others
    only_window: bool = False


def triggers(bars: DataFrame, rule: TriggerRule = TriggerRule()) -> DataFrame:
    """``symbol``, ``ts``, ``category``, ``value``, ``direction`` of every trigger; state starts anew each exchange day.

    ``bars`` are minute bars with a key (symbol, ts). Bars without close are passed
    over; a missing high or low is the close, a missing volume is 0. Windows are per
    symbol and exchange day, which bounds them by the minutes of a day.
    """
    day = bars.filter(F.col("close").isNotNull()).select(
        "symbol", "ts", exchange_day(F.col("ts")).alias("day"), "close",
        F.coalesce("high", "close").alias("high"), F.coalesce("low", "close").alias("low"),
        F.coalesce(F.col("volume").cast("double"), F.lit(0.0)).alias("volume"),
    )
    group = Window.partitionBy("symbol", "day").orderBy("ts")
    recent = group.rangeBetween(-rule.window_s, -1)
    span = group.rowsBetween(-rule.spike_span, -1)
    before = group.rowsBetween(Window.unboundedPreceding, -1)
    seen = recent if rule.only_window else before
    state = day.select(
        "*",
        F.first("close").over(recent).alias("_ref"), F.first("ts").over(recent).alias("_ref_ts"),
        F.avg("volume").over(span).alias("_avg"), F.count(F.lit(1)).over(span).alias("_n"),
        F.max("high").over(before).alias("_hi"), F.min("low").over(before).alias("_lo"), F.count(F.lit(1)).over(seen).alias("_bars"),
    )
    pct = (F.col("close") - F.col("_ref")) / F.nullif(F.col("_ref"), F.lit(0.0)) * 100.0
    moved = (F.col("ts") - F.col("_ref_ts") >= rule.window_s * 0.6) & (F.abs(pct) >= rule.move_pct)
    spiked = (F.col("_n") >= rule.spike_min) & (F.col("_avg") > 0) & (F.col("volume") > 0) & (F.col("volume") >= F.col("_avg") * rule.spike_ratio)
    over = (F.col("_bars") >= rule.break_min) & (F.col("close") > F.col("_hi"))
    under = (F.col("_bars") >= rule.break_min) & (F.col("close") < F.col("_lo"))
    one = lambda test, category, value, direction: F.when(test, F.struct(F.lit(category).alias("category"), value.alias("value"), direction.alias("direction")))
    found = F.array(
        one(F.lit(rule.move_pct > 0) & moved, "price_move", pct, F.when(pct > 0, "bullish").otherwise("bearish")),
        one(F.lit(rule.spike_ratio > 0) & spiked, "volume_spike", F.col("volume") / F.nullif(F.col("_avg"), F.lit(0.0)), F.lit("neutral")),
        one(over, "day_range_break", F.col("_hi"), F.lit("bullish")),
        one(under, "day_range_break", F.col("_lo"), F.lit("bearish")),
    )
    out = state.select("symbol", "ts", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("_t"))
    return out.select("symbol", "ts", "_t.*")


def leading_edge(alerts: DataFrame, key: list[str], time: str, window: int) -> DataFrame:
    """Alerts kept when repeats of a key within less than ``window`` after a kept one are suppressed; suppressed ones extend nothing.

    Each key is folded in order of ``time`` (an integer) as its rows stream by; only the time last
    kept is held. Of rows of equal key and time one is kept. Rows with a null time are left out.
    """
    ordered = alerts.filter(F.col(time).isNotNull()).repartition(*key).sortWithinPartitions(*key, time)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for batch in batches:
            keep = []
            keys = zip(*(batch.column(k).to_pylist() for k in key), strict=True)
            for k, t in zip(keys, batch.column(time).to_pylist(), strict=True):
                fresh = k != at or t - last >= window
                if fresh:
                    at, last = k, t
                keep.append(fresh)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(kernel, alerts.schema)


class Quota:
    """A sliding quota for each of an event's symbols; an event passes if any symbol is below it, and only those pay."""

    def __init__(self, limit: int, span: int) -> None:
        self.limit, self.span = limit, span
        self.paid: dict[str, deque[int]] = {}

    def admit(self, symbols: list[str] | None, time: int) -> list[str] | None:
        """The symbols that pay, or None if the event is over quota. Times must not decrease."""
        below = []
        for s in sorted(set(symbols or [""])):
            times = self.paid.setdefault(s, deque())
            while times and time - times[0] > self.span:
                times.popleft()
            if len(times) < self.limit:
                below.append(s)
        for s in below:
            self.paid[s].append(time)
        return below or None


def within_quota(alerts: DataFrame, time: str, limit: int = 10, span: int = 3600) -> DataFrame:
    """Alerts (``category``, ``severity``, ``symbols``) that pass the hourly quota of their symbols; critical ones always do and pay nothing.

    The decisions of a category depend on each other through shared symbols, so each
    category is folded in order as its rows stream by; held are the times of the last hour.
    """
    ordered = alerts.filter(F.col(time).isNotNull()).repartition("category").sortWithinPartitions("category", time)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, quota = None, Quota(limit, span)
        for batch in batches:
            keep = []
            columns = (batch.column(c).to_pylist() for c in ("category", "severity", "symbols", time))
            for category, severity, symbols, t in zip(*columns, strict=True):
                if category != at:
                    at, quota = category, Quota(limit, span)
                keep.append(severity == "critical" or quota.admit(symbols, t) is not None)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return ordered.mapInArrow(kernel, alerts.schema)
