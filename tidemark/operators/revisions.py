"""Per-period aggregates by event time, corrected by retractions while late records arrive.

Records are first reduced to one delta for each key, period and version, a
version being one tick of arrival time after the period's end (version 0 holds
all that arrived before the end). A running sum over the versions of a period is
its versioned state; each step to a next version retracts the old value with
weight -1 and asserts the new one with weight +1. Whatever consumes the changelog
only adds weighted values, so a coarser level stays right without reading the
records again.

Nulls: records without key, event time or arrival are left out. A null measure
counts as 0 in sums. An empty input gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import floor_to


@dataclass(frozen=True)
class Lateness:
    """Period length, cut-off for late arrivals and arrival tick, in microseconds."""

    period_us: int
    cutoff_us: int
    tick_us: int = 60_000_000
    measures: dict[str, Column] = field(default_factory=dict, hash=False)


def version_deltas(records: DataFrame, keys: list[str], event_us: str, arrival_us: str, rule: Lateness) -> DataFrame:
    """One row per key, period and version: ``n`` records and the sum of each measure.

    Arrivals at or after end plus cut-off are left out. Early arrivals (before
    the period itself) are on time. There are at most cutoff / tick + 1 rows for
    a period, so later windows over a period are bounded however many records it has.
    """
    start = floor_to(F.col(event_us), rule.period_us)
    present = F.col(event_us).isNotNull() & F.col(arrival_us).isNotNull()
    for k in keys:
        present = present & F.col(k).isNotNull()
    rows = records.filter(present).select(
        *keys,
        start.alias("period_us"),
        (F.col(arrival_us) - (start + rule.period_us)).alias("_late"),
        *(m.alias(name) for name, m in rule.measures.items()),
    )
    rows = rows.filter(F.col("_late") < rule.cutoff_us)
    version = F.when(F.col("_late") < 0, F.lit(0).cast("long")).otherwise(F.expr(f"_late div {rule.tick_us}") + 1)
    sums = [F.sum(F.coalesce(F.col(name), F.lit(0))).alias(name) for name in rule.measures]
    return rows.groupBy(*keys, "period_us", version.alias("version")).agg(F.count(F.lit(1)).alias("n"), *sums)


def changelog(deltas: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Retractions and assertions: for each version, the old value with ``weight`` -1 (if any) and the new with +1."""
    values = ["n", *measures]
    upto = Window.partitionBy(*keys, "period_us").orderBy("version")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    stated = deltas.select(
        *keys, "period_us", "version",
        F.row_number().over(upto).alias("_k"),
        F.struct(*(F.sum(v).over(upto).alias(v) for v in values)).alias("_new"),
        F.struct(*(F.sum(v).over(before).alias(v) for v in values)).alias("_old"),
    )
    steps = F.array(
        F.struct(F.lit(-1).alias("weight"), F.col("_old").alias("value")),
        F.struct(F.lit(1).alias("weight"), F.col("_new").alias("value")),
    )
    emitted = stated.select(*keys, "period_us", "version", "_k", F.explode(steps).alias("_s"))
    emitted = emitted.filter((F.col("_s.weight") == 1) | (F.col("_k") > 1))
    return emitted.select(*keys, "period_us", "version", F.col("_s.weight").alias("weight"), *(F.col(f"_s.value.{v}").alias(v) for v in values))


def settle(log: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """The state after all of a changelog: weighted sums; groups retracted to nothing drop out."""
    sums = [F.sum(F.col("weight") * F.col(v)).alias(v) for v in ["n", *measures]]
    return log.groupBy(*keys).agg(*sums, F.max("version").alias("version")).filter(F.col("n") != 0)


def roll_up(log: DataFrame, keys: list[str], measures: list[str], coarse_us: int) -> DataFrame:
    """A coarser level fed by the changelog alone: totals per key and ``coarse_us``."""
    coarse = log.withColumn("period_us", floor_to(F.col("period_us"), coarse_us))
    return settle(coarse, [*keys, "period_us"], measures)


def revised_periods(log: DataFrame, keys: list[str], measures: list[str] = ()) -> DataFrame:
    """Periods whose result changed, or first came about, after their end: those whose settled state has a later version than 0."""
    return settle(log, [*keys, "period_us"], list(measures)).filter("version > 0").select(*keys, "period_us")
