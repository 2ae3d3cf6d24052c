"""Bars: from trades, to longer buckets, changed ones only.

Buckets are aligned to the epoch. Groups are (symbol, bucket), so a hot symbol is
spread over its buckets, and all aggregates are combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import floor_to

#: The timeframes that are stored, and those made from minute bars (seconds).
STORED_TIMEFRAMES = ("1min", "1day")
AGGREGATE_TIMEFRAMES = {"5min": 300, "15min": 900, "1hour": 3600}

BAR_VALUES = ["open", "high", "low", "close", "volume", "trade_count", "vwap"]


def bars_from_trades(trades: DataFrame, seconds: int) -> DataFrame:
    """OHLCV bars of ``seconds`` per symbol; ties of time go by ``ingest_seq``.

    Trades without price are left out; a null size counts as no volume.
    """
    at = F.struct("ts_us", "ingest_seq")
    priced = trades.filter(F.col("price").isNotNull())
    bucket = floor_to(F.expr("ts_us div 1000000"), seconds)
    sized = F.col("size").isNotNull()
    return priced.groupBy("symbol", bucket.alias("ts")).agg(
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.coalesce(F.sum("size"), F.lit(0).cast("long")).alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
        (F.sum(F.col("price") * F.col("size")) / F.nullif(F.sum(F.when(sized, F.col("size")).otherwise(0)), F.lit(0))).alias("vwap"),
    )


def rebucket(minute_bars: DataFrame, seconds: int) -> DataFrame:
    """Longer bars from minute bars. Open and close are those of the first and last bar, also if null;
    the average price weighs only bars that have one.
    """
    bucket = floor_to(F.col("ts"), seconds)
    weight = F.sum(F.when(F.col("vwap").isNotNull(), F.col("volume")).otherwise(0))
    return minute_bars.groupBy("symbol", bucket.alias("bucket_ts")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trade_count").alias("trade_count"),
        (F.sum(F.col("vwap") * F.col("volume")) / F.nullif(weight, F.lit(0))).alias("vwap"),
    ).withColumnRenamed("bucket_ts", "ts")


def rebucket_present(fetched: DataFrame, seconds: int) -> DataFrame:
    """Longer bars from fetched minute bars that passed no store: the close is the last one that is there, missing volumes and counts are 0."""
    bucket = floor_to(F.col("ts"), seconds)
    volume = F.coalesce("volume", F.lit(0))
    return fetched.groupBy("symbol", bucket.alias("bucket_ts")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("ts"))).alias("close"),
        F.sum(volume).alias("volume"),
        F.sum(F.coalesce("trade_count", F.lit(0))).alias("trade_count"),
        (F.sum(F.col("vwap") * volume) / F.nullif(F.sum(F.when(F.col("vwap").isNotNull(), volume).otherwise(0)), F.lit(0))).alias("vwap"),
    ).withColumnRenamed("bucket_ts", "ts")


def newest(rows: DataFrame, group: list[str], order: list, limit: int) -> DataFrame:
    """The ``limit`` rows of each group that come first by ``order``; Spark cuts groups before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank")


def changed_only(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming bars that are new or differ, nulls compared as values; of one key in a batch the last arrival counts."""
    key = ["symbol", "timeframe", "ts"]
    last = incoming.groupBy(*key).agg(F.max(F.struct("arrival", *BAR_VALUES)).alias("_b")).select(*key, *(F.col(f"_b.{c}").alias(c) for c in BAR_VALUES))
    old = stored.select(*key, F.struct(*BAR_VALUES).alias("_old"))
    both = last.join(old, key, "left")
    same = F.lit(True)
    for c in BAR_VALUES:
        same = same & F.col(c).eqNullSafe(F.col(f"_old.{c}"))
    return both.filter(F.col("_old").isNull() | ~same).drop("_old")


def upsert(stored: DataFrame, incoming: DataFrame, high_water: int) -> tuple[DataFrame, DataFrame]:
    """The bars after ``incoming`` and the written rows; only these get new numbers, above ``high_water``.

    Numbers are dense within the batch, so this belongs in a micro-batch of bounded size.
    """
    key = ["symbol", "timeframe", "ts"]
    changed = changed_only(stored, incoming)
    written = changed.withColumn("seq", F.row_number().over(Window.orderBy("ts", "symbol", "timeframe")) + F.lit(high_water))
    kept = stored.join(written.select(*key), key, "left_anti")
    return kept.select(*written.columns).unionByName(written), written
