"""Streams that keep aggregates right for late rows: each micro-batch adds partial aggregates, readers merge them.

A batch writes to a folder of its own number and overwrites it when it is run again,
so each row counts once. Nothing is dropped for being late, and no state is held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import floor_to
from tidemark.streaming.feeds import drain

_AT = ("ts_us", "ingest_seq")


def _bar_parts(trades: DataFrame, seconds: int) -> DataFrame:
    bucket = floor_to(F.expr("ts_us div 1000000"), seconds)
    last = F.struct(*_AT, "price")
    return trades.filter(F.col("price").isNotNull()).groupBy("symbol", bucket.alias("ts")).agg(
        F.min(last).alias("first"), F.max(last).alias("last"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"),
    )


def bars(trades: DataFrame, seconds: int, home: str) -> DataFrame:
    """Bars of a stream of trades, as after everything that has arrived."""

    def write(batch: DataFrame, number: int) -> None:
        _bar_parts(batch, seconds).write.mode("overwrite").parquet(f"{home}/parts/batch={number}")

    drain(trades, write, home)
    parts = trades.sparkSession.read.parquet(f"{home}/parts")
    return parts.groupBy("symbol", "ts").agg(
        F.min("first").getField("price").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").getField("price").alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0).cast("long")).alias("volume"), F.sum("trade_count").alias("trade_count"),
    )


def latest(rows: DataFrame, key: list[str], values: list[str], home: str) -> DataFrame:
    """The newest row per key of a stream, of equal times the last arrival; older rows that come late change nothing."""
    best = F.max(F.struct(*_AT, *values)).alias("_v")

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*key).agg(best).write.mode("overwrite").parquet(f"{home}/parts/batch={number}")

    drain(rows, write, home)
    parts = rows.sparkSession.read.parquet(f"{home}/parts")
    return parts.groupBy(*key).agg(F.max("_v").alias("_v")).select(*key, "_v.*")


def last_per_bucket(quotes: DataFrame, bucket_us: int, values: list[str], home: str) -> DataFrame:
    """The last quote to arrive in each symbol and bucket of event time, however a stream is cut into batches.

    A batch keeps one quote of a bucket; a later batch that brings one more of it takes its place.
    """
    best = F.max(F.struct("ingest_seq", "ts_us", *values)).alias("_v")
    bucket = floor_to(F.col("ts_us"), bucket_us).alias("bucket_us")

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("symbol", bucket).agg(best).write.mode("overwrite").parquet(f"{home}/parts/batch={number}")

    drain(quotes, write, home)
    parts = quotes.sparkSession.read.parquet(f"{home}/parts")
    return parts.groupBy("symbol", "bucket_us").agg(F.max("_v").alias("_v")).select("symbol", "bucket_us", "_v.*")
