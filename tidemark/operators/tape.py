"""Digests of trades and quotes per time bucket, and the pulse of a list of symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import floor_to


def _valid_quotes(quotes: DataFrame) -> DataFrame:
    return quotes.filter((F.col("bid_price") > 0) & (F.col("ask_price") > 0))


def spread_bps() -> Column:
    return F.avg((F.col("ask_price") - F.col("bid_price")) * 20000.0 / F.nullif(F.col("ask_price") + F.col("bid_price"), F.lit(0.0)))


def tape_stats(trades: DataFrame, bucket_us: int, block_size: int = 1000) -> DataFrame:
    """Per symbol and bucket: trades, volume, average price, ticks up and down, blocks, low and high.

    The tick rule compares a trade with the one before it by (ts_us, ingest_seq). So
    that a hot symbol is not one task, trades are compared within their bucket, and
    the last price before each bucket is brought in from one row per bucket.
    """
    bucket = floor_to(F.col("ts_us"), bucket_us)
    rows = trades.select("symbol", bucket.alias("bucket_us"), "ts_us", "ingest_seq", "price", "size")
    at = F.struct("ts_us", "ingest_seq")
    lasts = rows.groupBy("symbol", "bucket_us").agg(F.max_by("price", at).alias("_last"))
    carried = lasts.select("symbol", "bucket_us", F.lag("_last").over(Window.partitionBy("symbol").orderBy("bucket_us")).alias("_carried"))
    within = Window.partitionBy("symbol", "bucket_us").orderBy("ts_us", "ingest_seq")
    seen = rows.withColumn("_before", F.lag("price").over(within)).withColumn("_first", F.row_number().over(within) == 1)
    seen = seen.join(carried, ["symbol", "bucket_us"])
    before = F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before"))
    return seen.withColumn("_prev", before).groupBy("symbol", "bucket_us").agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("size").alias("volume"),
        (F.sum(F.col("price") * F.col("size")) / F.nullif(F.sum("size"), F.lit(0))).alias("vwap"),
        F.count_if(F.col("price") > F.col("_prev")).alias("upticks"),
        F.count_if(F.col("price") < F.col("_prev")).alias("downticks"),
        F.count_if(F.col("size") >= block_size).alias("block_trades"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
    )


def quote_stats(quotes: DataFrame, bucket_us: int) -> DataFrame:
    """Per symbol and bucket: quotes, average spread in basis points, average share of the bid in the size offered."""
    bid = F.col("bid_size").cast("double")
    return _valid_quotes(quotes).groupBy("symbol", floor_to(F.col("ts_us"), bucket_us).alias("bucket_us")).agg(
        F.count(F.lit(1)).alias("quotes"),
        spread_bps().alias("spread_bps"),
        F.avg(bid / F.nullif(F.col("bid_size") + F.col("ask_size"), F.lit(0))).alias("bid_fraction"),
    )


def tape_with_quotes(tape: DataFrame, quotes: DataFrame) -> DataFrame:
    """Both digests side by side; a missing side has zero counts and null values."""
    both = tape.join(quotes, ["symbol", "bucket_us"], "full_outer")
    counts = ["trades", "upticks", "downticks", "block_trades", "quotes"]
    return both.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts} | {"volume": F.when(F.col("trades").isNull(), F.lit(0).cast("long")).otherwise(F.col("volume"))})


def pulse(trades: DataFrame, quotes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row for each symbol of ``wanted``: activity, range, first and last price, spread; zero rows for silent ones."""
    at = F.struct("ts_us", "ingest_seq")
    active = trades.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum("size").alias("volume"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.min_by("price", at).alias("first_price"),
        F.max_by("price", at).alias("last_price"),
    )
    spreads = _valid_quotes(quotes).groupBy("symbol").agg(spread_bps().alias("spread_bps"))
    out = wanted.join(active, "symbol", "left").join(spreads, "symbol", "left")
    zero = F.lit(0).cast("long")
    out = out.withColumn("volume", F.when(F.col("trades").isNull(), zero).otherwise(F.col("volume")))
    change = (F.col("last_price") - F.col("first_price")) / F.nullif(F.col("first_price"), F.lit(0.0)) * 100.0
    return out.withColumn("trades", F.coalesce("trades", zero)).withColumn("chg_pct", change)


def latest(rows: DataFrame, key: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The newest row per key, of equal times the last arrival; one aggregate, combined before the shuffle."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*key, "_v.*")


def thin(quotes: DataFrame, bucket_us: int) -> DataFrame:
    """The last arrival of each symbol and time bucket."""
    bucket = floor_to(F.col("ts_us"), bucket_us)
    values = [c for c in quotes.columns if c not in ("symbol", "ingest_seq")]
    return latest(quotes.withColumn("bucket_us", bucket), ["symbol", "bucket_us"], ["ingest_seq"], [*values, "ingest_seq"])


def halted(statuses: DataFrame) -> DataFrame:
    """Symbols whose newest status is a halt; of equal times the later event counts."""
    newest = statuses.groupBy("symbol").agg(F.max_by("status_code", F.struct("ts_us", "event_id")).alias("status_code"))
    return newest.filter(F.col("status_code") == "H").select("symbol")
