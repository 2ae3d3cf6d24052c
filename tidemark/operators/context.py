"""The market context of every symbol at one instant: price, indicators, volume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions.sessions import context_session, exchange_day, from_seconds


def smoothed_indicators(bars: DataFrame, group: list[str], period: int = 14, spans: tuple[int, ...] = (9, 21)) -> DataFrame:
    """``rsi_14``, ``atr_14`` and ``ema_...`` per group of bars; null where a group has too few.

    Groups are a symbol's bars of one session, so their size is bounded by its minutes.
    """
    order = Window.partitionBy(*group).orderBy("ts")
    closes = bars.filter(F.col("close").isNotNull())
    placed = closes.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    moved = placed.withColumn("_d", F.col("close") - F.lag("close").over(order))
    # the first bar has no change: changes count from the second bar on
    i, n = F.col("_i"), F.col("_n")
    alpha = 1.0 / period
    gain = ind.smoothed(F.greatest(F.col("_d"), F.lit(0.0)), i - 1, n - 1, period, alpha)
    loss = ind.smoothed(F.greatest(-F.col("_d"), F.lit(0.0)), i - 1, n - 1, period, alpha)
    moves = F.when(i > 1, F.lit(1))
    priced = moved.groupBy(*group).agg(
        F.count(moves).alias("_moves"),
        gain.alias("_gain"),
        loss.alias("_loss"),
        *(ind.smoothed(F.col("close"), i, n, s, 2.0 / (s + 1.0)).alias(f"ema_{s}") for s in spans),
    )
    priced = priced.withColumn(f"rsi_{period}", F.when(F.col("_moves") >= period, ind.rsi_of(F.col("_gain"), F.col("_loss"))))
    whole = bars.filter(F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull())
    ranged = whole.withColumn("_p", F.lag("close").over(order)).withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    true_range = F.when(F.col("_p").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_p")), F.abs(F.col("low") - F.col("_p"))))
    ranges = ranged.groupBy(*group).agg(ind.smoothed(true_range, i - 1, n - 1, period, alpha).alias(f"atr_{period}"))
    return priced.drop("_moves", "_gain", "_loss").join(ranges, group, "left")


def symbol_context(bars: DataFrame, halted: DataFrame, as_of: int, daily_limit: int = 15) -> DataFrame:
    """One row per symbol with minute bars in the session at ``as_of`` (epoch seconds)."""
    start, today = context_session(from_seconds(as_of))
    minutes = bars.filter((F.col("timeframe") == "1min") & (F.col("ts") >= start) & (F.col("ts") <= as_of))
    first_last = minutes.groupBy("symbol").agg(
        F.max_by("close", "ts").alias("last"),
        F.min_by("open", "ts").alias("today_open"),
        F.max("high").alias("day_high"),
        F.min("low").alias("day_low"),
        F.sum(F.coalesce("volume", F.lit(0))).cast("double").alias("_volume"),
        F.count(F.lit(1)).alias("minute_bars_used"),
        (
            F.sum(F.when(F.col("vwap").isNotNull() & (F.col("volume") != 0), F.col("vwap") * F.col("volume")))
            / F.nullif(F.sum(F.when(F.col("vwap").isNotNull(), F.col("volume"))), F.lit(0))
        ).alias("session_vwap"),
        F.sum(F.when(F.col("vwap").isNotNull(), F.col("volume"))).alias("_weighed"),
    )
    first_last = first_last.withColumn("session_vwap", F.when(F.col("_weighed") > 0, F.col("session_vwap")))
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))
    days = bars.filter((F.col("timeframe") == "1day") & (F.col("ts") <= as_of)).withColumn("_k", newest).filter(F.col("_k") <= daily_limit)
    prior = days.filter(exchange_day(F.col("ts")) < F.lit(today)).groupBy("symbol").agg(
        F.max_by("close", "ts").alias("prev_close"), F.avg(F.when(F.col("volume") != 0, F.col("volume"))).alias("_usual")
    )
    joined = first_last.join(prior, "symbol", "left").join(smoothed_indicators(minutes, ["symbol"]), "symbol", "left")
    joined = joined.join(halted.select("symbol", F.lit(True).alias("_halted")), "symbol", "left")
    last, vwap = F.col("last"), F.col("session_vwap")
    return joined.select(
        "symbol", "last", "prev_close",
        ind.pct_change(last, F.col("prev_close")).alias("change_pct"),
        ind.gap_pct(F.col("today_open"), F.col("prev_close")).alias("gap_pct"),
        "session_vwap",
        ind.pct_change(last, vwap).alias("vwap_distance_pct"),
        "rsi_14", "ema_9", "ema_21", "atr_14", "day_high", "day_low",
        ind.range_position(last, F.col("day_high"), F.col("day_low")).alias("range_position"),
        F.nullif(F.col("_volume"), F.lit(0.0)).alias("volume_today"),
        ind.relative_volume(F.col("_volume"), F.col("_usual"), F.col("minute_bars_used") / 390.0).alias("rel_volume"),
        "minute_bars_used",
        F.coalesce("_halted", F.lit(False)).alias("halted"),
    )
