"""The registered market queries over trades, quotes, bars and events, with their SQL.

"Now" is the newest instant of the table a query reads, so results depend on the data only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.api import Engine
from tidemark.functions.sessions import exchange_day, market_phase
from tidemark.functions.times import floor_to, instant_us
from tidemark.operators import bars as bar_ops
from tidemark.operators import context, tape, triggers
from tidemark.plans.problems import sql_instant_us
from tidemark.sources.tables import table

MINUTE_US = 60_000_000
TAPE_US = 10 * MINUTE_US
WINDOW_US = 240 * MINUTE_US
ROWS = 200


def newest_value(df: DataFrame, column: str) -> int:
    """The greatest value of a column, 0 for an empty table."""
    return df.agg(F.max(column).alias("m")).first()["m"] or 0


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stock_trades")


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stock_quotes")


def _minutes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "stock_bars").filter("timeframe = '1min'")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Six decimals, after a nudge that makes exact halves round alike in every engine."""
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    """Trading statuses: an error of a user is a halt, a signup a resumption."""
    events = table(spark, d, "events").filter(F.col("event_type").isin("error", "signup"))
    code = F.when(F.col("event_type") == "error", "H").otherwise("T")
    ts = instant_us(F.col("ts").cast("string"))
    return events.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), ts.alias("ts_us"), code.alias("status_code"), "event_id")


def bars_from_trades_1min(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bar_ops.bars_from_trades(_trades(spark, d), 60), "vwap")


def bars_5min(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bar_ops.rebucket(_minutes(spark, d), bar_ops.AGGREGATE_TIMEFRAMES["5min"]), "vwap")


def bars_15min(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bar_ops.rebucket(_minutes(spark, d), bar_ops.AGGREGATE_TIMEFRAMES["15min"]), "vwap")


def bars_1hour(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bar_ops.rebucket(_minutes(spark, d), bar_ops.AGGREGATE_TIMEFRAMES["1hour"]), "vwap")


def bars_window(spark: SparkSession, d: str) -> DataFrame:
    """The newest 390 minute bars of every symbol."""
    rows = _minutes(spark, d).select("symbol", "ts", *bar_ops.BAR_VALUES)
    return bar_ops.newest(rows, ["symbol"], [F.desc("ts")], 390)


def trades_window(spark: SparkSession, d: str) -> DataFrame:
    """The newest trades of every symbol in the last 240 minutes."""
    now = newest_value(_trades(spark, d), "ts_us")
    rows = _trades(spark, d).filter(F.col("ts_us") >= now - WINDOW_US).select("symbol", "ts_us", "price", "size", "exchange", "conditions", "tape", "ingest_seq")
    return bar_ops.newest(rows, ["symbol"], [F.desc("ts_us"), F.desc("ingest_seq")], ROWS)


def quotes_window(spark: SparkSession, d: str) -> DataFrame:
    """The newest quotes of every symbol in the last 240 minutes."""
    now = newest_value(_quotes(spark, d), "ts_us")
    rows = _quotes(spark, d).filter(F.col("ts_us") >= now - WINDOW_US).select("symbol", "ts_us", "bid_price", "bid_size", "ask_price", "ask_size", "tape", "ingest_seq")
    return bar_ops.newest(rows, ["symbol"], [F.desc("ts_us"), F.desc("ingest_seq")], ROWS)


def tape_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tape.tape_stats(_trades(spark, d), TAPE_US), "vwap")


def quote_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tape.quote_stats(_quotes(spark, d), TAPE_US), "spread_bps", "bid_fraction")


def tape_with_quotes(spark: SparkSession, d: str) -> DataFrame:
    both = tape.tape_with_quotes(tape.tape_stats(_trades(spark, d), TAPE_US), tape.quote_stats(_quotes(spark, d), TAPE_US))
    return rounded(both, "vwap", "spread_bps", "bid_fraction")


def watchlist_pulse(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol with bars, and one that is unknown, over the last 240 minutes of trades."""
    since = newest_value(_trades(spark, d), "ts_us") - WINDOW_US
    recent = F.col("ts_us") >= since
    wanted = table(spark, d, "stock_bars").select("symbol").distinct().unionAll(spark.range(1).select(F.lit("UNKNOWN").alias("symbol")))
    out = tape.pulse(_trades(spark, d).filter(recent), _quotes(spark, d).filter(recent), wanted)
    return rounded(out, "spread_bps", "chg_pct")


def session_indicators(spark: SparkSession, d: str) -> DataFrame:
    """RSI, moving averages and true range at the end of every symbol's exchange days."""
    rows = _minutes(spark, d).withColumn("day", exchange_day(F.col("ts")))
    return rounded(context.smoothed_indicators(rows, ["symbol", "day"]), "rsi_14", "ema_9", "ema_21", "atr_14")


def symbol_context(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "stock_bars")
    halted = tape.halted(_statuses(spark, d))
    out = context.symbol_context(rows, halted, newest_value(rows.filter("timeframe = '1min'"), "ts"))
    return rounded(out, *(c for c, t in out.dtypes if t == "double"))


def exchange_day_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Bars and volume per symbol and exchange day, whose border is not UTC midnight."""
    rows = _minutes(spark, d).withColumn("day", exchange_day(F.col("ts")))
    return rows.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("bars"), F.sum("volume").alias("volume"), F.max("high").alias("high"), F.min("low").alias("low"))


def phase_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Trades and size by market phase."""
    rows = _trades(spark, d).withColumn("phase", market_phase(F.expr("ts_us div 1000000")))
    return rows.groupBy("phase").agg(F.count(F.lit(1)).alias("trades"), F.sum("size").alias("volume"))


def event_phases(spark: SparkSession, d: str) -> DataFrame:
    """The phase of every event's instant."""
    seconds = F.expr("_us div 1000000")
    timed = table(spark, d, "events").withColumn("_us", instant_us(F.col("ts").cast("string")))
    return timed.select("event_id", market_phase(seconds).alias("phase"))


RULE = triggers.TriggerRule(move_pct=0.5, window_s=300, spike_ratio=3.0)


def bar_triggers(spark: SparkSession, d: str) -> DataFrame:
    """All price moves, volume spikes and range breaks of the minute bars."""
    return rounded(triggers.triggers(_minutes(spark, d), RULE), "value")


def market_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Triggers without repeats of a symbol and category within 300 seconds of a kept one."""
    found = triggers.triggers(_minutes(spark, d), RULE)
    return triggers.leading_edge(found.select("symbol", "category", "ts"), ["symbol", "category"], "ts", 300)


def halted_symbols(spark: SparkSession, d: str) -> DataFrame:
    return tape.halted(_statuses(spark, d))


def trading_halts(spark: SparkSession, d: str) -> DataFrame:
    """The newest 10 statuses of every symbol."""
    return bar_ops.newest(_statuses(spark, d), ["symbol"], [F.desc("ts_us"), F.desc("event_id")], 10)


def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The newest trade, quote and minute bar of every symbol, and its age in seconds at the newest instant of all."""
    trades = tape.latest(_trades(spark, d).filter("price IS NOT NULL"), ["symbol"], ["ts_us", "ingest_seq"], ["ts_us", "price", "size"])
    quotes = tape.latest(_quotes(spark, d), ["symbol"], ["ts_us", "ingest_seq"], ["ts_us", "bid_price", "ask_price"])
    bars = tape.latest(_minutes(spark, d), ["symbol"], ["ts"], ["ts", "close"])
    out = trades.withColumnRenamed("ts_us", "trade_us").join(quotes.withColumnRenamed("ts_us", "quote_us"), "symbol", "full_outer").join(bars.withColumnRenamed("ts", "bar_ts"), "symbol", "full_outer")
    now = max(newest_value(_trades(spark, d), "ts_us"), newest_value(_quotes(spark, d), "ts_us"))
    freshest = F.greatest("trade_us", "quote_us", F.col("bar_ts") * 1_000_000)
    age = F.greatest(F.lit(0.0), (F.lit(now) - freshest) / 1_000_000)
    return out.withColumn("age_s", F.round(age + 1e-9, 6)).withColumn("stale", F.coalesce(age > 120.0, F.lit(True)))


def quote_thinning(spark: SparkSession, d: str) -> DataFrame:
    """The last quote to arrive in every minute of a symbol."""
    return tape.thin(_quotes(spark, d).select("symbol", "ts_us", "bid_price", "ask_price", "ingest_seq"), MINUTE_US)


def bars_changed_only(spark: SparkSession, d: str) -> DataFrame:
    """What a second delivery of all bars writes when every fifth bar has a changed close."""
    stored = table(spark, d, "stock_bars").select("symbol", "timeframe", "ts", *bar_ops.BAR_VALUES, "seq")
    again = stored.withColumn("close", F.when(F.col("seq") % 5 == 0, F.col("close") + 1.0).otherwise(F.col("close"))).withColumn("arrival", F.col("seq"))
    return bar_ops.changed_only(stored.drop("seq"), again)


def latest_bars(spark: SparkSession, d: str) -> DataFrame:
    """The watermark of every symbol and timeframe: newest bar and oldest number still there."""
    rows = table(spark, d, "stock_bars")
    return rows.groupBy("symbol", "timeframe").agg(F.max("ts").alias("max_ts"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def bars_since(spark: SparkSession, d: str) -> DataFrame:
    """A page of 2000 bars after half of all numbers, with one more row to tell whether there is a next page."""
    from tidemark.operators.cursors import page

    rows = table(spark, d, "stock_bars").select("symbol", "timeframe", "ts", "close", "volume", "seq")
    return page(rows, "seq", newest_value(rows, "seq") // 2, 2000)


def ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each market table."""
    parts = [table(spark, d, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n") for n in ("stock_trades", "stock_quotes", "stock_bars")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def _engine(spark: SparkSession, d: str) -> Engine:
    return Engine(spark, d, newest_value(_trades(spark, d), "ts_us"), extra={"stock_statuses": _statuses(spark, d)})


def movers(spark: SparkSession, d: str, top: int = 10) -> DataFrame:
    """The largest gains and losses in percent."""
    return rounded(_engine(spark, d).movers(top).select("side", "symbol", "price", "percent_change"), "percent_change")


def most_actives(spark: SparkSession, d: str, top: int = 10) -> DataFrame:
    return _engine(spark, d).most_actives(top=top).select("symbol", "volume")


def market_pulse(spark: SparkSession, d: str, top: int = 10) -> DataFrame:
    """Gainers, losers and most active symbols as one list, with their news of the last two days."""
    out = _engine(spark, d).market_pulse(top, 2880).withColumn("lists", F.array_join("sources", ","))
    return rounded(out.select("symbol", "lists", "price", "percent_change", "volume", "news_count", "halted"), "percent_change")


QUERIES = {
    f.__name__: f
    for f in (
        bars_from_trades_1min, bars_5min, bars_15min, bars_1hour, bars_window, trades_window, quotes_window, tape_stats, quote_stats, tape_with_quotes,
        watchlist_pulse, session_indicators, symbol_context, exchange_day_volumes, phase_volumes, event_phases, bar_triggers, market_alerts,
        halted_symbols, trading_halts, latest_snapshot, quote_thinning, bars_changed_only, latest_bars, bars_since, ingest_counts, movers, most_actives, market_pulse,
    )
}


def _rebucket_sql(seconds: int) -> str:
    return f"""
      SELECT symbol, ts - ts % {seconds} AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close,
             CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count,
             round(sum(vwap * volume) / nullif(sum(CASE WHEN vwap IS NOT NULL THEN volume ELSE 0 END), 0), 6) AS vwap
      FROM stock_bars WHERE timeframe = '1min' GROUP BY symbol, ts - ts % {seconds}"""


_TAPE = f"""
  SELECT symbol, ts_us - ts_us % {TAPE_US} AS bucket_us, count(*) AS trades, CAST(sum(size) AS BIGINT) AS volume, sum(price * size) / nullif(sum(size), 0) AS vwap,
         count(*) FILTER (price > prev) AS upticks, count(*) FILTER (price < prev) AS downticks, count(*) FILTER (size >= 1000) AS block_trades, min(price) AS low, max(price) AS high
  FROM (SELECT *, lag(price) OVER (PARTITION BY symbol ORDER BY ts_us, ingest_seq) AS prev FROM stock_trades) GROUP BY 1, 2"""

_QUOTE = f"""
  SELECT symbol, ts_us - ts_us % {TAPE_US} AS bucket_us, count(*) AS quotes, avg((ask_price - bid_price) * 20000.0::DOUBLE / nullif(ask_price + bid_price, 0)) AS spread_bps,
         avg(bid_size::DOUBLE / nullif(bid_size + ask_size, 0)) AS bid_fraction
  FROM stock_quotes WHERE bid_price > 0 AND ask_price > 0 GROUP BY 1, 2"""

_STATUS = "SELECT 'U' || user_id AS symbol, epoch_us(ts) AS ts_us, CASE WHEN event_type = 'error' THEN 'H' ELSE 'T' END AS status_code, event_id FROM events WHERE event_type IN ('error', 'signup')"
_HALTED = f"SELECT symbol FROM (SELECT symbol, last(status_code ORDER BY ts_us, event_id) AS c FROM ({_STATUS}) GROUP BY 1) WHERE c = 'H'"


def _local(seconds: str) -> str:
    return f"(to_timestamp({seconds}) AT TIME ZONE 'America/New_York')"


def _phase(seconds: str) -> str:
    m = f"(hour({_local(seconds)}) * 60 + minute({_local(seconds)}))"
    return (
        f"CASE WHEN dayofweek({_local(seconds)}) NOT BETWEEN 1 AND 5 THEN 'closed' WHEN {m} >= 570 AND {m} < 960 THEN 'open'"
        f" WHEN {m} >= 240 AND {m} < 570 THEN 'premarket' WHEN {m} >= 960 AND {m} < 1200 THEN 'afterhours' ELSE 'closed' END"
    )


def _smoothing(bars: str, keys: str) -> str:
    """RSI, averages and true range by stepping through the bars of each group."""
    on = " AND ".join(f"r.{k} = x.{k}" for k in keys.split(", "))
    return f"""
      c AS (SELECT {keys}, close, close - lag(close) OVER (PARTITION BY {keys} ORDER BY ts) AS d,
                   row_number() OVER (PARTITION BY {keys} ORDER BY ts) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {bars} WHERE close IS NOT NULL),
      h AS (SELECT {keys}, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
                   row_number() OVER w AS i, count(*) OVER (PARTITION BY {keys}) AS n, lag(close) OVER w AS pc
            FROM {bars} WHERE close IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL WINDOW w AS (PARTITION BY {keys} ORDER BY ts)),
      g AS (WITH RECURSIVE r AS (
              SELECT {keys}, 15 AS i, avg(greatest(d, 0)) AS g, avg(greatest(-d, 0)) AS l FROM c WHERE i BETWEEN 2 AND 15 AND n >= 15 GROUP BY {keys}
              UNION ALL SELECT {', '.join(f'r.{k}' for k in keys.split(', '))}, r.i + 1, (r.g * 13 + greatest(x.d, 0)) / 14, (r.l * 13 + greatest(-x.d, 0)) / 14 FROM r JOIN c x ON {on} AND x.i = r.i + 1)
            SELECT {keys}, last(g ORDER BY i) AS g, last(l ORDER BY i) AS l FROM r GROUP BY {keys}),
      {', '.join(f'''e{s} AS (WITH RECURSIVE r AS (
              SELECT {keys}, {s} AS i, avg(close) AS v FROM c WHERE i <= {s} AND n >= {s} GROUP BY {keys}
              UNION ALL SELECT {', '.join(f'r.{k}' for k in keys.split(', '))}, r.i + 1, 2.0::DOUBLE / {s + 1} * x.close + (1 - 2.0::DOUBLE / {s + 1}) * r.v FROM r JOIN c x ON {on} AND x.i = r.i + 1)
            SELECT {keys}, last(v ORDER BY i) AS v FROM r GROUP BY {keys})''' for s in (9, 21))},
      t AS (WITH RECURSIVE r AS (
              SELECT {keys}, 15 AS i, avg(tr) AS v FROM h WHERE i BETWEEN 2 AND 15 AND n >= 15 GROUP BY {keys}
              UNION ALL SELECT {', '.join(f'r.{k}' for k in keys.split(', '))}, r.i + 1, (r.v * 13 + x.tr) / 14 FROM r JOIN h x ON {on} AND x.i = r.i + 1)
            SELECT {keys}, last(v ORDER BY i) AS v FROM r GROUP BY {keys}),
      s AS (SELECT {keys}, round(CASE WHEN g.l = 0 THEN CASE WHEN g.g > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + g.g / g.l) END, 6)::DOUBLE AS rsi_14,
                   round(e9.v, 6) AS ema_9, round(e21.v, 6) AS ema_21, round(t.v, 6) AS atr_14
            FROM (SELECT DISTINCT {keys} FROM c) LEFT JOIN g USING ({keys}) LEFT JOIN e9 USING ({keys}) LEFT JOIN e21 USING ({keys}) LEFT JOIN t USING ({keys}))"""


_DAYS = """
  WITH k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM stock_bars WHERE timeframe = '1day'),
  d AS (SELECT a.symbol, a.close AS price, (a.close - b.close) / nullif(b.close, 0) * 100 AS percent_change, a.volume FROM (SELECT * FROM k WHERE k = 1) a LEFT JOIN (SELECT * FROM k WHERE k = 2) b USING (symbol)),
  m AS ((SELECT 'gainer' AS side, symbol, price, round(percent_change, 6) AS percent_change FROM d WHERE percent_change IS NOT NULL ORDER BY d.percent_change DESC, symbol LIMIT 10)
        UNION ALL (SELECT 'loser', symbol, price, round(percent_change, 6) FROM d WHERE percent_change IS NOT NULL ORDER BY d.percent_change, symbol LIMIT 10)),
  a AS (SELECT symbol, volume FROM d ORDER BY volume DESC NULLS LAST, symbol LIMIT 10)"""

_TRIGGERS = f"""
  WITH b AS (SELECT symbol, ts, CAST({_local('ts')} AS DATE) AS day, close, coalesce(high, close) AS high, coalesce(low, close) AS low, coalesce(volume, 0)::DOUBLE AS volume
             FROM stock_bars WHERE timeframe = '1min' AND close IS NOT NULL),
  s AS (SELECT *, first_value(close) OVER r AS ref, first_value(ts) OVER r AS ref_ts, avg(volume) OVER v AS base, count(*) OVER v AS n, max(high) OVER p AS hi, min(low) OVER p AS lo, count(*) OVER p AS seen
        FROM b WINDOW r AS (PARTITION BY symbol, day ORDER BY ts RANGE BETWEEN 300 PRECEDING AND 1 PRECEDING),
                      v AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING),
                      p AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  f AS (SELECT symbol, ts, 'price_move' AS category, (close - ref) / nullif(ref, 0) * 100 AS value, CASE WHEN close > ref THEN 'bullish' ELSE 'bearish' END AS direction
        FROM s WHERE ts - ref_ts >= 180 AND abs((close - ref) / nullif(ref, 0) * 100) >= 0.5
        UNION ALL SELECT symbol, ts, 'volume_spike', volume / base, 'neutral' FROM s WHERE n >= 10 AND base > 0 AND volume > 0 AND volume >= base * 3
        UNION ALL SELECT symbol, ts, 'day_range_break', hi, 'bullish' FROM s WHERE seen >= 30 AND close > hi
        UNION ALL SELECT symbol, ts, 'day_range_break', lo, 'bearish' FROM s WHERE seen >= 30 AND close < lo)"""

_WINDOW = f"ts_us >= (SELECT max(ts_us) FROM %s) - {WINDOW_US}"

ORACLES = {
    "bars_from_trades_1min": """
      SELECT symbol, ts_us // 1000000 - (ts_us // 1000000) % 60 AS ts, first(price ORDER BY ts_us, ingest_seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts_us, ingest_seq) AS close,
             CAST(coalesce(sum(size), 0) AS BIGINT) AS volume, count(*) AS trade_count, round(sum(price * size) / nullif(sum(coalesce(size, 0)), 0), 6) AS vwap
      FROM stock_trades WHERE price IS NOT NULL GROUP BY 1, 2""",
    "bars_5min": _rebucket_sql(300),
    "bars_15min": _rebucket_sql(900),
    "bars_1hour": _rebucket_sql(3600),
    "bars_window": "SELECT symbol, ts, open, high, low, close, volume, trade_count, vwap FROM stock_bars WHERE timeframe = '1min' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 390",
    "trades_window": f"SELECT symbol, ts_us, price, size, exchange, conditions, tape, ingest_seq FROM stock_trades WHERE {_WINDOW % 'stock_trades'} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_us DESC, ingest_seq DESC) <= {ROWS}",
    "quotes_window": f"SELECT symbol, ts_us, bid_price, bid_size, ask_price, ask_size, tape, ingest_seq FROM stock_quotes WHERE {_WINDOW % 'stock_quotes'} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_us DESC, ingest_seq DESC) <= {ROWS}",
    "tape_stats": f"SELECT * REPLACE (round(vwap, 6) AS vwap) FROM ({_TAPE})",
    "quote_stats": f"SELECT * REPLACE (round(spread_bps, 6) AS spread_bps, round(bid_fraction, 6) AS bid_fraction) FROM ({_QUOTE})",
    "tape_with_quotes": f"""
      SELECT symbol, bucket_us, coalesce(trades, 0) AS trades, CASE WHEN trades IS NULL THEN 0 ELSE volume END AS volume, round(vwap, 6) AS vwap, coalesce(upticks, 0) AS upticks, coalesce(downticks, 0) AS downticks,
             coalesce(block_trades, 0) AS block_trades, low, high, coalesce(quotes, 0) AS quotes, round(spread_bps, 6) AS spread_bps, round(bid_fraction, 6) AS bid_fraction
      FROM ({_TAPE}) FULL JOIN ({_QUOTE}) USING (symbol, bucket_us)""",
    "watchlist_pulse": f"""
      WITH w AS (SELECT DISTINCT symbol FROM stock_bars UNION ALL SELECT 'UNKNOWN'),
      t AS (SELECT symbol, count(*) AS trades, CAST(sum(size) AS BIGINT) AS volume, min(price) AS low, max(price) AS high, first(price ORDER BY ts_us, ingest_seq) AS first_price, last(price ORDER BY ts_us, ingest_seq) AS last_price
            FROM stock_trades WHERE {_WINDOW % 'stock_trades'} GROUP BY 1),
      q AS (SELECT symbol, avg((ask_price - bid_price) * 20000.0::DOUBLE / nullif(ask_price + bid_price, 0)) AS spread_bps FROM stock_quotes WHERE {_WINDOW % 'stock_trades'} AND bid_price > 0 AND ask_price > 0 GROUP BY 1)
      SELECT symbol, coalesce(trades, 0) AS trades, CASE WHEN trades IS NULL THEN 0 ELSE volume END AS volume, low, high, first_price, last_price, round(spread_bps, 6) AS spread_bps,
             round((last_price - first_price) / nullif(first_price, 0) * 100, 6) AS chg_pct
      FROM w LEFT JOIN t USING (symbol) LEFT JOIN q USING (symbol)""",
    "session_indicators": f"""
      WITH RECURSIVE b AS (SELECT *, CAST({_local('ts')} AS DATE) AS day FROM stock_bars WHERE timeframe = '1min'),
      {_smoothing('b', 'symbol, day')}
      SELECT * FROM s""",
    "symbol_context": f"""
      WITH RECURSIVE now AS (SELECT max(ts) AS ts FROM stock_bars WHERE timeframe = '1min'),
      edge AS (SELECT ts, least(ts - 28800, CAST(epoch((date_trunc('day', {_local('ts')} - INTERVAL 4 HOUR) + INTERVAL 4 HOUR) AT TIME ZONE 'America/New_York') AS BIGINT)) AS start, CAST({_local('ts')} AS DATE) AS today FROM now),
      b AS (SELECT * FROM stock_bars WHERE timeframe = '1min' AND ts >= (SELECT start FROM edge)),
      {_smoothing('b', 'symbol')},
      m AS (SELECT symbol, last(close ORDER BY ts) AS last, first(open ORDER BY ts) AS today_open, max(high) AS day_high, min(low) AS day_low, sum(coalesce(volume, 0))::DOUBLE AS v, count(*) AS minute_bars_used,
                   sum(vwap * volume) FILTER (volume <> 0) / nullif(sum(volume) FILTER (vwap IS NOT NULL), 0) AS session_vwap FROM b GROUP BY 1),
      d AS (SELECT * FROM stock_bars WHERE timeframe = '1day' AND ts <= (SELECT ts FROM now) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 15),
      p AS (SELECT symbol, last(close ORDER BY ts) AS prev_close, avg(volume) FILTER (volume <> 0) AS usual FROM d WHERE CAST({_local('ts')} AS DATE) < (SELECT today FROM edge) GROUP BY 1),
      x AS (SELECT *, usual * least(greatest(minute_bars_used / 390.0::DOUBLE, 1 / 390.0::DOUBLE), 1) AS expected FROM m LEFT JOIN p USING (symbol))
      SELECT x.symbol, round(last, 6) AS last, round(prev_close, 6) AS prev_close, round((last - prev_close) / nullif(prev_close, 0) * 100, 6) AS change_pct,
             round(CASE WHEN today_open <> 0 THEN (today_open - prev_close) / nullif(prev_close, 0) * 100 END, 6) AS gap_pct, round(session_vwap, 6) AS session_vwap,
             round((last - session_vwap) / nullif(session_vwap, 0) * 100, 6) AS vwap_distance_pct, rsi_14, ema_9, ema_21, atr_14, round(day_high, 6) AS day_high, round(day_low, 6) AS day_low,
             round(CASE WHEN day_high > day_low THEN (last - day_low) / (day_high - day_low) END, 6) AS range_position, round(nullif(v, 0), 6) AS volume_today,
             round(CASE WHEN v > 0 AND expected > 0 THEN v / expected END, 6) AS rel_volume, minute_bars_used, x.symbol IN ({_HALTED}) AS halted
      FROM x LEFT JOIN s USING (symbol)""",
    "exchange_day_volumes": f"SELECT symbol, CAST({_local('ts')} AS DATE) AS day, count(*) AS bars, CAST(sum(volume) AS BIGINT) AS volume, max(high) AS high, min(low) AS low FROM stock_bars WHERE timeframe = '1min' GROUP BY 1, 2",
    "phase_volumes": f"SELECT {_phase('ts_us // 1000000')} AS phase, count(*) AS trades, CAST(sum(size) AS BIGINT) AS volume FROM stock_trades GROUP BY 1",
    "event_phases": f"SELECT event_id, {_phase('epoch(ts)')} AS phase FROM events",
    "bar_triggers": f"{_TRIGGERS} SELECT symbol, ts, category, round(value, 6) AS value, direction FROM f",
    "market_alerts": f"""
      WITH RECURSIVE a AS (SELECT DISTINCT symbol, category, ts FROM ({_TRIGGERS} SELECT * FROM f)),
      r AS (SELECT symbol, category, min(ts) AS ts FROM a GROUP BY 1, 2
            UNION ALL SELECT r.symbol, r.category, (SELECT min(a.ts) FROM a WHERE a.symbol = r.symbol AND a.category = r.category AND a.ts >= r.ts + 300) FROM r WHERE r.ts IS NOT NULL)
      SELECT * FROM r WHERE ts IS NOT NULL""",
    "halted_symbols": _HALTED,
    "trading_halts": f"SELECT * FROM ({_STATUS}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_us DESC, event_id DESC) <= 10",
    "latest_snapshot": """
      WITH t AS (SELECT symbol, last(ts_us ORDER BY ts_us, ingest_seq) AS trade_us, last(price ORDER BY ts_us, ingest_seq) AS price, last(size ORDER BY ts_us, ingest_seq) AS size FROM stock_trades WHERE price IS NOT NULL GROUP BY 1),
      q AS (SELECT symbol, last(ts_us ORDER BY ts_us, ingest_seq) AS quote_us, last(bid_price ORDER BY ts_us, ingest_seq) AS bid_price, last(ask_price ORDER BY ts_us, ingest_seq) AS ask_price FROM stock_quotes GROUP BY 1),
      b AS (SELECT symbol, last(ts ORDER BY ts) AS bar_ts, last(close ORDER BY ts) AS close FROM stock_bars WHERE timeframe = '1min' GROUP BY 1),
      j AS (SELECT *, greatest(0, (greatest((SELECT max(ts_us) FROM stock_trades), (SELECT max(ts_us) FROM stock_quotes)) - greatest(trade_us, quote_us, bar_ts * 1000000)) / 1000000.0::DOUBLE) AS age FROM t FULL JOIN q USING (symbol) FULL JOIN b USING (symbol))
      SELECT symbol, trade_us, price, size, quote_us, bid_price, ask_price, bar_ts, close, round(age, 6) AS age_s, coalesce(age > 120, true) AS stale FROM j""",
    "quote_thinning": "SELECT symbol, ts_us - ts_us % 60000000 AS bucket_us, ts_us, bid_price, ask_price, ingest_seq FROM stock_quotes QUALIFY row_number() OVER (PARTITION BY symbol, ts_us - ts_us % 60000000 ORDER BY ingest_seq DESC) = 1",
    "bars_changed_only": "SELECT symbol, timeframe, ts, open, high, low, close + 1 AS close, volume, trade_count, vwap FROM stock_bars WHERE seq % 5 = 0 AND close IS NOT NULL",
    "latest_bars": "SELECT symbol, timeframe, max(ts) AS max_ts, min(seq) AS min_seq, max(seq) AS max_seq FROM stock_bars GROUP BY 1, 2",
    "bars_since": "SELECT symbol, timeframe, ts, close, volume, seq, count(*) OVER () > 2000 AS has_more FROM (SELECT * FROM stock_bars WHERE seq > (SELECT max(seq) FROM stock_bars) // 2 ORDER BY seq LIMIT 2001) QUALIFY row_number() OVER (ORDER BY seq) <= 2000",
    "ingest_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ("stock_trades", "stock_quotes", "stock_bars")),
    "movers": f"{_DAYS} SELECT * FROM m",
    "most_actives": f"{_DAYS} SELECT * FROM a",
    "market_pulse": f"""
      {_DAYS},
      u AS (SELECT symbol, side AS list, price, percent_change, NULL AS volume FROM m UNION ALL SELECT symbol, 'most_active', NULL, NULL, volume FROM a),
      f AS (SELECT symbol, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, max(price) AS price, max(percent_change) AS percent_change, max(volume) AS volume FROM u GROUP BY 1),
      n AS (SELECT symbol, count(DISTINCT article_id) AS news_count FROM news_symbol_index WHERE {sql_instant_us('received_at')} >= (SELECT max(ts_us) FROM stock_trades) - 172800000000 GROUP BY 1)
      SELECT symbol, lists, price, percent_change, volume, coalesce(news_count, 0) AS news_count, symbol IN ({_HALTED}) AS halted FROM f LEFT JOIN n USING (symbol)""",
}
ORACLES = {name: sql.replace(", 6)", " + 1e-9::DOUBLE, 6)") for name, sql in ORACLES.items()}
