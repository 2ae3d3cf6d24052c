"""The registered streaming queries: run to the end of their tables, they equal the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.revisions import Lateness, settle
from tidemark.streaming import deltas
from tidemark.streaming.feeds import drain_to_table, table_stream, workspace
from tidemark.streaming.revisions import stream_changelog

MINUTE_US = 60_000_000


def stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Minute bars of the trades as a stream."""
    return deltas.bars(table_stream(spark, d, "stock_trades"), 60, workspace(spark, "stream-bars"))


def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The newest quote of every symbol of the quotes as a stream."""
    return deltas.latest(table_stream(spark, d, "stock_quotes"), ["symbol"], ["bid_price", "ask_price"], workspace(spark, "stream-latest"))


def stream_thinned(spark: SparkSession, d: str) -> DataFrame:
    """The last quote to arrive in every minute of a symbol, from the quotes as a stream."""
    return deltas.last_per_bucket(table_stream(spark, d, "stock_quotes"), MINUTE_US, ["bid_price", "ask_price"], workspace(spark, "stream-thinned"))


def stream_periods(spark: SparkSession, d: str) -> DataFrame:
    """Corrected five-minute counts of all delivered trades, from the streaming changelog."""
    rule = Lateness(5 * MINUTE_US, 15 * MINUTE_US)
    log = drain_to_table(stream_changelog(table_stream(spark, d, "stock_trades"), "symbol", "ts_us", "received_us", "size", rule, "30 days"), workspace(spark, "stream-periods"))
    done = settle(log, ["key", "period_us"], ["total"])
    return done.select(F.col("key").alias("symbol"), F.expr("period_us div 1000000").alias("period_start"), F.col("n").alias("trades"), F.col("total").alias("volume"))


QUERIES = {f.__name__: f for f in (stream_bars, stream_latest, stream_thinned, stream_periods)}

ORACLES = {
    "stream_bars": """
      SELECT symbol, ts_us // 1000000 - (ts_us // 1000000) % 60 AS ts, first(price ORDER BY ts_us, ingest_seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts_us, ingest_seq) AS close,
             CAST(coalesce(sum(size), 0) AS BIGINT) AS volume, count(*) AS trade_count FROM stock_trades WHERE price IS NOT NULL GROUP BY 1, 2""",
    "stream_latest": "SELECT symbol, ts_us, ingest_seq, bid_price, ask_price FROM stock_quotes QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts_us DESC, ingest_seq DESC) = 1",
    "stream_thinned": """
      SELECT symbol, ts_us - ts_us % 60000000 AS bucket_us, ts_us, ingest_seq, bid_price, ask_price FROM stock_quotes
      QUALIFY row_number() OVER (PARTITION BY symbol, ts_us - ts_us % 60000000 ORDER BY ingest_seq DESC) = 1""",
    "stream_periods": """
      SELECT symbol, p // 1000000 AS period_start, count(*) AS trades, CAST(sum(coalesce(size, 0)) AS BIGINT) AS volume
      FROM (SELECT *, ts_us - ts_us % 300000000 AS p FROM stock_trades) WHERE received_us < p + 1200000000 GROUP BY 1, 2""",
}
