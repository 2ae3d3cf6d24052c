"""Schemas of the stored tables and of the frames of the feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRADES = "symbol string, ts_us long, price double, size long, exchange string, conditions string, tape string, trade_id long"
QUOTES = "symbol string, ts_us long, bid_price double, bid_size long, bid_exchange string, ask_price double, ask_size long, ask_exchange string, conditions string, tape string"
BARS = "symbol string, timeframe string, ts long, open double, high double, low double, close double, volume long, trade_count long, vwap double"
STATUSES = "symbol string, ts_us long, status_code string, status_msg string, reason_code string, reason_msg string, tape string"
BANDS = "symbol string, ts_us long, limit_up double, limit_down double, indicator string, tape string"
RAW_EVENTS = "event_id string, received_at string, endpoint string, message_type string, raw_json string, replayed boolean"
ALERTS = "alert_id string, article_id long, created_at string, severity string, category string, symbols array<string>, headline string, reason string, acknowledged boolean, raw_json string, content_hash string, direction string, seq long"

#: Keys mean different things in frames of different kinds, so each kind has types of its own.
FRAME = {
    "t": {"i": "long", "x": "string", "p": "double", "s": "long", "z": "string"},
    "q": {"bx": "string", "bp": "double", "bs": "long", "ax": "string", "ap": "double", "as": "long", "z": "string"},
    "b": {"o": "double", "h": "double", "l": "double", "c": "double", "v": "long", "n": "long", "vw": "double"},
    "s": {"sc": "string", "sm": "string", "rc": "string", "rm": "string", "z": "string"},
    "l": {"u": "double", "d": "double", "i": "string", "z": "string"},
}
ARTICLE = "T string, id string, headline string, summary string, author string, created_at string, updated_at string, content string, url string, symbols string, source string"

#: Columns that later versions of a table added, with their value in older rows, in order.
ADDED = {
    "news_articles": [("seq", None)],
    "raw_events": [("replayed", False)],
    "alerts": [("content_hash", None), ("direction", "neutral"), ("seq", None)],
}
ADDED_TYPES = {"seq": "long", "replayed": "boolean", "content_hash": "string", "direction": "string"}


def migrate(table: str, rows: DataFrame) -> DataFrame:
    """``rows`` of any version of ``table`` with the columns of the newest one; running it again changes nothing."""
    for name, value in ADDED.get(table, []):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value).cast(ADDED_TYPES[name]))
    return rows
