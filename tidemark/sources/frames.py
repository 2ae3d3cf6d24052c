"""Feeds of JSON frames: decoding, routing by kind, normalising.

Works on batches and streams alike: input is a DataFrame with a string column ``value``.
What can't be used is never dropped, it comes out as a raw row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType
from pyspark.sql.types import StringType

from tidemark import schemas
from tidemark.functions.html import html_text
from tidemark.functions.text import clean_symbols, content_hash
from tidemark.functions.times import instant, instant_us


def from_msgpack(values: DataFrame) -> DataFrame:
    """Binary msgpack frames as JSON text, for :func:`decode`; needs the msgpack package on the executors."""
    try:
        import msgpack
    except ImportError:
        raise RuntimeError("msgpack is not installed; send frames as JSON") from None

    def text(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for frame in frames:
            yield frame.map(lambda b: json.dumps(msgpack.unpackb(b, timestamp=3), default=str), na_action="ignore")

    unpack = F.pandas_udf(text, StringType(), PandasUDFType.SCALAR_ITER)
    return values.select(unpack("value").alias("value"))


def decode(values: DataFrame) -> DataFrame:
    """One row ``raw_json`` and ``kind`` for each object of each frame; a frame is an object or an array of them, other elements drop out."""
    text = F.trim("value")
    items = F.when(F.startswith(text, F.lit("[")), F.from_json(text, "array<string>")).otherwise(F.array(text))
    rows = values.select(F.explode(items).alias("raw_json"))
    rows = rows.filter(F.startswith(F.trim("raw_json"), F.lit("{")))
    return rows.withColumn("kind", F.get_json_object("raw_json", "$.T"))


def _parsed(frames: DataFrame, kinds: list[str]) -> DataFrame:
    """Frames of some kinds as variants; keys of a frame differ in case only, which a struct can't hold."""
    rows = frames.filter(F.col("kind").isin(kinds)).withColumn("f", F.try_parse_json("raw_json"))
    return rows.withColumn("symbol", F.upper(_get("S", "string"))).withColumn("ts_us", instant_us(_get("t", "string")))


def _get(key: str, kind: str) -> Column:
    return F.try_variant_get("f", f"$.{key}", kind)


def _fields(letter: str, **named: str) -> list[Column]:
    """Columns by the keys of a kind of frame, with the types the schema of that kind gives."""
    return [_get(short, schemas.FRAME[letter][short]).alias(name) for name, short in named.items()]


def _usable(extra: Column | None = None) -> Column:
    test = F.col("symbol").isNotNull() & (F.col("symbol") != "") & F.col("ts_us").isNotNull()
    return F.coalesce(test if extra is None else test & extra, F.lit(False))


def route(frames: DataFrame) -> dict[str, DataFrame]:
    """The market tables of decoded frames.

    A trade needs a symbol, a time and a price that is a number, not a text or a truth value;
    all others a symbol and a time. Statuses and bands are kept raw as well, as is all that fits nowhere.
    """
    conditions = F.array_join(_get("c", "array<string>"), ",").alias("conditions")
    t, q, b, s, band = (_parsed(frames, k) for k in (["t"], ["q"], ["b", "u", "d"], ["s"], ["l"]))
    priced = _usable(F.schema_of_variant(F.try_variant_get("f", "$.p", "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    rest = frames.filter(~F.coalesce(F.col("kind").isin("t", "q", "b", "u", "d", "s", "l"), F.lit(False))).select("kind", "raw_json")
    unusable = [x.filter(~ok).select("kind", "raw_json") for x, ok in ((t, priced), (q, _usable()), (b, _usable()))]
    raw = rest
    for one in [*unusable, s.select("kind", "raw_json"), band.select("kind", "raw_json")]:
        raw = raw.unionAll(one)
    return {
        "trades": t.filter(priced).select("symbol", "ts_us", *_fields("t", price="p", size="s", exchange="x"), conditions, *_fields("t", tape="z", trade_id="i")),
        "quotes": q.filter(_usable()).select(
            "symbol", "ts_us", *_fields("q", bid_price="bp", bid_size="bs", bid_exchange="bx", ask_price="ap", ask_size="as", ask_exchange="ax"), conditions, *_fields("q", tape="z")
        ),
        "bars": b.filter(_usable()).select(
            "symbol", F.when(F.col("kind") == "d", "1day").otherwise("1min").alias("timeframe"), F.expr("ts_us div 1000000").alias("ts"),
            *_fields("b", open="o", high="h", low="l", close="c", volume="v", trade_count="n", vwap="vw"), (F.col("kind") == "b").alias("is_first_print"),
        ),
        "statuses": s.filter(_usable()).select("symbol", "ts_us", *_fields("s", status_code="sc", status_msg="sm", reason_code="rc", reason_msg="rm", tape="z")),
        "bands": band.filter(_usable()).select("symbol", "ts_us", *_fields("l", limit_up="u", limit_down="d", indicator="i", tape="z")),
        "raw": raw.select(F.coalesce("kind", F.lit("None")).alias("message_type"), "raw_json"),
    }


def articles(frames: DataFrame, received_at: Column) -> tuple[DataFrame, DataFrame]:
    """Normalised articles of decoded frames, and the frames that are none.

    An article has no kind or kind ``n``, and an id that is an integer. Unknown fields stay in ``raw_json``.
    """
    parsed = frames.withColumn("f", F.from_json("raw_json", schemas.ARTICLE)).withColumn("id", F.col("f.id").try_cast("long"))
    good = F.coalesce((F.col("kind").isNull() | (F.col("kind") == "n")) & F.col("id").isNotNull(), F.lit(False))
    listed = F.when(F.startswith("f.symbols", F.lit("[")), F.from_json("f.symbols", "array<string>")).otherwise(F.array("f.symbols"))
    rows = parsed.filter(good).withColumn("_received", received_at).select(
        "id",
        F.coalesce("f.headline", F.lit("")).alias("headline"), "f.summary", "f.author",
        instant(F.col("f.created_at")).alias("created_at"), instant(F.col("f.updated_at")).alias("updated_at"),
        F.col("f.content").alias("content_html"), html_text(F.col("f.content")).alias("content_text"), "f.url", "f.source",
        clean_symbols(listed).alias("symbols"), "raw_json", F.col("_received").alias("received_at"),
        content_hash(F.coalesce("f.headline", F.lit("")), F.col("f.summary"), F.col("f.content")).alias("content_hash"),
        F.coalesce(F.trim("f.content") != "", F.lit(False)).alias("is_content_present"),
    )
    # cut towards zero; negative if the clock of the source is ahead
    rows = rows.withColumn("latency_ms", F.expr("(unix_micros(received_at) - unix_micros(created_at)) div 1000"))
    return rows, parsed.filter(~good).select("kind", "raw_json")
