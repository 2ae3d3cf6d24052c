from datetime import UTC, date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.sessions import context_session, exchange_day, market_phase
from tidemark.operators import bars, context, tape, triggers

BARS = "symbol string, timeframe string, ts long, open double, high double, low double, close double, volume long, trade_count long, vwap double"


def _bars(spark, closes, spread=1.0, volume=100, symbol="A", start=0, vwap=None):
    rows = [(symbol, "1min", start + 60 * i, c, c + spread, c - spread, c, volume, 1, vwap) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, BARS)


def _one(spark, closes, **k):
    return context.smoothed_indicators(_bars(spark, [float(c) for c in closes], **k), ["symbol"]).first()


@pytest.mark.parametrize(("closes", "want"), [(range(1, 17), 100.0), (range(17, 1, -1), 0.0), ([5] * 20, 50.0), (range(1, 11), None)])
def test_rsi_goldens(spark, closes, want):
    got = _one(spark, closes).rsi_14
    assert got is None if want is None else got == pytest.approx(want)


def test_atr_and_averages(spark):
    row = _one(spark, range(1, 22))
    assert row.atr_14 == pytest.approx(2.0) and 16 < row.ema_9 < 21
    assert _one(spark, range(5)).ema_9 is None


def test_smoothing_equals_the_recursion(spark):
    rng = np.random.default_rng(8)
    closes = (100 + np.cumsum(rng.normal(size=200))).tolist()
    row = _one(spark, closes)
    d = np.diff(closes)
    gain, loss = np.maximum(d, 0), np.maximum(-d, 0)
    g, l = gain[:14].mean(), loss[:14].mean()
    for x, y in zip(gain[14:], loss[14:], strict=True):
        g, l = (g * 13 + x) / 14, (l * 13 + y) / 14
    e = np.mean(closes[:9])
    for c in closes[9:]:
        e = 0.2 * c + 0.8 * e
    assert row.rsi_14 == pytest.approx(100 - 100 / (1 + g / l)) and row.ema_9 == pytest.approx(e)


def test_five_minute_bars(spark):
    rows = [("A", "1min", 60 * i, 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 100 * (i + 1), 1, None) for i in range(12)]
    out = bars.rebucket(spark.createDataFrame(rows, BARS), 300).orderBy("ts").collect()
    assert len(out) == 3 and (out[0].open, out[0].close, out[0].high, out[0].low, out[0].volume) == (100.0, 104.5, 105.0, 99.0, 1500)
    assert out[2].volume == 2300 and out[0].vwap is None


def test_average_price_weighs_only_bars_that_have_one(spark):
    rows = [("A", "1min", 0, 1.0, 1.0, 1.0, 1.0, 100, 1, 10.0), ("A", "1min", 60, 1.0, 1.0, 1.0, None, 300, 1, None)]
    row = bars.rebucket(spark.createDataFrame(rows, BARS), 300).first()
    assert (row.vwap, row.volume, row.close) == (10.0, 400, None)


def test_tape_quotes_and_pulse(spark):
    trades = spark.createDataFrame([("A", 1, 1, 100.0, 100), ("A", 2, 2, 101.0, 2000), ("A", 60_000_000, 3, 100.5, 50)], "symbol string, ts_us long, ingest_seq long, price double, size long")
    quotes = spark.createDataFrame([("A", 5, 9, 100.0, 0, 100.2, 0), ("A", 6, 10, 0.0, 1, 100.2, 1)], "symbol string, ts_us long, ingest_seq long, bid_price double, bid_size long, ask_price double, ask_size long")
    first, second = tape.tape_stats(trades, 60_000_000).orderBy("bucket_us").collect()
    assert (first.trades, first.upticks, first.downticks, first.block_trades) == (2, 1, 0, 1)
    assert (second.trades, second.downticks) == (1, 1)
    q = tape.quote_stats(quotes, 60_000_000).first()
    assert q.quotes == 1 and q.spread_bps == pytest.approx(0.2 * 20000 / 200.2) and q.bid_fraction is None
    wanted = spark.createDataFrame([("A",), ("B",)], "symbol string")
    a, b = tape.pulse(trades, quotes, wanted).orderBy("symbol").collect()
    assert (a.first_price, a.last_price, a.volume) == (100.0, 100.5, 2150)
    assert (b.trades, b.volume, b.low, b.spread_bps) == (0, 0, None, None)
    both = tape.tape_with_quotes(tape.tape_stats(trades, 60_000_000), tape.quote_stats(quotes.withColumn("symbol", F.lit("C")), 60_000_000))
    assert {(r.symbol, r.trades, r.quotes, r.volume) for r in both.collect()} == {("A", 2, 0, 2100), ("A", 1, 0, 50), ("C", 0, 1, 0)}


def test_thinning_keeps_the_last_arrival(spark):
    q = spark.createDataFrame([("A", 1_100_000, 1, 1.0), ("A", 1_900_000, 2, 2.0), ("A", 2_500_000, 3, 3.0)], "symbol string, ts_us long, ingest_seq long, bid_price double")
    assert sorted(r.bid_price for r in tape.thin(q, 1_000_000).collect()) == [2.0, 3.0]


def test_redelivered_bars_write_nothing(spark):
    stored = _bars(spark, [1.0, 2.0], vwap=None).withColumn("seq", F.col("ts") / 60 + 1).withColumn("seq", F.col("seq").cast("long"))
    again = stored.drop("seq").withColumn("arrival", F.lit(1))
    assert bars.changed_only(stored.drop("seq"), again).count() == 0
    changed = again.withColumn("close", F.when(F.col("ts") == 60, 9.0).otherwise(F.col("close")))
    after, written = bars.upsert(stored, changed, 2)
    assert [(r.ts, r.seq) for r in written.collect()] == [(60, 3)]
    assert sorted((r.ts, r.close, r.seq) for r in after.collect()) == [(0, 1.0, 1), (60, 9.0, 3)]


def _feed(spark, closes, volumes):
    rows = [("A", "1min", 1_700_000_000 + 60 * i, c, c, c, c, v, 1, None) for i, (c, v) in enumerate(zip(closes, volumes, strict=True))]
    return spark.createDataFrame(rows, BARS)


def test_triggers(spark):
    found = triggers.triggers(_feed(spark, [100.0] * 11 + [105.0, 105.5], [1000] * 11 + [10_000, 1000]))
    got = {(r.ts, r.category): (r.direction, r.value) for r in found.collect()}
    at = 1_700_000_000 + 660
    assert got[at, "price_move"] == ("bullish", 5.0) and got[at, "volume_spike"] == ("neutral", 10.0)
    kept = triggers.leading_edge(found.filter("category = 'price_move'").select("symbol", "category", "ts"), ["symbol", "category"], "ts", 300)
    assert [r.ts for r in kept.collect()] == [at]


def test_range_breaks_need_bars_of_the_day_or_of_the_window(spark):
    feed = _feed(spark, [100.0] * 31 + [101.0], [1] * 32)
    kinds = lambda **k: {r.category for r in triggers.triggers(feed, triggers.TriggerRule(**k)).collect()}
    assert "day_range_break" in kinds() and "day_range_break" not in kinds(only_window=True)
    assert "day_range_break" in kinds(only_window=True, window_s=1860)


def test_leading_edge_is_not_extended(spark):
    rows = [("a", t) for t in (0, 200, 299, 300, 599, 600, 600)] + [("b", 5), (None, 1), ("c", None)]
    df = spark.createDataFrame(rows, "k string, t long")
    got = sorted((r.k or "", r.t) for r in triggers.leading_edge(df, ["k"], "t", 300).collect())
    assert got == [("", 1), ("a", 0), ("a", 300), ("a", 600), ("b", 5)]


def test_quota_charges_only_symbols_below_it(spark):
    rows = [("c", "high", ["S", "Q"], 0), ("c", "high", ["S"], 10), ("c", "high", ["S", "Q"], 20), ("c", "high", ["S", "Q"], 30), ("c", "critical", ["S"], 31), ("c", "high", ["S"], 3701), ("d", "high", None, 0)]
    df = spark.createDataFrame(rows, "category string, severity string, symbols array<string>, at long")
    got = sorted((r.category, r.at) for r in triggers.within_quota(df, "at", limit=2, span=3600).collect())
    assert got == [("c", 0), ("c", 10), ("c", 20), ("c", 31), ("c", 3701), ("d", 0)]


def test_exchange_days_phases_and_sessions(spark):
    at = lambda *x: int(datetime(*x, tzinfo=UTC).timestamp())
    days = [at(2026, 1, 14, 21), at(2026, 1, 15, 0, 30), at(2026, 1, 15, 10)]
    df = spark.createDataFrame([(d,) for d in days], "t long").select(exchange_day(F.col("t")).alias("d"))
    a, b, c = (r.d for r in df.collect())
    assert a == b == date(2026, 1, 14) and c == date(2026, 1, 15)
    phases = [(at(2026, 7, 8, 13), "premarket"), (at(2026, 7, 8, 14), "open"), (at(2026, 7, 8, 21), "afterhours"), (at(2026, 7, 8, 7), "closed"), (at(2026, 7, 11, 18), "closed")]
    got = spark.createDataFrame(phases, "t long, want string").select(market_phase(F.col("t")).alias("p"), "want", market_phase(F.col("t"), F.lit(False)).alias("off")).collect()
    assert all(r.p == r.want and r.off == "closed" for r in got)
    start, day = context_session(datetime(2026, 7, 8, 22, tzinfo=UTC))
    assert start == at(2026, 7, 8, 8) and day == date(2026, 7, 8)
    assert context_session(datetime(2026, 7, 9, 7, tzinfo=UTC))[0] == at(2026, 7, 8, 8)


def test_halted_is_the_newest_status(spark):
    s = spark.createDataFrame([("A", 1, "H", 1), ("A", 2, "T", 2), ("B", 1, "T", 3), ("B", 1, "H", 4)], "symbol string, ts_us long, status_code string, event_id long")
    assert [r.symbol for r in tape.halted(s).collect()] == ["B"]
