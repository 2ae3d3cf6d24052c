import json

import pytest
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.config import Settings, from_environment
from tidemark.streaming import publish
from tidemark.streaming.publish import ARTICLES, BAR_KEY, Published, upsert_articles, upsert_bars

BARS = "symbol string, timeframe string, ts long, open double, high double, low double, close double, volume long, trade_count long, vwap double"


def _bars(spark, rows):
    return spark.createDataFrame([("A", "1min", ts, c, c, c, c, 1, 1, None, n) for n, (ts, c) in enumerate(rows)], f"{BARS}, arrival long")


def test_bars_are_published_once(spark, tmp_path):
    store = Published(spark, str(tmp_path / "bars"), f"{BARS}, seq long", BAR_KEY, parts=3)
    assert store.read().count() == 0
    assert upsert_bars(store, _bars(spark, [(0, 1.0), (60, 2.0), (60, 2.5)]), 0).count() == 2
    assert upsert_bars(store, _bars(spark, [(0, 9.0)]), 0) is None
    assert upsert_bars(store, _bars(spark, [(0, 1.0), (60, 3.0), (120, 4.0)]), 1).count() == 2
    got = sorted((r.ts, r.close, r.seq) for r in store.read().collect())
    assert [(t, c) for t, c, _ in got] == [(0, 1.0), (60, 3.0), (120, 4.0)]
    assert [s for _, _, s in got] == [1, 3, 4] and store.manifest()["high_water"] == 4
    assert upsert_bars(store, _bars(spark, []), 2).count() == 0 and store.read().count() == 3


def _articles(spark, rows):
    full = [(i, h, s, None, None, None, u, None, None, None, None, "{}", at, None, True, n) for n, (i, h, s, u, at) in enumerate(rows)]
    schema = "id long, headline string, symbols array<string>, summary string, author string, created_at string, updated_at string, content_html string, content_text string, url string, source string, raw_json string, received_at string, latency_ms long, is_content_present boolean, arrival long"
    return spark.createDataFrame(full, schema)


def test_articles_fold_over_batches(spark, tmp_path):
    store = Published(spark, str(tmp_path / "news"), ARTICLES, ["id"], parts=3)
    first = upsert_articles(store, _articles(spark, [(1, "a", ["X"], "u1", "t1"), (2, "b", [], None, "t1"), (1, "a2", ["X"], None, "t2")]), 0)
    assert first.filter("was_new").count() == 2 and first.filter("content_changed").count() == 1
    second = upsert_articles(store, _articles(spark, [(1, "a2", ["X"], "u1", "t3"), (2, "c", [], None, "t3"), (3, "n", [], None, "t3")]), 1)
    assert {r.id for r in second.filter("was_new").collect()} == {3} and {r.id for r in second.filter("content_changed").collect()} == {2}
    got = {r.id: (r.headline, r.updated_at, r.update_count, r.first_seen_at, r.last_seen_at, r.seq) for r in store.read().collect()}
    assert got == {1: ("a2", "u1", 1, "t1", "t3", 2), 2: ("c", None, 1, "t1", "t3", 3), 3: ("n", None, 0, "t3", "t3", 4)}
    assert upsert_articles(store, _articles(spark, [(9, "x", [], None, "t")]), 1) is None


def test_many_batches_are_rewritten_as_one_and_only_touched_parts_grow(spark, tmp_path):
    day = F.expr("ts div 100").cast("int")
    store = Published(spark, str(tmp_path / "bars"), f"{BARS}, seq long", BAR_KEY, part=day, most_sets=3)
    upsert_bars(store, _bars(spark, [(0, 1.0), (500, 5.0)]), 0)
    for n in range(1, 6):
        upsert_bars(store, _bars(spark, [(60, float(n))]), n)
        assert len(store.manifest()["files"]["0"]) <= 4 and len(store.manifest()["files"]["5"]) == 1
    assert sorted((r.ts, r.close) for r in store.read().collect()) == [(0, 1.0), (60, 5.0), (500, 5.0)]
    store.keep(F.col("ts") >= 60, 0)
    assert sorted(r.ts for r in store.read().collect()) == [60, 500]
    store.keep(F.col("ts") >= 500, 5)
    assert [r.ts for r in store.read().collect()] == [500]


ALERT_ROWS = "alert_id string, article_id long, created_us long, severity string, category string, symbols array<string>, headline string, reason string, content_hash string, direction string"


def _alerts(spark, rows):
    return spark.createDataFrame([(a, i, at, "high", c, ["X"], "h", "why", h, "neutral") for a, i, at, c, h in rows], ALERT_ROWS)


def test_alert_store(spark, tmp_path):
    day = 86_400_000_000
    store = Published(spark, str(tmp_path / "alerts"), publish.ALERTS, ["alert_id"], parts=2)
    first = publish.insert_alerts(store, _alerts(spark, [("a", 1, 10, "c", "h1"), ("b", 1, 20, "c", "h2"), ("c", 2, 30, "c", "h1"), ("d", 3, 40, "e", "h1"), ("w", None, 50, "watched", None), ("w2", None, 51, "watched", None)]), 0)
    assert {r.alert_id: r.seq for r in first.collect()} == {"a": 1, "d": 2, "w": 3, "w2": 4}
    assert publish.insert_alerts(store, _alerts(spark, [("z", 9, 1, "c", None)]), 0) is None
    second = publish.insert_alerts(store, _alerts(spark, [("a2", 1, 10 + 9 * day, "c", "new"), ("e", 4, 10 + day, "c", "h1"), ("f", 5, 11 + day, "c", "h1"), ("w", None, 50, "watched", None)]), 1)
    assert {r.alert_id: r.seq for r in second.collect()} == {"f": 5}
    assert publish.acknowledge(store, ["d", "nope"]) == 1 and publish.acknowledge(store, ["nope"]) == 0
    assert {r.alert_id for r in store.read().filter("acknowledged").collect()} == {"d"} and store.read().count() == 5


def test_market_store_shows_whole_batches_only(spark, tmp_path):
    day = 86_400_000_000
    store = publish.MarketStore(spark, str(tmp_path / "market"))
    trades = lambda *ts: spark.createDataFrame([("A", t, 1.0, 1, "x", "", "t", None) for t in ts], schemas.TRADES)
    raw = spark.createDataFrame([("q", "{}", None)], publish.MarketStore.TABLES["raw"])
    assert store.read("trades").count() == 0 and store.insert({"trades": trades(1, 2, day), "raw": raw}, 0)
    assert not store.insert({"trades": trades(3)}, 0) and store.read("trades").count() == 3 and store.read("raw").count() == 1
    store.tables["trades"].publish(trades(5), 1, 0)  # a batch that stopped before its commit
    assert store.read("trades").count() == 3
    assert store.insert({"trades": trades(5), "raw": raw}, 1) and store.read("trades").count() == 4 and store.read("raw").count() == 2
    store.keep_since("trades", 2)
    assert sorted(r.ts_us for r in store.read("trades").collect()) == [2, 5, day]
    store.keep_since("trades", day)
    assert sorted(r.ts_us for r in store.read("trades").collect()) == [day]


def test_history_job(spark, tmp_path):
    from tidemark.operators.alerts import Rules
    from tidemark.streaming import jobs

    items = [
        {"id": 1, "headline": "Acme faces fraud probe", "symbols": ["ACME"], "created_at": "2022-01-03T10:00:00Z", "content": "<p>x</p>"},
        {"id": 2, "headline": "Other", "symbols": ["OTH"], "created_at": "2022-01-04T10:00:00Z"},
        {"id": 3, "headline": "Acme grows", "symbols": ["acme "], "created_at": "2022-01-05T10:00:00Z"},
        {"id": "none"},
    ]
    pages = lambda rows: spark.createDataFrame([(json.dumps(x), 0) for x in rows], "value string, page int")
    store = Published(spark, str(tmp_path / "news"), ARTICLES, ["id"], parts=2)
    now = F.lit("2022-01-06T00:00:00Z").cast("timestamp")
    run, states = jobs.ingest_pages(store, pages(items), now, 0, symbols=["ACME"])
    assert (run.new, run.updated, run.duplicate, run.failed, run.ingested) == (2, 0, 0, 1, 2) and run.failure and {r.id for r in store.read().collect()} == {1, 3}
    made = {r.category: r for r in jobs.alerts_of(states, Rules(), ["ACME"]).collect() if r.article_id == 1}
    assert made["legal_regulatory_keyword"].severity == "critical" and made["legal_regulatory_keyword"].reason == "keyword match in legal_regulatory: fraud" and "high_latency" not in made
    changed = [items[0] | {"headline": "Acme settles", "updated_at": "2022-01-05T11:00:00Z"}, items[2]]
    run, states = jobs.ingest_pages(store, pages(changed), now, 1)
    assert (run.new, run.updated, run.duplicate, run.failure) == (0, 1, 1, None)
    stories = [r for r in jobs.alerts_of(states, Rules(), [], watched=[1, 3]).collect() if r.category == "watched_story_update"]
    assert [r.reason for r in stories] == ["watched story updated (article_id=1, update #1)"]
    run, _ = jobs.ingest_pages(store, pages(items[:3]), now, 2, most=2)
    assert run.truncated and run.ingested == 2 and {r.id for r in store.read().collect()} == {1, 2, 3}


def test_fetched_bars_fill_a_gap(spark, tmp_path):
    from tidemark.operators import ingest
    from tidemark.streaming import jobs

    store = Published(spark, str(tmp_path / "bars"), f"{BARS}, seq long", BAR_KEY)
    upsert_bars(store, _bars(spark, [(600, 1.0)]), 0)
    items = [{"S": "a", "t": f"1970-01-01T00:{m:02d}:00Z", "o": 1, "c": float(m), "v": 5} for m in (5, 10, 11)] + [{"S": "b", "t": "soon"}, {"S": "b", "t": "1970-01-01T00:10:00Z", "c": 7}]
    fetched = jobs.bar_rows(spark.createDataFrame([(json.dumps(x), 0) for x in items], "value string, page int"))
    starts = ingest.fill_starts(spark.createDataFrame([("A",), ("B",)], "symbol string"), store.read(), now=900, fallback_s=400)
    assert jobs.backfill_bars(store, fetched, starts, 1) == 3
    assert sorted((r.symbol, r.ts, r.close) for r in store.read().collect()) == [("A", 600, 10.0), ("A", 660, 11.0), ("B", 600, 7.0)]
    added = ingest.added_starts(spark.createDataFrame([("C",)], "symbol string"), now=90_000)
    assert [(r.start, r.bucket) for r in added.collect()] == [(75_600, 75_600)]
    assert ingest.added_starts(added, 90_000, 0).count() == 0


def test_failed_batches_are_tried_again_and_then_set_aside(spark, tmp_path):
    from tidemark.operators import ingest
    from tidemark.sources import frames
    from tidemark.streaming.jobs import lasting

    seen, put = [], []

    def write(batch, number):
        seen.append(number)
        if number == 1 or (number == 0 and len(seen) == 1):
            raise OSError("full")

    def recover(batch, number, error):
        kept, lost = ingest.kept_and_lost(batch)
        put.append((number, sorted(r.message_type for r in ingest.set_aside(kept, F.lit("2022-01-01")).collect()), {r.kind: r.lost for r in lost.collect()}))

    values = spark.createDataFrame([('[{"T":"t"},{"T":"s"},{"T":"q"},{"T":"q"},{"T":"zz"},{"x":1}]',)], "value string")
    step = lasting(write, recover)
    for n in range(3):
        step(frames.decode(values), n)
    assert seen == [0, 0, 1, 1, 2] and put == [(1, ["None", "s", "zz"], {"t": 1, "q": 2})]
    again = ingest.to_replay(ingest.set_aside(frames.decode(values), F.lit("2022-01-01")))
    assert again.count() == 6 and ingest.to_replay(ingest.mark_replayed(again, again)).count() == 0


def test_retry_after():
    from datetime import UTC, datetime

    from tidemark.operators.ingest import retry_after

    now = datetime(2022, 1, 1, tzinfo=UTC)
    assert [retry_after(x, now, 2.0) for x in (None, "", "1.5", "soon", "Sat, 01 Jan 2022 00:00:30 GMT", "Fri, 31 Dec 2021 00:00:00 GMT")] == [2.0, 2.0, 1.5, 2.0, 30.0, 0.0]


def test_streams_publish_batch_by_batch(spark, tmp_path):
    from tidemark.streaming.feeds import drain

    for rows in ([(0, 1.0)], [(0, 2.0), (60, 1.0)]):
        _bars(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = Published(spark, str(tmp_path / "bars"), f"{BARS}, seq long", BAR_KEY, parts=2)
    stream = spark.readStream.schema(f"{BARS}, arrival long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(stream, lambda batch, n: upsert_bars(store, batch, n), str(tmp_path / "home"))
    assert store.read().agg(F.count("*"), F.max("seq")).first()[0] == 2


def test_settings():
    assert from_environment({}) == Settings()
    got = from_environment({"TIDEMARK_WATCHLIST": " aapl,MSFT,,aapl", "TIDEMARK_PRICE_MOVE_PCT": "2.5", "TIDEMARK_ALERTS_ENABLED": "off"})
    assert (got.watchlist, got.price_move_pct, got.alerts_enabled) == (("AAPL", "MSFT"), 2.5, False)
    for name, value in (("ALERTS_ENABLED", "maybe"), ("RAW_RETENTION_DAYS", "-1"), ("HIGH_LATENCY_MS", "x")):
        with pytest.raises(ValueError, match=name):
            from_environment({f"TIDEMARK_{name}": value})


def test_reference_tables(spark, small):
    from tidemark.api import Engine, RequestError

    engine = Engine(spark, small, 1_641_340_800_000_000)
    days = spark.createDataFrame([("2022-01-04",), ("2022-01-05",), ("2022-06-05",)], "date string")
    assert [r.date for r in engine.calendar(days).collect()] == ["2022-01-05"]
    with pytest.raises(RequestError):
        engine.calendar(days, "2022-01-01", "2022-12-31")
    acts = spark.createDataFrame([("A", "split", "2022-01-04"), ("B", "dividend", "2022-01-05")], "symbol string, type string, date string")
    assert [r.symbol for r in engine.corporate_actions(acts, types=["Split"]).collect()] == ["A"]
    assert [r.symbol for r in engine.corporate_actions(acts, ["b"], start="2022-01-05", end="2022-01-06").collect()] == ["B"]
