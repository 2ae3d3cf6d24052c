"""The registered queries against their SQL on the smallest data, the API's checks, and the streams."""

import importlib
import math
import os

import duckdb
import pytest

from tidemark import api
from tidemark.operators.cursors import next_cursor, position
from tidemark.plans import registry
from tidemark.schemas import migrate


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if hasattr(v, "isoformat") else v


def _rows(rows):
    return sorted((tuple(_plain(x) for x in r) for r in rows), key=lambda r: [(x is None, str(type(x)), x) for x in r])


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if not n.startswith("stream_")])
def test_query_equals_its_sql(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    if name not in registry.ORACLES:
        assert df.columns
        return
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{small}/{f}')")
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert _rows(df.select(*columns).collect()) == _rows(want)


@pytest.mark.parametrize("name", ["stream_bars", "stream_latest", "stream_thinned", "stream_periods"])
def test_stream_equals_its_sql(spark, small, name):
    test_query_equals_its_sql(spark, small, name)


@pytest.mark.parametrize("name", ["event_phases", "halted_symbols", "symbol_context", "session_indicators", "bar_triggers", "article_instants", "p1_found", "p4_found"])
def test_results_do_not_depend_on_the_time_zone(spark, small, name):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        test_query_equals_its_sql(spark, small, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_entry_module(spark, small):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() > 0


def test_positions_and_gaps():
    assert position(-1, 9, 1) == {"start": 9, "note": "started_from_tail"}
    assert position(10, 9, 1)["error"] == "cursor_out_of_range"
    assert position(1, 9, 4) == {"start": 1, "gap": True, "oldest_available_cursor": 3}
    assert position(3, 9, 4) == {"start": 3} and position(0, 9, 4) == {"start": 0}
    assert position(2, 9, 0)["oldest_available_cursor"] == 9
    assert next_cursor([], 4) == 4 and next_cursor([5, 8], 4) == 8


@pytest.fixture(scope="module")
def engine(spark, small):
    now = spark.read.parquet(f"{small}/stock_trades.parquet").agg({"ts_us": "max"}).first()[0]
    return api.Engine(spark, small, now, interest=["aapl "], watchlist=["SEVI"])


def test_api_rejects(engine):
    bad = [
        (lambda: engine.recent_news(limit=201), "limit_exceeded"), (lambda: engine.recent_news(fields="all"), "invalid_fields"), (lambda: engine.search_news("x", since="soon"), "invalid_date"),
        (lambda: engine.alerts_since(severity="high", min_severity="low"), "conflicting_filters"), (lambda: engine.alerts(severity="huge"), "invalid_severity"), (lambda: engine.alerts(categories=["nope"]), "invalid_categories"),
        (lambda: engine.bars("A", "2min"), "invalid_timeframe"), (lambda: engine.tape_stats("A", 240, 10), "too_many_buckets"), (lambda: engine.news_since(10**12), "cursor_out_of_range"),
        (lambda: engine.symbol_context([" "]), "no_symbols"), (lambda: engine.set_interest(["A"], "toggle"), "invalid_mode"), (lambda: engine.most_actives("size"), "invalid_by"),
        (lambda: engine.set_keyword_group("g", ["x" * 201]), "limit_exceeded"), (lambda: engine.trades_window("A", 241), "limit_exceeded"),
    ]
    for call, code in bad:
        with pytest.raises(api.RequestError) as e:
            call()
        assert e.value.code == code


def test_api_answers(engine, spark):
    symbol = engine.rows("stock_trades").groupBy("symbol").count().orderBy("count", ascending=False).first()["symbol"]
    for df in (
        engine.recent_news(10_000, fields="full", include_raw=True), engine.article(1), engine.versions(1), engine.search_news("guidance", until="2030-01-01"), engine.news_for_symbols([symbol], 100_000), engine.breaking_digest(100_000),
        engine.symbol_map(10_080), engine.news_pulse([symbol, "ZZZ"], 100_000), engine.news_pulse(minutes=100_000), engine.raw_events(), engine.alerts(), engine.trades_window(symbol, 240), engine.quotes_window(symbol, 240), engine.bars(symbol, "15min"),
        engine.halts(), engine.bands(), engine.symbol_context([symbol]), engine.tape_stats(symbol, 120), engine.watchlist_pulse(240, [symbol, "ZZZ"]), engine.latest([symbol, "ZZZ"]), engine.movers(), engine.most_actives("trades"), engine.market_pulse(),
    ):
        assert df.collect() is not None
    assert [r.symbol for r in engine.watchlist_pulse(240, [symbol, "ZZZ"]).collect()] == sorted([symbol, "ZZZ"])
    assert {r.symbol: r.missing for r in engine.latest(["ZZZ"]).collect()} == {"ZZZ": ["trade", "quote", "bar"]}
    page = engine.bars_since(1, limit=5)
    assert page["rows"].count() == 5 and page["has_more"] and page["next_cursor"] == max(r.seq for r in page["rows"].collect())
    assert engine.news_since(-1)["rows"].count() == 0
    assert engine.latency_stats(100_000)["sample_count"] > 0 and engine.ingestion_stats(100_000)["articles"] > 0
    assert engine.poll(news_cursor=10**12)["news"]["error"] == "cursor_out_of_range"
    assert engine.loop_context(problems=["news_disconnected"])["suggested_next_poll_seconds"] <= 900
    assert set(engine.started()) == {"news_cursor", "alerts_cursor", "bars_cursor"}


def test_managed_state(engine):
    assert engine.set_interest(["b", "A"], "add") == ["A", "AAPL", "B"] and engine.set_interest(["a"], "remove") == ["AAPL", "B"] and engine.set_interest([], "clear") == []
    engine.set_keyword_group("Chips", ["Fab"], critical_phrases=["Outage"])
    assert {g["group"]: g["category"] for g in engine.keyword_groups()}["chips"] == "custom_keyword"
    assert engine.delete_keyword_group("chips") and not engine.delete_keyword_group("chips")
    engine.watch_story(5)
    assert engine.watched_stories().count() == 1 and engine.unwatch_story(5) and not engine.unwatch_story(5)


def test_calendar_rules_out_holidays(engine, spark):
    day = 86_400_000_000
    now = engine.as_of_us
    far = spark.createDataFrame([(now + 3 * day, now + 3 * day + 1000)], "open_us long, close_us long")
    assert engine.clock(far)["phase"] == "closed" and engine.clock(far)["seconds_to_open"] == 3 * 86_400
    here = spark.createDataFrame([(now - 1000, now + 5_000_000)], "open_us long, close_us long")
    assert engine.clock(here) | {} and engine.clock(here)["is_open"] and engine.clock(here)["seconds_to_close"] == 5


def test_migration_adds_columns_once(spark):
    old = spark.createDataFrame([("a",)], "alert_id string")
    new = migrate("alerts", migrate("alerts", old)).first()
    assert (new.direction, new.content_hash, new.seq) == ("neutral", None, None)


def test_stream_suppression(spark, tmp_path):
    from tidemark.streaming.feeds import drain_to_table
    from tidemark.streaming.quotas import stream_leading_edge, stream_within_quota

    spark.createDataFrame([("a", 9000), ("a", 9100), ("a", 9300), ("b", 9005)], "k string, at long").coalesce(1).write.parquet(f"{tmp_path}/e")
    edge = stream_leading_edge(spark.readStream.schema("k string, at long").parquet(f"{tmp_path}/e"), "k", "at", 300)
    assert sorted((r.key, r.at) for r in drain_to_table(edge, f"{tmp_path}/h1").collect()) == [("a", 9000), ("a", 9300), ("b", 9005)]
    schema = "alert_id string, category string, severity string, symbols array<string>, at long"
    for part in ([("1", "c", "high", ["S"], 0), ("2", "c", "high", ["S"], 1)], [("3", "c", "high", ["S"], 2), ("4", "c", "critical", ["S"], 3), ("5", "c", "high", ["S"], 4000)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
    quota = stream_within_quota(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/q"), "at", limit=2)
    assert sorted(r.alert_id for r in drain_to_table(quota, f"{tmp_path}/h2").collect()) == ["1", "2", "4", "5"]


def test_health_alerts_once_in_a_while():
    from tidemark.streaming.health import StreamHealth

    h = StreamHealth()
    assert h.note("s", "stream_error", "high", "x", 0.0) and not h.note("s", "stream_error", "high", "x", 899.0) and h.note("s", "stream_error", "high", "x", 900.0)


def test_infrastructure_alerts():
    from tidemark.streaming.health import StreamHealth, infrastructure_alert

    made = {
        ("stream_error", 402): infrastructure_alert("stream_error", "news", code=402, message="auth failed"), ("entitlement_error", 1): infrastructure_alert("entitlement_error", "news", code=1, message="no"),
        ("stream_stale", 0): infrastructure_alert("stream_stale", "stocks", idle_seconds=130.4), ("gap_fill_failure", 0): infrastructure_alert("gap_fill_failure", "news", attempt=2, exhausted=False, error="x"),
        ("gap_fill_failure", 1): infrastructure_alert("gap_fill_failure", "news", attempt=5, exhausted=True, error="x"), ("persist_failure", 0): infrastructure_alert("persist_failure", "news", batch_size=7, error="full"),
        ("coverage_gap", 0): infrastructure_alert("coverage_gap", "news", start="a", end="b"),
    }
    assert [m["severity"] for m in made.values()] == ["critical", "high", "high", "high", "critical", "critical", "medium"]
    assert all(m["category"] == k for (k, _), m in made.items()) and "7 item(s)" in made["persist_failure", 0]["reason"] and "130s" in made["stream_stale", 0]["reason"]
    assert {m["category"] for m in made.values()} <= set(api.ALERT_CATEGORIES)
    h = StreamHealth()
    assert h.raise_alert("persist_failure", "news", 0.0, batch_size=1, error="x") and not h.raise_alert("persist_failure", "news", 10.0, batch_size=1, error="x") and len(h.alerts) == 1


def test_history_and_backfill_by_the_engine(spark, small, tmp_path):
    import json

    from tidemark.streaming import publish

    now = 1_641_600_000_000_000  # 2022-01-08
    engine = api.Engine(spark, small, now, interest=["ACME"])
    item = lambda i, day, **more: {"id": i, "headline": "Acme faces fraud probe", "symbols": ["ACME"], "created_at": f"2022-01-{day:02d}T10:00:00Z", **more}
    pages = lambda *rows: spark.createDataFrame([(json.dumps(x), 0) for x in rows], "value string, page int")
    articles = publish.Published(spark, f"{tmp_path}/news", publish.ARTICLES, ["id"])
    alerts = publish.Published(spark, f"{tmp_path}/alerts", publish.ALERTS, ["alert_id"])
    out = engine.fetch_history(articles, pages(item(1, 7), item(2, 1), item(3, 7, symbols=["X"])), 0, ["acme"], days=3)
    assert (out["symbols"], out["ingested"], out["new"], out["status"]) == (["ACME"], 1, 1, "ok") and alerts.read().count() == 0
    engine.watch_story(1)
    out = engine.run_backfill(articles, alerts, pages(item(1, 7, updated_at="2022-01-07T12:00:00Z", headline="Acme settles"), item(4, 7), {"id": "?"}), 1, minutes=2880)
    assert (out["new"], out["updated"], out["failed"], out["status"]) == (1, 1, 1, "incomplete")
    stored = {(r.article_id, r.category): r for r in alerts.read().collect()}
    assert {(4, "legal_regulatory_keyword"), (4, "held_or_interested_symbol"), (None, "watched_story_update")} <= set(stored) and not any(c == "high_latency" for _, c in stored)
    seen = stored[4, "legal_regulatory_keyword"].alert_id
    assert engine.acknowledge(alerts, seen) and not engine.acknowledge(alerts, "nope") and alerts.read().filter("acknowledged").count() == 1
    bad = [
        (lambda: engine.fetch_history(articles, pages(), 2, [" "]), "no_symbols"), (lambda: engine.fetch_history(articles, pages(), 2, ["A"], days=0), "invalid_days"), (lambda: engine.fetch_history(articles, pages(), 2, ["A"], max_articles=501), "limit_exceeded"),
        (lambda: engine.fetch_history(articles, pages(), 2, list("ABCDEF")), "limit_exceeded"), (lambda: engine.run_backfill(articles, alerts, pages(), 2, 0), "invalid_minutes"), (lambda: engine.resource("nothing"), "unknown_resource"), (lambda: engine.snapshots([]), "no_symbols"),
    ]
    for call, code in bad:
        with pytest.raises(api.RequestError) as e:
            call()
        assert e.value.code == code


def test_resources_and_subscription(engine):
    for path in ("recent", "alerts", "symbols", "symbols/SEVI", "article/1", "stats/latency", "stats/ingestion", "subscription", "watchlist", "latest/SEVI", "clock", "halts"):
        got = engine.resource(path)
        assert isinstance(got, dict) or got.limit(1).collect() is not None
    state = engine.subscription({"trades": ["SEVI"], "news": ["*"]})
    assert state["requested"]["trades"] == ["SEVI"] and state["missing"]["trades"] == [] and state["missing"]["quotes"] == ["SEVI"] and state["missing"]["news"] == []


def test_index_and_scan_give_the_same_scores(spark, tmp_path):
    from tidemark.operators import search

    rows = [(1, "Copper prices rise", None, "copper, copper everywhere"), (2, "Wires", "state-of-the-art copper", "the art of state"), (3, None, None, None), (4, "Coppers", "", "state of art")]
    df = spark.createDataFrame(rows, "id long, headline string, summary string, content_text string")
    index = search.TermIndex(spark, f"{tmp_path}/index").build(df)
    for query in ("copper", "copper prices", "state-of-the-art", "art-of", "nothing", "copper nothing", "", "...", "the state"):
        short = lambda d: {r.id: round(r.score, 9) for r in d.collect()}
        assert short(index.scores(query)) == short(search.scores(df, query)), query
