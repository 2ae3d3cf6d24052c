"""Registered queries that go through the query surface, the feeds and the published tables, with their SQL.

"Now" is the newest arrival of an article for news and the newest trade for the market. The busiest symbol is the one with most
trades; feeds that the test data lacks are made from its tables: statuses, raw events and corporate actions from
``events``, price bands from daily bars, frames from trades, quotes, bars and articles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.api import Engine
from tidemark.functions.sessions import exchange_day, market_phase
from tidemark.functions.text import content_hash, symbol_list
from tidemark.functions.times import DAY_US, instant_us
from tidemark.operators import alerts, ingest, retention, search, triggers, upsert
from tidemark.operators import bars as bar_ops
from tidemark.plans import market, news
from tidemark.plans.problems import sql_instant_us
from tidemark.sources import frames
from tidemark.sources.tables import table
from tidemark.streaming import publish
from tidemark.streaming.feeds import workspace

MINUTE_US = 60_000_000
ALWAYS = 1_000_000
BATCHES = 3


# -- tables the test data lacks


def _raw_events(spark: SparkSession, d: str) -> DataFrame:
    """Events as raw frames; clicks are cut off, so they are no JSON, views were set aside, every third of those replayed."""
    e = table(spark, d, "events")
    body = F.when(F.col("event_type") == "click", F.substring("props", 1, 4)).otherwise(F.col("props"))
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("received_at"),
        F.when(F.col("event_type") == "view", "queue_overflow_drop").otherwise("stream").alias("endpoint"), F.col("event_type").alias("message_type"),
        body.alias("raw_json"), ((F.col("event_type") == "view") & (F.col("event_id") % 3 == 0)).alias("replayed"),
    )


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    """Statuses with texts: errors are halts, signups resumptions, purchases a message without code."""
    e = table(spark, d, "events").filter(F.col("event_type").isin("error", "signup", "purchase"))
    of = lambda error, signup, other: F.when(F.col("event_type") == "error", error).when(F.col("event_type") == "signup", signup).otherwise(other)
    return e.select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), instant_us(F.col("ts").cast("string")).alias("ts_us"), of(F.lit("H"), F.lit("T"), F.lit("")).alias("status_code"),
        of(F.lit("Halted"), F.lit(None), F.lit("Volatility Pause")).alias("status_msg"), of(F.lit("T1"), F.lit("T2"), F.lit(None)).alias("reason_code"),
        of(F.lit(None), F.lit("News released"), F.lit(None)).alias("reason_msg"), F.lit("A").alias("tape"), "event_id",
    )


def _bands(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "stock_bars").filter("timeframe = '1day'")
    return days.select("symbol", (F.col("ts") * 1_000_000).alias("ts_us"), F.col("high").alias("limit_up"), F.col("low").alias("limit_down"), F.when(F.col("seq") % 2 == 0, "B").alias("indicator"), F.lit("A").alias("tape"), "seq")


def _stored_alerts(spark: SparkSession, d: str) -> DataFrame:
    """All alerts of all articles as rows of the alert store, numbered by article and category."""
    found = news.keyword_alert_rows(spark, d)
    facts = table(spark, d, "news_articles").select(F.col("id").alias("article_id"), "headline", instant_us("first_seen_at").alias("created_us"), content_hash(F.col("headline"), F.col("summary"), F.col("content_html")).alias("content_hash"))
    rows = found.join(facts, "article_id").withColumn("alert_id", F.concat(F.col("article_id").cast("string"), F.lit("-"), "category"))
    return rows.select("alert_id", "article_id", "created_us", "severity", "category", "symbols", "headline", "reason", "content_hash", "direction")


def _engine(spark: SparkSession, d: str, feed: str = "news", **more: DataFrame) -> Engine:
    now = news.newest_arrival(spark, d) if feed == "news" else market.newest_value(table(spark, d, "stock_trades"), "ts_us") if feed == "market" else market.newest_value(table(spark, d, "events").select(instant_us(F.col("ts").cast("string")).alias("t")), "t")
    return Engine(spark, d, now, extra=more)


def _busiest(spark: SparkSession, d: str, most: int = 1) -> list[str]:
    """The symbols with most trades, at most ``most`` of them."""
    rows = table(spark, d, "stock_trades").groupBy("symbol").count().orderBy(F.desc("count"), "symbol").limit(most)
    return [r["symbol"] for r in rows.collect()]


def _row(spark: SparkSession, values: dict[str, object], schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(values[c.split()[0]] for c in schema.split(", "))], schema)


# -- news


def surface_recent(spark: SparkSession, d: str) -> DataFrame:
    """recent_news: the newest 200 articles of a day, compact."""
    return _engine(spark, d).recent_news(1440, limit=200, fields="compact").withColumn("symbols", F.array_join("symbols", ","))


def surface_recent_of(spark: SparkSession, d: str) -> DataFrame:
    """recent_news of some sources and symbols."""
    sources = [r["s"] for r in table(spark, d, "news_articles").filter("trim(source) <> ''").groupBy(F.lower(F.trim("source")).alias("s")).count().orderBy(F.desc("count"), "s").limit(2).collect()]
    return _engine(spark, d).recent_news(ALWAYS, _busiest(spark, d, 3), [f" {s.upper()} " for s in sources], 200, "full").select("id", "headline", "update_count", "content_text")


def surface_page(spark: SparkSession, d: str) -> DataFrame:
    """news_since: a page of articles of the three busiest symbols."""
    return _engine(spark, d).news_since(1, 500, _busiest(spark, d, 3))["rows"].select("id", "seq", "has_more")


def surface_position(spark: SparkSession, d: str) -> DataFrame:
    """What a poll of a symbol's feed gets to know: a gap, since rows before its first one are gone."""
    out = _engine(spark, d).news_since(1, 10, _busiest(spark, d))
    return _row(spark, {"gap": False, "oldest_available_cursor": None, **out}, "gap boolean, oldest_available_cursor long, latest_cursor long, next_cursor long, has_more boolean")


def surface_article(spark: SparkSession, d: str) -> DataFrame:
    """article: the one with the greatest id."""
    rows = _engine(spark, d).article(market.newest_value(table(spark, d, "news_articles"), "id"), include_raw=True)
    return rows.withColumn("symbols", F.array_join("symbols", ","))


def surface_versions(spark: SparkSession, d: str) -> DataFrame:
    """versions: the newest 200 of the article that has most."""
    most = table(spark, d, "news_article_versions").groupBy("article_id").count().orderBy(F.desc("count"), "article_id").first()
    return _engine(spark, d).versions(most["article_id"] if most else 0, 200).select("version_id", "headline", "received_us")


def surface_search(spark: SparkSession, d: str) -> DataFrame:
    """search_news: ranked by scores in all articles, in a range of days."""
    engine = _engine(spark, d)
    rows = engine.search_news("copper revenues", since="2022-01-04", until="2022-01-05", limit=200)
    return rows.select("id", "headline")


def surface_search_index(spark: SparkSession, d: str) -> DataFrame:
    """The scores of all articles with both terms, from a term index built beforehand."""
    index = search.TermIndex(spark, workspace(spark, "term-index")).build(news.spread_texts(spark, d))
    return index.scores("copper revenues").select("id", F.round("score", 6).alias("score"))


def surface_for_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d).news_for_symbols(_busiest(spark, d, 5), ALWAYS, 10)


def surface_digest(spark: SparkSession, d: str) -> DataFrame:
    """breaking_digest over the newest 200 articles."""
    return _engine(spark, d).breaking_digest(ALWAYS).select("id", "headline", "summary")


def surface_symbol_map(spark: SparkSession, d: str) -> DataFrame:
    """symbol_map of the last two days."""
    return _engine(spark, d).symbol_map(2880, 2, 500)


def surface_news_pulse(spark: SparkSession, d: str) -> DataFrame:
    """news_pulse of the 20 busiest symbols, with alerts by category and direction."""
    out = _engine(spark, d, alerts=_stored_alerts(spark, d)).news_pulse(minutes=ALWAYS, top=20)
    return out.select("symbol", "articles", "latest_headline", "latest_us", F.coalesce(F.try_element_at("alerts", F.lit("mna_keyword")), F.lit(0)).alias("mna_alerts"), "bullish", "bearish", "neutral")


def surface_latency(spark: SparkSession, d: str) -> DataFrame:
    return _row(spark, _engine(spark, d).latency_stats(ALWAYS), "sample_count long, max_ms long, avg_ms long, p50_ms long, p90_ms long, p99_ms long")


def surface_counts(spark: SparkSession, d: str) -> DataFrame:
    """ingestion_stats of the last day, raw events included."""
    engine = _engine(spark, d, raw_events=_raw_events(spark, d))
    return _row(spark, engine.ingestion_stats(1440), "articles long, versions long, symbols long, sources long, raw_events long")


def surface_raw(spark: SparkSession, d: str) -> DataFrame:
    """raw_events: the newest 500 of a day, parsed where they are JSON."""
    rows = _engine(spark, d, "events", raw_events=_raw_events(spark, d)).raw_events(1440, 500)
    return rows.select("event_id", "raw_json", F.try_variant_get("parsed", "$.k", "long").alias("k"), F.col("parsed").isNotNull().alias("is_json"))


def surface_replay(spark: SparkSession, d: str) -> DataFrame:
    """The oldest 100 events that were set aside and not replayed."""
    return ingest.to_replay(_raw_events(spark, d)).select("event_id", "received_at")


def surface_replayed(spark: SparkSession, d: str) -> DataFrame:
    """Raw events by endpoint and flag, after those 100 were replayed."""
    rows = _raw_events(spark, d)
    return ingest.mark_replayed(rows, ingest.to_replay(rows)).groupBy("endpoint", "replayed").agg(F.count(F.lit(1)).alias("n"))


def surface_status_keys(spark: SparkSession, d: str) -> DataFrame:
    """The last value of each status key."""
    e = table(spark, d, "events").select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value_json"), F.struct("ts", "event_id").alias("updated_at"))
    return ingest.latest_status(e).select("key", "value_json", F.col("updated_at.event_id").alias("event_id"))


# -- alerts


def surface_alerts(spark: SparkSession, d: str) -> DataFrame:
    """alerts: the newest 500 critical ones of two categories."""
    engine = _engine(spark, d, alerts=_stored_alerts(spark, d).withColumn("seq", F.col("article_id")))
    return engine.alerts(ALWAYS, "critical", ["legal_regulatory_keyword", "halt_risk_keyword"], limit=500).select("alert_id", "severity", "reason")


def surface_alerts_of(spark: SparkSession, d: str) -> DataFrame:
    """alerts of the three busiest symbols."""
    engine = _engine(spark, d, alerts=_stored_alerts(spark, d).withColumn("seq", F.col("article_id")))
    return engine.alerts(ALWAYS, symbols=_busiest(spark, d, 3), categories=["mna_keyword"], limit=500).select("alert_id")


def surface_alerts_page(spark: SparkSession, d: str) -> DataFrame:
    """alerts_since: a page of alerts of high severity or above after half of all numbers."""
    rows = _stored_alerts(spark, d).filter("category = 'earnings_keyword'").withColumn("seq", F.col("article_id"))
    engine = _engine(spark, d, alerts=rows)
    return engine.alerts_since(market.newest_value(rows, "seq") - 1000, 500, min_severity="high")["rows"].select("alert_id", "seq", "has_more")


def alert_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The reason text of every alert."""
    return news.keyword_alert_rows(spark, d).select("article_id", "category", "reason")


def alerts_acknowledged(spark: SparkSession, d: str) -> DataFrame:
    """Alerts by flag after those of every fifth article were acknowledged, some of them twice."""
    rows = _stored_alerts(spark, d).withColumn("acknowledged", F.lit(False))
    acks = rows.filter("article_id % 5 = 0").select("alert_id")
    return ingest.acknowledged(rows, acks.unionAll(acks)).groupBy("acknowledged").agg(F.count(F.lit(1)).alias("n"))


def alert_store(spark: SparkSession, d: str) -> DataFrame:
    """The alerts that a store keeps which gets them in batches by day of arrival."""
    rows = _stored_alerts(spark, d).filter("created_us IS NOT NULL")
    store = publish.Published(spark, workspace(spark, "alerts"), publish.ALERTS, ["alert_id"])
    edge = rows.agg(F.min("created_us").alias("a"), F.max("created_us").alias("b")).first()
    cut = [edge["a"] + (edge["b"] - edge["a"]) * i // BATCHES for i in range(BATCHES)] if edge["a"] is not None else []
    for n, (low, high) in enumerate(zip(cut, [*cut[1:], edge["b"] + 1 if cut else 0], strict=True)):
        publish.insert_alerts(store, rows.filter(F.col("created_us").between(low, high - 1)), n)
    return store.read().select("alert_id", "created_us")


def status_alert_rows(spark: SparkSession, d: str) -> DataFrame:
    """Halts and resumptions; even users are watched."""
    rows = _statuses(spark, d)
    watched = rows.filter("cast(substring(symbol, 2) as long) % 2 = 0").select("symbol").distinct()
    return alerts.status_alerts(rows, watched).select("symbol", "ts_us", "category", "severity", "reason")


def band_alert_rows(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of price bands, repeats within two days held back."""
    return alerts.quieted(alerts.band_alerts(_bands(spark, d)), 2 * 86_400).select("symbol", "ts_us", "category", "severity", "reason")


def trigger_alert_rows(spark: SparkSession, d: str) -> DataFrame:
    """All triggers as alerts; the busiest symbol is watched."""
    found = triggers.triggers(table(spark, d, "stock_bars").filter("timeframe = '1min'"), market.RULE)
    watched = spark.createDataFrame([(s,) for s in _busiest(spark, d)], "symbol string")
    return alerts.trigger_alerts(found, watched).select("symbol", "ts_us", "category", "severity", "direction", F.regexp_replace("reason", r"\(.*\)", "").alias("reason"))


def story_alert_rows(spark: SparkSession, d: str) -> DataFrame:
    """Alerts of changes to the content of watched stories: the articles whose id is divisible by 20."""
    states = upsert.apply_updates(news.version_feed(spark, d), ["received_us", "version_id"])
    watched = [r["id"] for r in states.filter("id % 20 = 0").select("id").distinct().orderBy("id").limit(50).collect()]
    return alerts.watched_story_alerts(states, watched).select("headline", "reason", "received_at")


# -- articles in the store


def article_merge(spark: SparkSession, d: str) -> DataFrame:
    """The articles after their first delivery and all versions were applied: fields kept, overwritten, frozen."""
    states = upsert.apply_updates(_mixed_feed(spark, d), ["received_us", "version_id"])
    out = upsert.current(states).select("id", "headline", "symbols", "summary", "author", "created_at", "updated_at", "content_html", "content_text", "url", "source", "latency_ms", "is_content_present", "update_count", "first_seen_at", "last_seen_at")
    return out.withColumn("symbols", F.array_join("symbols", ","))


def merged_index(spark: SparkSession, d: str) -> DataFrame:
    """The symbol index that follows from them."""
    return upsert.symbol_index(upsert.current(upsert.apply_updates(_mixed_feed(spark, d), ["received_us", "version_id"]))).select("symbol", "article_id", "received_at")


def symbol_changes(spark: SparkSession, d: str) -> DataFrame:
    """Symbols that an article's last state has and its first has not, and the other way round."""
    states = upsert.apply_updates(_mixed_feed(spark, d), ["received_us", "version_id"])
    ends = states.filter("was_new").select("id", F.col("symbols").alias("_a")).join(upsert.current(states).select("id", F.col("symbols").alias("_b")), "id")
    both = ends.select("id", F.array_join(F.array_sort(F.array_except("_b", "_a")), ",").alias("added"), F.array_join(F.array_sort(F.array_except("_a", "_b")), ",").alias("removed"))
    return both.filter("added <> '' OR removed <> ''")


def ingest_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How many deliveries were new, changed an article, or repeated it."""
    return ingest.outcomes(upsert.apply_updates(_mixed_feed(spark, d), ["received_us", "version_id"]))


def _mixed_feed(spark: SparkSession, d: str) -> DataFrame:
    """Versions as updates, after the article's row; odd versions carry the symbols without their last one, the others all."""
    a = table(spark, d, "news_articles").select(
        "id", "headline", symbol_list("symbols_json").alias("symbols"), "summary", "author", "created_at", "updated_at", "content_html", "content_text", "url", "source",
        F.col("first_seen_at").alias("received_at"), "latency_ms", "is_content_present", F.lit(None).cast("long").alias("received_us"), F.lit("").alias("version_id"),
    )
    symbols = a.select("id", F.col("symbols").alias("_all"))
    v = news.version_feed(spark, d).join(symbols, "id")
    odd = F.ascii(F.substring("version_id", -1, 1)) % 2 == 1
    v = v.withColumn("symbols", F.when(odd, F.slice("_all", 1, F.greatest(F.size("_all") - 1, F.lit(0)))).otherwise(F.col("_all"))).drop("_all")
    return a.unionByName(v)


def published_articles(spark: SparkSession, d: str) -> DataFrame:
    """The published articles after the versions came in batches by arrival."""
    rows = news.version_feed(spark, d).withColumn("raw_json", F.lit("{}")).withColumn("is_content_present", F.col("is_content_present") == 1)
    rows = rows.withColumn("arrival", F.row_number().over(publish.Window.partitionBy("id").orderBy("received_us", "version_id")).cast("long"))
    store = publish.Published(spark, workspace(spark, "articles"), publish.ARTICLES, ["id"])
    edge = rows.agg(F.min("received_us").alias("a"), F.max("received_us").alias("b")).first()
    for n in range(BATCHES):
        low, high = (edge["a"] + (edge["b"] + 1 - edge["a"]) * i // BATCHES for i in (n, n + 1))
        publish.upsert_articles(store, rows.filter((F.col("received_us") >= low) & (F.col("received_us") < high)), n)
    return store.read().select("id", "headline", "summary", "updated_at", "source", "update_count", "first_seen_at", "last_seen_at")


# -- market


def surface_trades(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d, "market").trades_window(_busiest(spark, d)[0], 240, 1000)


def surface_quotes(spark: SparkSession, d: str) -> DataFrame:
    return _engine(spark, d, "market").quotes_window(_busiest(spark, d)[0], 240, 1000)


def surface_bars(spark: SparkSession, d: str) -> DataFrame:
    """bars: quarter hours of the busiest symbol in a range of days."""
    rows = _engine(spark, d, "market").bars(_busiest(spark, d)[0].lower(), "15min", "2022-01-03", "2022-01-05T20:00:00Z", 1000)
    return market.rounded(rows, "vwap")


def surface_bars_page(spark: SparkSession, d: str) -> DataFrame:
    """bars_since: a page of minute bars of two symbols after half of all numbers."""
    engine = _engine(spark, d, "market")
    half = market.newest_value(table(spark, d, "stock_bars"), "seq") // 2
    return engine.bars_since(half, _busiest(spark, d, 2), "1min", 2000)["rows"].select("symbol", "ts", "close", "seq", "has_more")


def surface_halts(spark: SparkSession, d: str) -> DataFrame:
    """halts: the newest 200 statuses of a day."""
    return _engine(spark, d, "events", stock_statuses=_statuses(spark, d)).halts(1440, limit=200).select("symbol", "ts_us", "status_code", "event_id")


def surface_bands(spark: SparkSession, d: str) -> DataFrame:
    """bands of the three busiest symbols."""
    return _engine(spark, d, "market", stock_lulds=_bands(spark, d)).bands(ALWAYS, _busiest(spark, d, 3), 200).select("symbol", "ts_us", "limit_up", "limit_down", "indicator")


def surface_tape(spark: SparkSession, d: str) -> DataFrame:
    """tape_stats: minutes of the busiest symbol."""
    return market.rounded(_engine(spark, d, "market").tape_stats(_busiest(spark, d)[0], 240, 60, 500), "vwap", "spread_bps", "bid_fraction")


def surface_pulse(spark: SparkSession, d: str) -> DataFrame:
    """watchlist_pulse of five symbols and one that is unknown."""
    out = _engine(spark, d, "market").watchlist_pulse(240, [*_busiest(spark, d, 5), "unknown"])
    return market.rounded(out, "spread_bps", "chg_pct")


def surface_latest(spark: SparkSession, d: str) -> DataFrame:
    """latest: with what is missing."""
    out = _engine(spark, d, "market").latest([*_busiest(spark, d, 5), "unknown"])
    return out.select("symbol", "trade_us", "price", "quote_us", "bid_price", "bar_ts", F.round(F.col("age_s") + 1e-9, 6).alias("age_s"), "stale", F.array_join("missing", ",").alias("missing"))


def surface_snapshots(spark: SparkSession, d: str) -> DataFrame:
    out = _engine(spark, d, "market").snapshots(_busiest(spark, d, 20))
    return out.select("symbol", F.col("latest_trade.price").alias("price"), F.col("latest_quote.ask_price").alias("ask_price"), F.col("minute_bar.close").alias("minute_close"), F.col("daily_bar.ts").alias("day_ts"), F.col("daily_bar.close").alias("day_close"), F.col("prev_daily_bar.close").alias("before_close"))


def surface_actives(spark: SparkSession, d: str) -> DataFrame:
    """most_actives by trades."""
    return _engine(spark, d, "market").most_actives("trades", 20).select("symbol", "trade_count")


def surface_calendar(spark: SparkSession, d: str) -> DataFrame:
    """calendar: the exchange days of the bars from the fourth of January on."""
    days = table(spark, d, "stock_bars").filter("timeframe = '1min'").select(exchange_day(F.col("ts")).cast("string").alias("date")).distinct()
    return _engine(spark, d, "market").calendar(days, "2022-01-04", "2022-01-31")


def surface_actions(spark: SparkSession, d: str) -> DataFrame:
    """corporate_actions: two types in a range of days, newest first."""
    e = table(spark, d, "events")
    actions = e.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("symbol"), F.col("event_type").alias("type"), F.date_format("ts", "yyyy-MM-dd").alias("date")).distinct()
    first = e.agg(F.min("ts").cast("date").cast("string").alias("a"), F.date_add(F.min("ts"), 3).cast("string").alias("b")).first()
    return _engine(spark, d, "events").corporate_actions(actions, types=[" Purchase", "view"], start=first["a"], end=first["b"], limit=200).select("symbol", F.col("type"), "date")


def surface_started(spark: SparkSession, d: str) -> DataFrame:
    """started: the cursors to start from."""
    return _row(spark, _engine(spark, d).started(), "news_cursor long, alerts_cursor long, bars_cursor long")


def event_phases_holidays(spark: SparkSession, d: str) -> DataFrame:
    """The phase of every event's instant where every third day of the month is a holiday."""
    timed = table(spark, d, "events").withColumn("_s", F.floor(instant_us(F.col("ts").cast("string")) / 1_000_000))
    trading = F.dayofmonth(exchange_day(F.col("_s"))) % 3 != 0
    return timed.select("event_id", market_phase(F.col("_s"), trading).alias("phase"))


def fetched_bars(spark: SparkSession, d: str) -> DataFrame:
    """Five minutes from fetched bars, of which every seventh lacks its close and every fifth its volume."""
    rows = table(spark, d, "stock_bars").filter("timeframe = '1min'")
    rows = rows.withColumn("close", F.when(F.col("seq") % 7 != 0, F.col("close"))).withColumn("volume", F.when(F.col("seq") % 5 != 0, F.col("volume")))
    return market.rounded(bar_ops.rebucket_present(rows, 300), "vwap")


def gap_starts(spark: SparkSession, d: str) -> DataFrame:
    """From when each symbol's bars are fetched again after a gap, one unknown symbol included."""
    rows = table(spark, d, "stock_bars")
    wanted = rows.select("symbol").distinct().unionAll(spark.createDataFrame([("UNKNOWN",)], "symbol string"))
    return ingest.fill_starts(wanted, rows, market.newest_value(rows.filter("timeframe = '1min'"), "ts") + 600)


def news_gap_start(spark: SparkSession, d: str) -> DataFrame:
    """From when articles are fetched again after a gap."""
    return ingest.news_start(news.timed_articles(spark, d), news.newest_arrival(spark, d))


def gap_rows(spark: SparkSession, d: str) -> DataFrame:
    """Fetched bars that are kept: those at or after their own symbol's start."""
    rows = table(spark, d, "stock_bars").filter("timeframe = '1min'")
    starts = ingest.fill_starts(rows.select("symbol"), rows, market.newest_value(rows, "ts"), most_s=3600)
    return ingest.since_own_start(rows, starts).select("symbol", "ts", "close")


def added_backfill(spark: SparkSession, d: str) -> DataFrame:
    """From when the bars of symbols new on the watchlist are fetched."""
    wanted = spark.createDataFrame([(s,) for s in _busiest(spark, d, 5)], "symbol string")
    return ingest.added_starts(wanted, market.newest_value(table(spark, d, "stock_bars").filter("timeframe = '1min'"), "ts"))


def tick_retention(spark: SparkSession, d: str) -> DataFrame:
    """Ticks and bars that stay if ticks are kept for 240 minutes and bars for two days."""
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
    now = market.newest_value(table(spark, d, "stock_trades"), "ts_us")
    out = count(retention.keep_since(table(spark, d, "stock_trades"), "ts_us", now - 240 * MINUTE_US), "stock_trades")
    out = out.unionAll(count(retention.keep_since(table(spark, d, "stock_quotes"), "ts_us", now - 240 * MINUTE_US), "stock_quotes"))
    return out.unionAll(count(retention.keep_since(table(spark, d, "stock_bars"), "ts", (now - 2 * DAY_US) // 1_000_000), "stock_bars"))


def published_bars(spark: SparkSession, d: str) -> DataFrame:
    """The published bars after all came twice in batches of days, every fifth the second time with another close."""
    rows = table(spark, d, "stock_bars").select("symbol", "timeframe", "ts", *bar_ops.BAR_VALUES, F.col("seq").alias("arrival"))
    again = rows.withColumn("close", F.when(F.col("arrival") % 5 == 0, F.col("close") + 1.0).otherwise(F.col("close")))
    store = publish.Published(spark, workspace(spark, "bars"), "symbol string, timeframe string, ts long, " + ", ".join(f"{c} {'long' if c in ('volume', 'trade_count') else 'double'}" for c in bar_ops.BAR_VALUES) + ", seq long", publish.BAR_KEY, part=F.expr("ts div 86400"))
    for n, part in enumerate((rows.filter("arrival % 2 = 0"), rows.filter("arrival % 2 = 1"), again)):
        publish.upsert_bars(store, part, n)
    return store.read().select("symbol", "timeframe", "ts", "close", "volume")


def published_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the market store after a batch was delivered twice and a day was dropped."""
    store = publish.MarketStore(spark, workspace(spark, "market"))
    tables = {"trades": table(spark, d, "stock_trades"), "quotes": table(spark, d, "stock_quotes"), "statuses": _statuses(spark, d), "bands": _bands(spark, d)}
    for n in (0, 0, 1):
        store.insert({k: v.filter(F.pmod("ts_us", F.lit(2)) == n) for k, v in tables.items()}, n)
    store.keep_since("trades", market.newest_value(tables["trades"], "ts_us") - DAY_US)
    parts = [store.read(k).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ts_us") % 1_000_003).alias("checksum")).select(F.lit(k).alias("table_name"), "n", "checksum") for k in tables]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


# -- feeds


def _iso(us: str) -> F.Column:
    return F.date_format(F.timestamp_micros(F.col(us)), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def feed_trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades from frames of JSON arrays."""
    t = table(spark, d, "stock_trades")
    body = F.struct(F.lit("t").alias("T"), F.lower("symbol").alias("S"), _iso("ts_us").alias("t"), F.col("price").alias("p"), F.col("size").alias("s"), F.col("exchange").alias("x"), F.split("conditions", ",").alias("c"), F.col("tape").alias("z"), F.col("trade_id").alias("i"))
    out = frames.route(frames.decode(t.select(F.concat(F.lit("["), F.to_json(body), F.lit(",5]")).alias("value"))))["trades"]
    return out.groupBy("symbol", "exchange", "conditions", "tape").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ts_us") % 1_000_003).alias("times"), F.sum("size").alias("size"), F.max("price").alias("price"), F.sum(F.col("trade_id") % 1_000_003).alias("ids"))


def feed_quotes(spark: SparkSession, d: str) -> DataFrame:
    """Quotes from frames of single objects."""
    q = table(spark, d, "stock_quotes")
    body = F.struct(
        F.lit("q").alias("T"), F.col("symbol").alias("S"), _iso("ts_us").alias("t"), F.col("bid_price").alias("bp"), F.col("bid_size").alias("bs"), F.col("bid_exchange").alias("bx"),
        F.col("ask_price").alias("ap"), F.col("ask_size").alias("as"), F.col("ask_exchange").alias("ax"), F.split("conditions", ",").alias("c"), F.col("tape").alias("z"),
    )
    out = frames.route(frames.decode(q.select(F.to_json(body).alias("value"))))["quotes"]
    return out.groupBy("symbol", "bid_exchange", "ask_exchange", "tape").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ts_us") % 1_000_003).alias("times"), F.sum("bid_size").alias("bid_size"), F.sum("ask_size").alias("ask_size"), F.max("bid_price").alias("bid_price"), F.min("ask_price").alias("ask_price"))


def feed_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars from frames: minute bars, updates of them, and daily ones."""
    b = table(spark, d, "stock_bars")
    kind = F.when(F.col("timeframe") == "1day", "d").when(F.col("seq") % 2 == 0, "b").otherwise("u")
    body = F.struct(kind.alias("T"), F.col("symbol").alias("S"), F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"), F.col("volume").alias("v"), F.col("trade_count").alias("n"), F.col("vwap").alias("vw"))
    return frames.route(frames.decode(b.select(F.to_json(body).alias("value"))))["bars"].select("symbol", "timeframe", "ts", "open", "high", "low", "close", "volume", "trade_count", "vwap", "is_first_print")


def feed_rest(spark: SparkSession, d: str) -> DataFrame:
    """What of a mixed feed ends as statuses, bands and raw rows: nothing is lost."""
    s = _statuses(spark, d).select(F.to_json(F.struct(F.lit("s").alias("T"), F.col("symbol").alias("S"), _iso("ts_us").alias("t"), F.col("status_code").alias("sc"), F.col("status_msg").alias("sm"), F.col("reason_code").alias("rc"))).alias("value"))
    b = _bands(spark, d).select(F.to_json(F.struct(F.lit("l").alias("T"), F.col("symbol").alias("S"), _iso("ts_us").alias("t"), F.col("limit_up").alias("u"), F.col("limit_down").alias("d"), F.col("indicator").alias("i"))).alias("value"))
    odd = table(spark, d, "events").filter("event_type = 'click'").select(F.concat(F.lit('{"T":"t","S":"A","t":"2022-01-01T00:00:00Z","p":"'), F.col("value").cast("string"), F.lit('"}')).alias("value"))
    made = frames.route(frames.decode(s.unionAll(b).unionAll(odd)))
    one = lambda df, name, kind: df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "kind", "n")
    out = one(made["statuses"], "statuses", F.col("status_code")).unionAll(one(made["bands"], "bands", F.coalesce("indicator", F.lit("-")))).unionAll(one(made["raw"], "raw", F.col("message_type")))
    return out.unionAll(one(made["trades"], "trades", F.lit("t")))


def feed_articles(spark: SparkSession, d: str) -> DataFrame:
    """Normalised articles of frames."""
    a = table(spark, d, "news_articles")
    body = F.struct(F.lit("n").alias("T"), "id", "headline", "summary", "author", "created_at", "updated_at", F.col("content_html").alias("content"), "url", "source", F.from_json("symbols_json", "array<string>").alias("symbols"))
    good, _ = frames.articles(frames.decode(a.select(F.to_json(body).alias("value"))), F.lit("2022-02-01T00:00:00Z").cast("timestamp"))
    return good.select("id", "headline", "summary", "author", F.unix_micros("created_at").alias("created_us"), F.unix_micros("updated_at").alias("updated_us"), "url", "source", F.array_join("symbols", ",").alias("symbols"), "content_hash", "is_content_present", "latency_ms")


QUERIES = {
    f.__name__: f
    for f in (
        surface_recent, surface_recent_of, surface_page, surface_position, surface_article, surface_versions, surface_search, surface_search_index, surface_for_symbols, surface_digest,
        surface_symbol_map, surface_news_pulse, surface_latency, surface_counts, surface_raw, surface_replay, surface_replayed, surface_status_keys, surface_alerts, surface_alerts_of,
        surface_alerts_page, alert_reasons, alerts_acknowledged, alert_store, status_alert_rows, band_alert_rows, trigger_alert_rows, story_alert_rows, article_merge, merged_index, symbol_changes,
        ingest_outcomes, published_articles, surface_trades, surface_quotes, surface_bars, surface_bars_page, surface_halts, surface_bands, surface_tape, surface_pulse, surface_latest,
        surface_snapshots, surface_actives, surface_calendar, surface_actions, surface_started, event_phases_holidays, fetched_bars, news_gap_start, gap_starts, gap_rows, added_backfill, tick_retention,
        published_bars, published_ticks, feed_trades, feed_quotes, feed_bars, feed_rest, feed_articles,
    )
}


_ART = news._ART
_SYMBOLS = news._SYMBOLS
_ALERTS = news._ALERTS
_HASH = news._HASH
_NOW = f"(SELECT max(seen_us) FROM {_ART})"
_TRADED = "(SELECT max(ts_us) FROM stock_trades)"


def _top(n: int = 1) -> str:
    return f"(SELECT symbol FROM stock_trades GROUP BY 1 ORDER BY count(*) DESC, symbol LIMIT {n})"


def _cut(text: str, most: int) -> str:
    return rf"CASE WHEN length({text}) <= {most} THEN {text} ELSE regexp_replace(substr({text}, 1, {most - 3}), '\s+$', '') || '...' END"


def _names(column: str = "symbols") -> str:
    return f"array_to_string({column}, ',')"


_SHOWN = f"(SELECT *, {_SYMBOLS} AS symbols FROM {_ART})"
_RAW = """(SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) AS us, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS received_at, CASE WHEN event_type = 'view' THEN 'queue_overflow_drop' ELSE 'stream' END AS endpoint,
  CASE WHEN event_type = 'click' THEN substr(props, 1, 4) ELSE props END AS raw_json, event_type = 'view' AND event_id % 3 = 0 AS replayed FROM events)"""
_STATUS = """(SELECT 'U' || user_id AS symbol, user_id, epoch_us(ts) AS ts_us, event_id, CASE event_type WHEN 'error' THEN 'H' WHEN 'signup' THEN 'T' ELSE '' END AS code,
  CASE event_type WHEN 'error' THEN 'Halted' WHEN 'purchase' THEN 'Volatility Pause' END AS msg, CASE event_type WHEN 'error' THEN 'Halted; T1' WHEN 'signup' THEN 'News released' ELSE 'Volatility Pause' END AS detail, event_type
  FROM events WHERE event_type IN ('error', 'signup', 'purchase'))"""
_BANDS = "(SELECT symbol, ts * 1000000 AS ts_us, high AS limit_up, low AS limit_down, CASE WHEN seq % 2 = 0 THEN 'B' END AS indicator, seq FROM stock_bars WHERE timeframe = '1day')"
_STORED = f"""(SELECT a.article_id || '-' || a.category AS alert_id, a.article_id, n.seen_us AS created_us, a.severity, a.category, a.symbols, n.headline, {_HASH} AS content_hash, a.direction, a.matches
  FROM ({_ALERTS}) a JOIN {_ART} n ON n.id = a.article_id)"""
_REASON = """CASE category WHEN 'held_or_interested_symbol' THEN 'article mentions interest symbol(s): ' || replace(symbols, ',', ', ') WHEN 'breaking_keyword' THEN 'article tagged as breaking/developing'
  WHEN 'custom_keyword' THEN 'keyword match in commodities: ' || replace(matches, ',', ', ') ELSE 'keyword match in ' || regexp_replace(category, '_keyword$', '') || ': ' || replace(matches, ',', ', ') END"""
_LATENCY = f"coalesce(({sql_instant_us('last_seen_at')} - greatest(created_us, updated_us)) // 1000, latency_ms)"

#: All deliveries of an article in order: its row first, then its versions; odd versions lack the last symbol.
_MIXED = f"""
  WITH a AS (SELECT *, {_SYMBOLS} AS symbols FROM news_articles),
  f AS (
    SELECT id, coalesce(headline, '') AS headline, symbols, summary, author, created_at, updated_at, content_html, content_text, url, source, first_seen_at AS received_at, latency_ms, is_content_present, NULL::BIGINT AS r, '' AS version_id FROM a
    UNION ALL
    SELECT v.article_id, coalesce(v.headline, ''), CASE WHEN ascii(right(v.version_id, 1)) % 2 = 1 THEN a.symbols[1:greatest(len(a.symbols) - 1, 0)] ELSE a.symbols END, v.summary, NULL, NULL, v.updated_at, NULL, NULL, NULL, v.source, v.received_at, NULL, 0, {sql_instant_us('v.received_at')}, v.version_id
    FROM news_article_versions v JOIN a ON a.id = v.article_id),
  s AS (
    SELECT *, row_number() OVER w AS k, lag(headline) OVER w AS ph, lag(symbols) OVER w AS psy, last_value(summary IGNORE NULLS) OVER b AS ps, last_value(updated_at IGNORE NULLS) OVER b AS pu,
           last_value(summary IGNORE NULLS) OVER u AS ms, last_value(author IGNORE NULLS) OVER u AS ma, last_value(created_at IGNORE NULLS) OVER u AS mc, last_value(updated_at IGNORE NULLS) OVER u AS mu,
           last_value(content_html IGNORE NULLS) OVER u AS mh, last_value(content_text IGNORE NULLS) OVER u AS mt, last_value(url IGNORE NULLS) OVER u AS ml, last_value(source IGNORE NULLS) OVER u AS mo,
           first_value(latency_ms IGNORE NULLS) OVER u AS lat, max(is_content_present) OVER u AS present, first_value(received_at) OVER u AS first_seen_at, lead(id) OVER w IS NULL AS is_last
    FROM f WINDOW w AS (PARTITION BY id ORDER BY r NULLS FIRST, version_id), b AS (PARTITION BY id ORDER BY r NULLS FIRST, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                  u AS (PARTITION BY id ORDER BY r NULLS FIRST, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  c AS (
    SELECT *, k > 1 AND (content OR symbols IS DISTINCT FROM psy) AS changed, k > 1 AND content AS content_changed
    FROM (SELECT *, headline IS DISTINCT FROM ph OR (summary IS NOT NULL AND summary IS DISTINCT FROM ps) OR (updated_at IS NOT NULL AND updated_at IS DISTINCT FROM pu) OR (content_html IS NOT NULL AND k > 1) AS content FROM s)),
  m AS (SELECT *, CAST(sum(changed::INT) OVER (PARTITION BY id) AS BIGINT) AS updates FROM c)"""
_FED = news._FEED

ORACLES = {
    "surface_recent": f"SELECT id, headline, {_names()} AS symbols, source, coalesce(nullif(updated_at, ''), created_at) AS updated_at, url FROM {_SHOWN} WHERE greatest(updated_us, created_us, seen_us) >= {_NOW} - 86400000000 ORDER BY at_us DESC NULLS LAST, id DESC LIMIT 200",
    "surface_recent_of": f"""
      SELECT id, headline, update_count, {_cut('content_text', 4000)} AS content_text FROM {_SHOWN} WHERE list_has_any(symbols, (SELECT list(symbol) FROM {_top(3)}))
        AND lower(trim(source, ' ')) IN (SELECT lower(trim(source, ' ')) AS s FROM news_articles WHERE trim(source) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)
        AND (created_us IS NOT NULL OR updated_us IS NOT NULL OR seen_us IS NOT NULL) ORDER BY at_us DESC NULLS LAST, id DESC LIMIT 200""",
    "surface_page": f"""
      SELECT id, seq, count(*) OVER () > 500 AS has_more FROM (SELECT * FROM {_SHOWN} WHERE seq > 1 AND list_has_any(symbols, (SELECT list(symbol) FROM {_top(3)})) ORDER BY seq LIMIT 501) QUALIFY row_number() OVER (ORDER BY seq) <= 500""",
    "surface_position": f"""
      WITH r AS (SELECT seq FROM {_SHOWN} WHERE list_has_any(symbols, (SELECT list(symbol) FROM {_top()})))
      SELECT min(seq) - 1 > 1 AS gap, CASE WHEN min(seq) - 1 > 1 THEN min(seq) - 1 END AS oldest_available_cursor, max(seq) AS latest_cursor, (SELECT max(seq) FROM (SELECT seq FROM r WHERE seq > 1 ORDER BY seq LIMIT 10)) AS next_cursor, count(*) FILTER (seq > 1) > 10 AS has_more FROM r""",
    "surface_article": f"SELECT id, headline, summary, author, created_at, updated_at, url, source, {_names()} AS symbols, first_seen_at, last_seen_at, last_seen_source, update_count, latency_ms, is_content_present, {_cut('content_text', 4000)} AS content_text, raw_json FROM {_SHOWN} WHERE id = (SELECT max(id) FROM news_articles)",
    "surface_versions": f"""
      SELECT version_id, headline, {sql_instant_us('received_at')} AS received_us FROM news_article_versions WHERE article_id = (SELECT article_id FROM news_article_versions GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
      ORDER BY received_us DESC NULLS LAST, version_id DESC LIMIT 200""",
    "surface_search": f"SELECT id, headline FROM ({news.ORACLES['search_terms']}) JOIN {_ART} USING (id) WHERE at_us >= 1641254400000000 AND at_us < 1641427200000000 ORDER BY score DESC, id LIMIT 200",
    "surface_search_index": news.ORACLES["search_terms"],
    "surface_for_symbols": f"""
      SELECT symbol, id, headline, at_us, url FROM (SELECT DISTINCT symbol, article_id AS id FROM news_symbol_index WHERE symbol IN (SELECT symbol FROM {_top(5)}) AND {sql_instant_us('received_at')} IS NOT NULL) JOIN {_ART} USING (id)
      QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY at_us DESC NULLS LAST, id DESC) <= 10""",
    "surface_digest": rf"""
      WITH r AS (SELECT * FROM {_ART} WHERE created_us IS NOT NULL OR updated_us IS NOT NULL OR seen_us IS NOT NULL ORDER BY at_us DESC NULLS LAST, id DESC LIMIT 200)
      SELECT id, headline, {_cut('summary', 240)} AS summary FROM r WHERE regexp_matches(lower(concat_ws(' ', headline, summary, {_cut('content_text', 4000)})), '{'|'.join(alerts.DIGEST_MARKERS)}') ORDER BY at_us DESC NULLS LAST, id DESC LIMIT 25""",
    "surface_symbol_map": f"SELECT symbol, count(DISTINCT article_id) AS articles FROM news_symbol_index WHERE {sql_instant_us('received_at')} >= {_NOW} - 172800000000 GROUP BY 1 HAVING count(DISTINCT article_id) >= 2 ORDER BY 2 DESC, 1 LIMIT 500",
    "surface_news_pulse": f"""
      WITH i AS (SELECT DISTINCT symbol, article_id AS id FROM news_symbol_index WHERE {sql_instant_us('received_at')} IS NOT NULL),
      n AS (SELECT symbol, count(*) AS articles FROM i GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
      h AS (SELECT symbol, last(headline ORDER BY at_us, id) AS latest_headline, max(at_us) AS latest_us FROM i JOIN {_ART} USING (id) WHERE at_us IS NOT NULL GROUP BY 1),
      w AS (SELECT symbol, count(*) FILTER (category = 'mna_keyword') AS mna_alerts, count(*) FILTER (direction = 'bullish') AS bullish, count(*) FILTER (direction = 'bearish') AS bearish, count(*) FILTER (direction = 'neutral') AS neutral
            FROM (SELECT unnest(string_split(symbols, ',')) AS symbol, category, direction FROM {_STORED} WHERE created_us IS NOT NULL) GROUP BY 1)
      SELECT symbol, articles, latest_headline, latest_us, coalesce(mna_alerts, 0) AS mna_alerts, coalesce(bullish, 0) AS bullish, coalesce(bearish, 0) AS bearish, coalesce(neutral, 0) AS neutral FROM n LEFT JOIN h USING (symbol) LEFT JOIN w USING (symbol)""",
    "surface_latency": f"""
      WITH s AS (SELECT list_sort(list(latency_ms)) AS v, CAST(sum(latency_ms) // count(*) AS BIGINT) AS avg_ms FROM {_ART} WHERE latency_ms >= 0 AND seen_us IS NOT NULL)
      SELECT len(v) AS sample_count, v[len(v)] AS max_ms, avg_ms, v[CAST(round_even(0.5 * (len(v) - 1), 0) AS BIGINT) + 1] AS p50_ms, v[CAST(round_even(0.9 * (len(v) - 1), 0) AS BIGINT) + 1] AS p90_ms, v[CAST(round_even(0.99 * (len(v) - 1), 0) AS BIGINT) + 1] AS p99_ms FROM s""",
    "surface_counts": f"""
      SELECT (SELECT count(*) FROM {_ART} WHERE seen_us >= {_NOW} - 86400000000) AS articles, (SELECT count(*) FROM news_article_versions WHERE {sql_instant_us('received_at')} >= {_NOW} - 86400000000) AS versions,
             (SELECT count(DISTINCT symbol) FROM news_symbol_index WHERE {sql_instant_us('received_at')} >= {_NOW} - 86400000000) AS symbols, (SELECT count(DISTINCT source) FROM {_ART} WHERE seen_us >= {_NOW} - 86400000000) AS sources,
             (SELECT count(*) FROM {_RAW} WHERE us >= {_NOW} - 86400000000) AS raw_events""",
    "surface_raw": f"SELECT event_id, raw_json, CASE WHEN json_valid(raw_json) THEN CAST(json_extract(raw_json, '$.k') AS BIGINT) END AS k, json_valid(raw_json) AS is_json FROM {_RAW} WHERE us >= (SELECT max(us) FROM {_RAW}) - 86400000000 ORDER BY us DESC, event_id DESC LIMIT 500",
    "surface_replay": f"SELECT event_id, received_at FROM {_RAW} WHERE endpoint = 'queue_overflow_drop' AND NOT replayed ORDER BY received_at, event_id LIMIT 100",
    "surface_replayed": f"SELECT endpoint, replayed OR event_id IN (SELECT event_id FROM {_RAW} WHERE endpoint = 'queue_overflow_drop' AND NOT replayed ORDER BY received_at, event_id LIMIT 100) AS replayed, count(*) AS n FROM {_RAW} GROUP BY 1, 2",
    "surface_status_keys": "SELECT 'U' || user_id AS key, last(props ORDER BY ts, event_id) AS value_json, last(event_id ORDER BY ts, event_id) AS event_id FROM events GROUP BY 1",
    "surface_alerts": f"SELECT alert_id, severity, {_REASON} AS reason FROM {_STORED} WHERE created_us IS NOT NULL AND severity = 'critical' AND category IN ('legal_regulatory_keyword', 'halt_risk_keyword') ORDER BY created_us DESC, article_id DESC LIMIT 500",
    "surface_alerts_of": f"SELECT alert_id FROM {_STORED} WHERE created_us IS NOT NULL AND category = 'mna_keyword' AND list_has_any(string_split(symbols, ','), (SELECT list(symbol) FROM {_top(3)})) ORDER BY created_us DESC, article_id DESC LIMIT 500",
    "surface_alerts_page": f"""
      WITH r AS (SELECT alert_id, article_id AS seq, severity FROM {_STORED} WHERE category = 'earnings_keyword')
      SELECT alert_id, seq, count(*) OVER () > 500 AS has_more FROM (SELECT * FROM r WHERE severity IN ('high', 'critical') AND seq > (SELECT max(seq) FROM r) - 1000 ORDER BY seq LIMIT 501) QUALIFY row_number() OVER (ORDER BY seq) <= 500""",
    "alert_reasons": f"SELECT article_id, category, CASE WHEN category = 'high_latency' THEN 'latency_ms=' || {_LATENCY} || ' exceeds threshold 30000' ELSE {_REASON} END AS reason FROM (SELECT article_id, category, symbols AS sy, matches FROM ({_ALERTS})) a(article_id, category, symbols, matches) JOIN {_ART} n ON n.id = article_id",
    "alerts_acknowledged": f"SELECT article_id % 5 = 0 AS acknowledged, count(*) AS n FROM ({_ALERTS}) GROUP BY 1",
    "alert_store": f"SELECT article_id || '-' || category AS alert_id, created_us FROM ({news.ORACLES['alerts_without_copies']})",
    "status_alert_rows": f"""
      SELECT symbol, ts_us, CASE event_type WHEN 'signup' THEN 'trading_resume' ELSE 'trading_halt' END AS category,
             CASE WHEN event_type = 'signup' THEN CASE WHEN user_id % 2 = 0 THEN 'medium' ELSE 'low' END WHEN user_id % 2 = 0 THEN 'critical' ELSE 'low' END AS severity, symbol || ' trading status: ' || detail AS reason FROM {_STATUS}""",
    "band_alert_rows": f"""
      WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts_us) AS k FROM {_BANDS}),
      r AS (SELECT symbol, k, ts_us AS kept, true AS fresh FROM o WHERE k = 1
            UNION ALL SELECT o.symbol, o.k, CASE WHEN o.ts_us - r.kept >= 172800000000 THEN o.ts_us ELSE r.kept END, o.ts_us - r.kept >= 172800000000 FROM r JOIN o ON o.symbol = r.symbol AND o.k = r.k + 1)
      SELECT symbol, ts_us, 'luld' AS category, 'medium' AS severity, symbol || ' LULD band update: limit_up=' || coalesce(limit_up::VARCHAR, 'None') || ' limit_down=' || coalesce(limit_down::VARCHAR, 'None') || ' indicator=' || coalesce(indicator, 'None') AS reason
      FROM r JOIN o USING (symbol, k) WHERE fresh""",
    "trigger_alert_rows": f"""
      SELECT symbol, ts * 1000000 AS ts_us, category, CASE WHEN symbol IN (SELECT symbol FROM {_top()}) THEN 'high' ELSE 'medium' END AS severity, direction,
             CASE category WHEN 'price_move' THEN symbol || ' moved ' || printf('%+.2f', value) || '% in ~5 minutes' WHEN 'volume_spike' THEN symbol || ' minute volume ' || printf('%.1f', value) || 'x its rolling average'
                           ELSE symbol || ' broke its day ' || CASE direction WHEN 'bullish' THEN 'high ' ELSE 'low ' END END AS reason
      FROM ({market.ORACLES['bar_triggers']})""",
    "story_alert_rows": f"""
      {_FED}, n AS (SELECT *, sum(changed::INT) OVER (PARTITION BY id ORDER BY r, version_id) AS updates FROM c)
      SELECT h AS headline, 'watched story updated (article_id=' || id || ', update #' || updates || ')' AS reason, received_at FROM n
      WHERE changed AND id IN (SELECT DISTINCT id FROM n WHERE id % 20 = 0 ORDER BY id LIMIT 50)""",
    "article_merge": f"{_MIXED} SELECT id, headline, {_names()} AS symbols, ms AS summary, ma AS author, mc AS created_at, mu AS updated_at, mh AS content_html, mt AS content_text, ml AS url, mo AS source, lat AS latency_ms, present AS is_content_present, updates AS update_count, first_seen_at, received_at AS last_seen_at FROM m WHERE is_last",
    "merged_index": f"{_MIXED} SELECT unnest(symbols) AS symbol, id AS article_id, received_at FROM m WHERE is_last",
    "symbol_changes": f"""
      {_MIXED} SELECT * FROM (SELECT a.id, array_to_string(list_sort(list_filter(b.symbols, lambda x: NOT list_contains(a.symbols, x))), ',') AS added, array_to_string(list_sort(list_filter(a.symbols, lambda x: NOT list_contains(b.symbols, x))), ',') AS removed
      FROM m a JOIN m b ON a.id = b.id WHERE a.k = 1 AND b.is_last) WHERE added <> '' OR removed <> ''""",
    "ingest_outcomes": f"{_MIXED} SELECT CASE WHEN k = 1 THEN 'new' WHEN changed THEN 'updated' ELSE 'duplicate' END AS status, count(*) AS n FROM m GROUP BY 1",
    "published_articles": news.ORACLES["article_upsert"],
    "surface_trades": f"SELECT ts_us, price, size, exchange, conditions, tape FROM stock_trades WHERE symbol = {_top()} AND ts_us >= {_TRADED} - 14400000000 ORDER BY ts_us DESC, ingest_seq DESC LIMIT 1000",
    "surface_quotes": f"SELECT ts_us, bid_price, bid_size, ask_price, ask_size, tape FROM stock_quotes WHERE symbol = {_top()} AND ts_us >= {_TRADED} - 14400000000 ORDER BY ts_us DESC, ingest_seq DESC LIMIT 1000",
    "surface_bars": f"""
      SELECT ts - ts % 900 AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count,
             round(sum(vwap * volume) / nullif(sum(CASE WHEN vwap IS NOT NULL THEN volume ELSE 0 END), 0) + 1e-9, 6) AS vwap
      FROM stock_bars WHERE timeframe = '1min' AND symbol = {_top()} AND ts >= 1641168000 AND ts <= 1641412800 GROUP BY 1 ORDER BY 1 DESC LIMIT 1000""",
    "surface_bars_page": f"""
      SELECT symbol, ts, close, seq, count(*) OVER () > 2000 AS has_more FROM (SELECT * FROM stock_bars WHERE timeframe = '1min' AND symbol IN (SELECT symbol FROM {_top(2)}) AND seq > (SELECT max(seq) FROM stock_bars) // 2 ORDER BY seq LIMIT 2001) QUALIFY row_number() OVER (ORDER BY seq) <= 2000""",
    "surface_halts": f"SELECT symbol, ts_us, code AS status_code, event_id FROM {_STATUS} WHERE ts_us >= (SELECT max(epoch_us(ts)) FROM events) - 86400000000 ORDER BY ts_us DESC, event_id DESC LIMIT 200",
    "surface_bands": f"SELECT symbol, ts_us, limit_up, limit_down, indicator FROM {_BANDS} WHERE symbol IN (SELECT symbol FROM {_top(3)}) ORDER BY ts_us DESC LIMIT 200",
    "surface_tape": f"""
      WITH t AS (SELECT * FROM stock_trades WHERE symbol = {_top()} AND ts_us >= {_TRADED} - 14400000000),
      a AS (SELECT symbol, ts_us - ts_us % 60000000 AS bucket_us, count(*) AS trades, CAST(sum(size) AS BIGINT) AS volume, sum(price * size) / nullif(sum(size), 0) AS vwap, count(*) FILTER (price > prev) AS upticks, count(*) FILTER (price < prev) AS downticks,
                   count(*) FILTER (size >= 500) AS block_trades, min(price) AS low, max(price) AS high FROM (SELECT *, lag(price) OVER (ORDER BY ts_us, ingest_seq) AS prev FROM t) GROUP BY 1, 2),
      q AS (SELECT symbol, ts_us - ts_us % 60000000 AS bucket_us, count(*) AS quotes, avg((ask_price - bid_price) * 20000.0::DOUBLE / nullif(ask_price + bid_price, 0)) AS spread_bps, avg(bid_size::DOUBLE / nullif(bid_size + ask_size, 0)) AS bid_fraction
            FROM stock_quotes WHERE bid_price > 0 AND ask_price > 0 AND symbol = {_top()} AND ts_us >= {_TRADED} - 14400000000 GROUP BY 1, 2)
      SELECT symbol, bucket_us, coalesce(trades, 0) AS trades, CASE WHEN trades IS NULL THEN 0 ELSE volume END AS volume, round(vwap + 1e-9, 6) AS vwap, coalesce(upticks, 0) AS upticks, coalesce(downticks, 0) AS downticks, coalesce(block_trades, 0) AS block_trades, low, high,
             coalesce(quotes, 0) AS quotes, round(spread_bps + 1e-9, 6) AS spread_bps, round(bid_fraction + 1e-9, 6) AS bid_fraction FROM a FULL JOIN q USING (symbol, bucket_us)""",
    "surface_pulse": f"""
      WITH w AS (SELECT symbol FROM {_top(5)} UNION ALL SELECT 'UNKNOWN'),
      t AS (SELECT symbol, count(*) AS trades, CAST(sum(size) AS BIGINT) AS volume, min(price) AS low, max(price) AS high, first(price ORDER BY ts_us, ingest_seq) AS first_price, last(price ORDER BY ts_us, ingest_seq) AS last_price
            FROM stock_trades WHERE ts_us >= {_TRADED} - 14400000000 GROUP BY 1),
      q AS (SELECT symbol, avg((ask_price - bid_price) * 20000.0::DOUBLE / nullif(ask_price + bid_price, 0)) AS spread_bps FROM stock_quotes WHERE bid_price > 0 AND ask_price > 0 AND ts_us >= {_TRADED} - 14400000000 GROUP BY 1)
      SELECT symbol, coalesce(trades, 0) AS trades, CASE WHEN trades IS NULL THEN 0 ELSE volume END AS volume, low, high, first_price, last_price, round(spread_bps + 1e-9, 6) AS spread_bps, round((last_price - first_price) / nullif(first_price, 0) * 100 + 1e-9, 6) AS chg_pct, false AS halted
      FROM w LEFT JOIN t USING (symbol) LEFT JOIN q USING (symbol)""",
    "surface_latest": f"""
      WITH w AS (SELECT symbol FROM {_top(5)} UNION ALL SELECT 'UNKNOWN'),
      t AS (SELECT symbol, max(ts_us) AS trade_us, last(price ORDER BY ts_us, ingest_seq) AS price FROM stock_trades WHERE price IS NOT NULL GROUP BY 1),
      q AS (SELECT symbol, max(ts_us) AS quote_us, last(bid_price ORDER BY ts_us, ingest_seq) AS bid_price FROM stock_quotes GROUP BY 1),
      b AS (SELECT symbol, max(ts) AS bar_ts FROM stock_bars WHERE timeframe = '1min' GROUP BY 1),
      r AS (SELECT *, greatest(0, ({_TRADED} - greatest(trade_us, quote_us, bar_ts * 1000000)) / 1e6::DOUBLE) AS age FROM w LEFT JOIN t USING (symbol) LEFT JOIN q USING (symbol) LEFT JOIN b USING (symbol))
      SELECT symbol, trade_us, price, quote_us, bid_price, bar_ts, CASE WHEN symbol <> 'UNKNOWN' THEN round(age + 1e-9, 6) ELSE 0 END AS age_s, CASE WHEN symbol = 'UNKNOWN' THEN false ELSE age > 120 END AS stale,
             concat_ws(',', CASE WHEN trade_us IS NULL THEN 'trade' END, CASE WHEN quote_us IS NULL THEN 'quote' END, CASE WHEN bar_ts IS NULL THEN 'bar' END) AS missing FROM r""",
    "surface_snapshots": f"""
      WITH dd AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM stock_bars WHERE timeframe = '1day')
      SELECT symbol, (SELECT last(price ORDER BY ts_us, ingest_seq) FROM stock_trades x WHERE x.symbol = w.symbol AND price IS NOT NULL) AS price, (SELECT last(ask_price ORDER BY ts_us, ingest_seq) FROM stock_quotes x WHERE x.symbol = w.symbol) AS ask_price,
             (SELECT last(close ORDER BY ts) FROM stock_bars x WHERE x.symbol = w.symbol AND timeframe = '1min') AS minute_close, a.ts AS day_ts, a.close AS day_close, b.close AS before_close
      FROM {_top(20)} w LEFT JOIN (SELECT * FROM dd WHERE k = 1) a USING (symbol) LEFT JOIN (SELECT * FROM dd WHERE k = 2) b USING (symbol)""",
    "surface_actives": "SELECT symbol, last(trade_count ORDER BY ts) AS trade_count FROM stock_bars WHERE timeframe = '1day' GROUP BY 1 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20",
    "surface_calendar": f"SELECT DISTINCT CAST(CAST({market._local('ts')} AS DATE) AS VARCHAR) AS date FROM stock_bars WHERE timeframe = '1min' AND CAST({market._local('ts')} AS DATE) BETWEEN DATE '2022-01-04' AND DATE '2022-01-31'",
    "surface_actions": "SELECT DISTINCT 'U' || user_id AS symbol, event_type AS type, strftime(ts, '%Y-%m-%d') AS date FROM events WHERE event_type IN ('purchase', 'view') AND CAST(ts AS DATE) BETWEEN (SELECT CAST(min(ts) AS DATE) FROM events) AND (SELECT CAST(min(ts) AS DATE) + 3 FROM events) ORDER BY date DESC, symbol LIMIT 200",
    "surface_started": "SELECT (SELECT max(seq) FROM news_articles) AS news_cursor, 0 AS alerts_cursor, (SELECT max(seq) FROM stock_bars) AS bars_cursor",
    "event_phases_holidays": f"SELECT event_id, CASE WHEN day({market._local('epoch(ts)')}) % 3 = 0 THEN 'closed' ELSE {market._phase('epoch(ts)')} END AS phase FROM events",
    "fetched_bars": """
      WITH r AS (SELECT symbol, ts, open, high, low, CASE WHEN seq % 7 <> 0 THEN close END AS close, coalesce(CASE WHEN seq % 5 <> 0 THEN volume END, 0) AS volume, trade_count, vwap FROM stock_bars WHERE timeframe = '1min')
      SELECT symbol, ts - ts % 300 AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) FILTER (close IS NOT NULL) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(coalesce(trade_count, 0)) AS BIGINT) AS trade_count,
             round(sum(vwap * volume) / nullif(sum(CASE WHEN vwap IS NOT NULL THEN volume ELSE 0 END), 0) + 1e-9, 6) AS vwap FROM r GROUP BY symbol, ts - ts % 300""",
    "gap_starts": """
      WITH e AS (SELECT max(ts) + 600 AS n FROM stock_bars WHERE timeframe = '1min'), s AS (SELECT DISTINCT symbol FROM stock_bars UNION ALL SELECT 'UNKNOWN'),
      b AS (SELECT symbol, max(ts) AS ts FROM stock_bars WHERE timeframe = '1min' GROUP BY 1)
      SELECT symbol, greatest(coalesce(ts, n - 3600), n - 86400) AS start, greatest(coalesce(ts, n - 3600), n - 86400) // 300 * 300 AS bucket FROM s LEFT JOIN b USING (symbol), e""",
    "news_gap_start": f"SELECT max(coalesce(updated_us, created_us)) - 180000000 AS start_us FROM {_ART}",
    "gap_rows": """
      WITH b AS (SELECT symbol, greatest(max(ts), (SELECT max(ts) FROM stock_bars WHERE timeframe = '1min') - 3600) AS start FROM stock_bars WHERE timeframe = '1min' GROUP BY 1)
      SELECT symbol, ts, close FROM stock_bars JOIN b USING (symbol) WHERE timeframe = '1min' AND ts >= start""",
    "added_backfill": f"SELECT symbol, e.n - 14400 AS start, (e.n - 14400) // 300 * 300 AS bucket FROM {_top(5)}, (SELECT max(ts) AS n FROM stock_bars WHERE timeframe = '1min') e",
    "tick_retention": f"""
      SELECT 'stock_trades' AS table_name, count(*) AS n FROM stock_trades WHERE ts_us >= {_TRADED} - 14400000000 UNION ALL SELECT 'stock_quotes', count(*) FROM stock_quotes WHERE ts_us >= {_TRADED} - 14400000000
      UNION ALL SELECT 'stock_bars', count(*) FROM stock_bars WHERE ts >= ({_TRADED} - 172800000000) // 1000000""",
    "published_bars": "SELECT symbol, timeframe, ts, CASE WHEN seq % 5 = 0 THEN close + 1 ELSE close END AS close, volume FROM stock_bars",
    "published_ticks": f"""
      SELECT 'trades' AS table_name, count(*) AS n, CAST(sum(ts_us % 1000003) AS BIGINT) AS checksum FROM stock_trades WHERE ts_us >= {_TRADED} - 86400000000 UNION ALL SELECT 'quotes', count(*), CAST(sum(ts_us % 1000003) AS BIGINT) FROM stock_quotes
      UNION ALL SELECT 'statuses', count(*), CAST(sum(ts_us % 1000003) AS BIGINT) FROM {_STATUS} UNION ALL SELECT 'bands', count(*), CAST(sum(ts_us % 1000003) AS BIGINT) FROM {_BANDS}""",
    "feed_trades": "SELECT symbol, exchange, conditions, tape, count(*) AS n, CAST(sum(ts_us % 1000003) AS BIGINT) AS times, CAST(sum(size) AS BIGINT) AS size, max(price) AS price, CAST(sum(trade_id % 1000003) AS BIGINT) AS ids FROM stock_trades WHERE price IS NOT NULL GROUP BY 1, 2, 3, 4",
    "feed_quotes": "SELECT symbol, bid_exchange, ask_exchange, tape, count(*) AS n, CAST(sum(ts_us % 1000003) AS BIGINT) AS times, CAST(sum(bid_size) AS BIGINT) AS bid_size, CAST(sum(ask_size) AS BIGINT) AS ask_size, max(bid_price) AS bid_price, min(ask_price) AS ask_price FROM stock_quotes GROUP BY 1, 2, 3, 4",
    "feed_bars": "SELECT symbol, timeframe, ts, open, high, low, close, volume, trade_count, vwap, timeframe = '1min' AND seq % 2 = 0 AS is_first_print FROM stock_bars",
    "feed_rest": f"""
      SELECT 'statuses' AS table_name, code AS kind, count(*) AS n FROM {_STATUS} GROUP BY 2 UNION ALL SELECT 'bands', coalesce(indicator, '-'), count(*) FROM {_BANDS} GROUP BY 2
      UNION ALL SELECT 'raw', 's', count(*) FROM {_STATUS} UNION ALL SELECT 'raw', 'l', count(*) FROM {_BANDS} UNION ALL SELECT 'raw', 't', count(*) FROM events WHERE event_type = 'click'""",
    "feed_articles": f"""
      SELECT id, coalesce(headline, '') AS headline, summary, author, created_us, updated_us, url, source, {_names()} AS symbols, {_HASH} AS content_hash, coalesce(trim(content_html) <> '', false) AS is_content_present,
             CAST(trunc((1643673600000000 - created_us) / 1000) AS BIGINT) AS latency_ms FROM {_SHOWN}""",
}
