"""The query surface: checked arguments in, DataFrames (or small dicts for scalars) out.

An :class:`Engine` reads the tables of one folder as of one instant. Bounds are
checked before anything is planned; a bad argument raises :class:`RequestError`
with a code. Results keep full precision; round where they are shown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.sessions import market_phase
from tidemark.functions.text import source_name, symbol_list, truncate
from tidemark.functions.times import floor_to, instant_us
from tidemark.operators import alerts as alert_ops
from tidemark.operators import bars as bar_ops
from tidemark.operators import context, cursors, search, tape
from tidemark.operators.ordered import order_statistics, percentile_ranks
from tidemark.session import ship_code
from tidemark.sources.tables import table
from tidemark.streaming import jobs
from tidemark.streaming.publish import Published, acknowledge, insert_alerts

# The bounds of requests.
MAX_ARTICLES = 200
MAX_CURSOR_ITEMS = 500
MAX_VERSIONS = 200
MAX_RAW_EVENTS = 500
MAX_SYMBOLS = 50
MAX_SYMBOL_MAP = 500
MAX_SYMBOL_MAP_MINUTES = 10_080
MAX_DIGEST = 25
MAX_WINDOW_MINUTES = 240
MAX_WINDOW_ROWS = 1000
MAX_BARS = 1000
MAX_BARS_CURSOR = 2000
MAX_CONTEXT_SYMBOLS = 20
MAX_TAPE_BUCKETS = 360
MAX_STATUSES = 200
MAX_TOP = 50
MAX_INTEREST = 200
MAX_WATCHED = 50
MAX_WATCHLIST = 500
MAX_CALENDAR_DAYS = 90
MAX_ACTIONS = 200
MAX_GROUPS = 50
MAX_PHRASES = 100
MAX_PHRASE_CHARS = 200
MAX_CONTENT_CHARS = 4000
MAX_SNAPSHOTS = 50
MAX_HISTORY_SYMBOLS = 5
MAX_HISTORY_DAYS = 365
MAX_HISTORY_ARTICLES = 500
MAX_BACKFILL_MINUTES = 10_080
STALE_SECONDS = 120.0
FIELD_MODES = ("compact", "standard", "full")


class RequestError(ValueError):
    """A request that can't be answered; ``code`` tells why, ``fields`` with what."""

    def __init__(self, code: str, **fields: object) -> None:
        super().__init__(f"{code}: {fields}")
        self.code, self.fields = code, fields


def bounded(value: int, most: int) -> int:
    """``value``, at least 1; an error above ``most``."""
    if value > most:
        raise RequestError("limit_exceeded", max_allowed=most, requested=value)
    return max(1, value)


def symbols_of(values: Iterable[str] | None, most: int = MAX_SYMBOLS) -> list[str] | None:
    """Upper-cased symbols without blanks, or None for no filter."""
    if values is None:
        return None
    out = list(dict.fromkeys(v.strip().upper() for v in values if v and v.strip()))
    bounded(len(out), most)
    return out or None


def time_bound(field: str, value: str | None, end_of_day: bool = False) -> int | None:
    """Epoch microseconds of a filter's bound; a mere date as upper bound is the end of that day."""
    if value is None:
        return None
    try:
        at = datetime.fromisoformat(value.strip())
    except ValueError:
        raise RequestError("invalid_date", field=field, value=value) from None
    at = at.replace(tzinfo=UTC) if at.tzinfo is None else at
    if end_of_day and len(value.strip()) == 10:
        at += timedelta(days=1, microseconds=-1)
    since = at - datetime(1970, 1, 1, tzinfo=UTC)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


class Engine:
    """Queries over the tables in ``folder`` as of ``as_of_us``; optional tables missing there are empty."""

    def __init__(self, spark: SparkSession, folder: str, as_of_us: int, extra: dict[str, DataFrame] | None = None, interest: Iterable[str] = (), watchlist: Iterable[str] = ()) -> None:
        ship_code(spark)
        self.spark, self.folder, self.as_of_us = spark, folder, as_of_us
        self.extra = extra or {}
        self.interest: list[str] = sorted(set(symbols_of(interest, MAX_INTEREST) or []))
        self.watchlist: list[str] = sorted(set(symbols_of(watchlist, MAX_WATCHLIST) or []))
        self.watched: dict[int, int] = {}
        self.groups: dict[str, dict[str, list[str]]] = {}
        self.index: search.TermIndex | None = None

    # -- tables

    def rows(self, name: str, schema: str | None = None) -> DataFrame:
        if name in self.extra:
            return self.extra[name]
        if schema is not None:
            return self.spark.createDataFrame([], schema)
        return table(self.spark, self.folder, name)

    def _since(self, minutes: int, most: int | None = None) -> int:
        return self.as_of_us - (bounded(minutes, most) if most else max(1, minutes)) * 60_000_000

    def _articles(self) -> DataFrame:
        rows = self.rows("news_articles")
        timed = rows.withColumns({"created_us": instant_us("created_at"), "updated_us": instant_us("updated_at"), "seen_us": instant_us("first_seen_at")})
        return timed.withColumn("at_us", F.coalesce("updated_us", "created_us", "seen_us")).withColumn("symbols", symbol_list("symbols_json"))

    def _statuses(self) -> DataFrame:
        return self.rows("stock_statuses", "symbol string, ts_us long, status_code string, status_msg string, reason_code string, reason_msg string, tape string, event_id long")

    def _alerts(self) -> DataFrame:
        return self.rows("alerts", "seq long, alert_id string, article_id long, created_us long, severity string, category string, symbols array<string>, headline string, reason string, acknowledged boolean, direction string")

    def _shown(self, articles: DataFrame, fields: str, content: bool = False, raw: bool = False) -> DataFrame:
        if fields not in FIELD_MODES:
            raise RequestError("invalid_fields", fields=fields, valid=list(FIELD_MODES))
        if fields == "compact":
            names: list = ["id", "headline", "symbols", "source", F.coalesce(F.nullif("updated_at", F.lit("")), "created_at").alias("updated_at"), "url"]
        else:
            names = ["id", "headline", "summary", "author", "created_at", "updated_at", "url", "source", "symbols", "first_seen_at", "last_seen_at", "last_seen_source", "update_count", "latency_ms", "is_content_present"]
        if fields == "full" or content:
            names.append(truncate(F.col("content_text"), MAX_CONTENT_CHARS).alias("content_text"))
        if raw:
            names.append("raw_json")
        return articles.select(*names)

    def _of_symbols(self, articles: DataFrame, symbols: list[str] | None) -> DataFrame:
        return articles if symbols is None else articles.filter(F.arrays_overlap("symbols", F.array(*map(F.lit, symbols))))

    # -- news

    def recent_news(self, minutes: int = 60, symbols: Iterable[str] | None = None, sources: Iterable[str] | None = None, limit: int = 50, fields: str = "standard", include_content: bool = False, include_raw: bool = False) -> DataFrame:
        limit = 50 if limit <= 0 else bounded(limit, MAX_ARTICLES)
        since = self._since(minutes)
        recent = (F.col("updated_us") >= since) | (F.col("created_us") >= since) | (F.col("seen_us") >= since)
        rows = self._of_symbols(self._articles().filter(recent), symbols_of(symbols))
        if sources is not None:
            rows = rows.filter(source_name("source").isin([s.strip(" ").lower() for s in sources]))
        return self._shown(rows.orderBy(F.desc("at_us"), F.desc("id")).limit(limit), fields, include_content, include_raw)

    def _delta(self, rows: DataFrame, cursor: int, limit: int, most: int) -> dict[str, object]:
        """A page after ``cursor`` with what its reader must know; the rows as a DataFrame under ``rows``."""
        limit = bounded(limit, most)
        edges = rows.agg(F.max("seq").alias("m"), F.min("seq").alias("n")).first()
        latest = edges["m"] or 0
        where = cursors.position(cursor, latest, edges["n"] or 0)
        if "error" in where:
            raise RequestError("cursor_out_of_range", cursor=cursor, latest_cursor=latest)
        paged = cursors.page(rows, "seq", int(where["start"]), limit)
        last = paged.agg(F.max("seq").alias("s"), F.bool_or("has_more").alias("h")).first()
        out = {k: v for k, v in where.items() if k != "start"}
        return out | {"rows": paged, "latest_cursor": latest, "next_cursor": last["s"] if last["s"] is not None else where["start"], "has_more": bool(last["h"])}

    def news_since(self, cursor: int = 0, limit: int = 100, symbols: Iterable[str] | None = None) -> dict[str, object]:
        return self._delta(self._of_symbols(self._articles(), symbols_of(symbols)), cursor, limit, MAX_CURSOR_ITEMS)

    def article(self, article_id: int, include_raw: bool = False) -> DataFrame:
        return self._shown(self._articles().filter(F.col("id") == article_id), "full", raw=include_raw)

    def versions(self, article_id: int, limit: int = 50) -> DataFrame:
        rows = self.rows("news_article_versions").filter(F.col("article_id") == article_id).withColumn("received_us", instant_us("received_at"))
        return rows.orderBy(F.desc("received_us"), F.desc("version_id")).limit(bounded(limit, MAX_VERSIONS)).orderBy("received_us", "version_id")

    def search_news(self, query: str, symbols: Iterable[str] | None = None, since: str | None = None, until: str | None = None, limit: int = 50, fields: str = "standard") -> DataFrame:
        """Scores are those in all articles, whatever the filters; with an index built by :meth:`index_news` no text is read for them."""
        rows = self._of_symbols(self._articles(), symbols_of(symbols))
        lower, upper = time_bound("since", since), time_bound("until", until, end_of_day=True)
        if lower is not None:
            rows = rows.filter(F.col("at_us") >= lower)
        if upper is not None:
            rows = rows.filter(F.col("at_us") <= upper)
        found = search.search_or_substring(rows, query, bounded(limit, MAX_ARTICLES), self.rows("news_articles"), self.index)
        return self._shown(found, fields)

    def index_news(self, home: str) -> None:
        """Build the term index that :meth:`search_news` then uses."""
        self.index = search.TermIndex(self.spark, home).build(self.rows("news_articles"))

    def news_for_symbols(self, symbols: Iterable[str], minutes: int = 1440, limit_per_symbol: int = 25) -> DataFrame:
        wanted = symbols_of(symbols)
        if not wanted:
            raise RequestError("no_symbols")
        index = self.rows("news_symbol_index").filter(F.col("symbol").isin(wanted) & (instant_us("received_at") >= self._since(minutes)))
        both = index.select("symbol", F.col("article_id").alias("id")).distinct().join(self._articles().drop("symbols"), "id")
        return bar_ops.newest(both, ["symbol"], [F.desc("at_us"), F.desc("id")], bounded(limit_per_symbol, MAX_ARTICLES)).select("symbol", "id", "headline", "at_us", "url")

    def breaking_digest(self, minutes: int = 15, symbols: Iterable[str] | None = None, max_articles: int = 25) -> DataFrame:
        rows = self.recent_news(minutes, symbols, limit=MAX_ARTICLES, fields="full")
        text = F.lower(F.concat_ws(" ", "headline", "summary", "content_text"))
        marked = F.lit(False)
        for m in alert_ops.DIGEST_MARKERS:
            marked = marked | F.contains(text, F.lit(m))
        return rows.filter(marked).limit(bounded(max_articles, MAX_DIGEST)).select("id", "headline", "symbols", "source", "url", "updated_at", truncate(F.col("summary"), 240).alias("summary"))

    def symbol_map(self, minutes: int = 60, min_articles: int = 1, limit: int = 100) -> DataFrame:
        since = self._since(minutes, MAX_SYMBOL_MAP_MINUTES)
        rows = self.rows("news_symbol_index").filter(instant_us("received_at") >= since)
        counts = rows.groupBy("symbol").agg(F.count_distinct("article_id").alias("articles")).filter(F.col("articles") >= min_articles)
        return counts.orderBy(F.desc("articles"), "symbol").limit(bounded(limit, MAX_SYMBOL_MAP))

    def news_pulse(self, symbols: Iterable[str] | None = None, minutes: int = 240, top: int = 20) -> DataFrame:
        wanted, since = symbols_of(symbols), self._since(minutes)
        index = self.rows("news_symbol_index").filter(instant_us("received_at") >= since).select("symbol", F.col("article_id").alias("id")).distinct()
        counts = index.groupBy("symbol").agg(F.count(F.lit(1)).alias("articles"))
        if wanted:
            chosen = self._requested(wanted).join(counts, "symbol", "left")
        else:
            chosen = counts.orderBy(F.desc("articles"), "symbol").limit(bounded(top, MAX_TOP))
        heads = index.join(self._articles().select("id", "headline", "at_us"), "id").filter("at_us IS NOT NULL")
        heads = heads.groupBy("symbol").agg(F.max_by("headline", F.struct("at_us", "id")).alias("latest_headline"), F.max("at_us").alias("latest_us"))
        named = self._alerts().filter(F.col("created_us") >= since).select(F.explode("symbols").alias("symbol"), "category", "direction")
        by_category = named.groupBy("symbol", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("alerts"))
        ways = named.groupBy("symbol").agg(*(F.count_if(F.coalesce("direction", F.lit("neutral")) == w).alias(w) for w in ("bullish", "bearish", "neutral")))
        out = chosen.join(heads, "symbol", "left").join(by_category, "symbol", "left").join(ways, "symbol", "left")
        return out.fillna(0, ["articles", "bullish", "bearish", "neutral"])

    def latency_stats(self, minutes: int = 60) -> dict[str, int | None]:
        rows = self._articles().filter((F.col("seen_us") >= self._since(minutes)) & (F.col("latency_ms") >= 0)).select("latency_ms", F.lit(0).alias("_g"))
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("latency_ms").alias("s"), F.max("latency_ms").alias("m")).first()
        exact = order_statistics(rows, ["_g"], "latency_ms", percentile_ranks(50, 90, 99)).first()
        out = {"sample_count": total["n"], "max_ms": total["m"], "avg_ms": total["s"] // total["n"] if total["n"] else None}
        return out | {f"p{p}_ms": int(exact[f"p{p}"]) if exact else None for p in (50, 90, 99)}

    def _raw_events(self) -> DataFrame:
        return self.rows("raw_events", schemas.RAW_EVENTS)

    def ingestion_stats(self, minutes: int = 60) -> dict[str, int]:
        since = self._since(minutes)
        index = self.rows("news_symbol_index").filter(instant_us("received_at") >= since)
        seen = self._articles().filter(F.col("seen_us") >= since).agg(F.count(F.lit(1)).alias("a"), F.count_distinct("source").alias("s")).first()
        versions = self.rows("news_article_versions").filter(instant_us("received_at") >= since).count()
        return {"articles": seen["a"], "versions": versions, "symbols": index.select("symbol").distinct().count(), "sources": seen["s"], "raw_events": self._raw_events().filter(instant_us("received_at") >= since).count()}

    def raw_events(self, minutes: int = 15, limit: int = 100) -> DataFrame:
        recent = self._raw_events().filter(instant_us("received_at") >= self._since(minutes)).orderBy(F.desc(instant_us("received_at")), F.desc("event_id")).limit(bounded(limit, MAX_RAW_EVENTS))
        return recent.withColumn("parsed", F.try_parse_json("raw_json"))

    # -- alerts and what the caller manages

    def _alert_filter(self, severity: str | None, min_severity: str | None, categories: Iterable[str] | None) -> Column:
        if severity and min_severity:
            raise RequestError("conflicting_filters", fields=["severity", "min_severity"])
        test = F.lit(True)
        for level in (severity, min_severity):
            if level is not None and level not in alert_ops.SEVERITIES:
                raise RequestError("invalid_severity", severity=level, valid=alert_ops.SEVERITIES)
        if severity:
            test = test & (F.col("severity") == severity)
        if min_severity:
            test = test & F.col("severity").isin(alert_ops.at_or_above(min_severity))
        if categories is not None:
            listed = list(categories)
            bounded(len(listed), MAX_SYMBOLS)
            unknown = [c for c in listed if c not in ALERT_CATEGORIES]
            if unknown:
                raise RequestError("invalid_categories", invalid=unknown)
            test = test & F.col("category").isin(listed)
        return test

    def alerts(self, minutes: int = 240, severity: str | None = None, categories: Iterable[str] | None = None, symbols: Iterable[str] | None = None, limit: int = 100) -> DataFrame:
        rows = self._alerts().filter((F.col("created_us") >= self._since(minutes)) & self._alert_filter(severity, None, categories) & F.col("category").isin(list(ALERT_CATEGORIES)))
        return self._of_symbols(rows, symbols_of(symbols)).orderBy(F.desc("created_us"), F.desc("seq")).limit(bounded(limit, MAX_CURSOR_ITEMS))

    def alerts_since(self, cursor: int = 0, limit: int = 100, severity: str | None = None, min_severity: str | None = None, categories: Iterable[str] | None = None) -> dict[str, object]:
        return self._delta(self._alerts().filter(self._alert_filter(severity, min_severity, categories)), cursor, limit, MAX_CURSOR_ITEMS)

    def acknowledge(self, store: Published, alert_id: str) -> bool:
        """Mark an alert of the alert store as seen; whether there was such an alert."""
        return acknowledge(store, [alert_id]) > 0

    def subscription(self, acknowledged: dict[str, Iterable[str]] | None = None) -> dict[str, object]:
        """What is asked of the feeds beside what they confirmed, by channel: ``missing`` was asked and not confirmed."""
        asked = {"news": ["*"], **{c: list(self.watchlist) for c in ("trades", "quotes", "bars", "updatedBars", "dailyBars", "lulds")}, "statuses": ["*"]}
        confirmed = {c: sorted(acknowledged.get(c, ())) for c in asked} if acknowledged is not None else {c: [] for c in asked}
        return {"requested": asked, "acknowledged": confirmed, "missing": {c: sorted(set(v) - set(confirmed[c])) for c, v in asked.items()}}

    def fetch_history(self, store: Published, pages: DataFrame, batch: int, symbols: Iterable[str], days: int = 30, max_articles: int = 200) -> dict[str, object]:
        """Bring the newest articles of some symbols from a paged source into the published articles, without alerts."""
        wanted = symbols_of(symbols, MAX_HISTORY_SYMBOLS)
        if not wanted:
            raise RequestError("no_symbols")
        if not 1 <= days <= MAX_HISTORY_DAYS:
            raise RequestError("invalid_days", min=1, max=MAX_HISTORY_DAYS)
        run, _ = jobs.ingest_pages(store, pages, self._as_of(), batch, wanted, self.as_of_us - days * 86_400_000_000, bounded(max_articles, MAX_HISTORY_ARTICLES))
        return {"symbols": wanted, "window_days": days, "ingested": run.ingested, **vars(run), "status": "incomplete" if run.failure else "ok"}

    def run_backfill(self, store: Published, alert_store: Published, pages: DataFrame, batch: int, minutes: int = 30) -> dict[str, object]:
        """Bring the articles of the last ``minutes`` into the published articles, and their alerts, but for latency, into the alert store."""
        if not 1 <= minutes <= MAX_BACKFILL_MINUTES:
            raise RequestError("invalid_minutes", min=1, max=MAX_BACKFILL_MINUTES)
        run, states = jobs.ingest_pages(store, pages, self._as_of(), batch, since_us=self._since(minutes))
        if states is not None:
            insert_alerts(alert_store, jobs.alerts_of(states, self.rules(), self.interest, list(self.watched)), batch)
        return {"window_minutes": minutes, "ingested": run.ingested, **vars(run), "status": "incomplete" if run.failure else "ok"}

    def _as_of(self) -> Column:
        return F.timestamp_micros(F.lit(self.as_of_us))

    def resource(self, path: str) -> DataFrame | dict[str, object]:
        """What a name stands for: recent, alerts, symbols, symbols/X, article/N, stats/latency, stats/ingestion, subscription, watchlist, latest/X, clock, halts."""
        name, _, rest = path.partition("/")
        plain: dict[str, Callable[[], DataFrame | dict[str, object]]] = {
            "recent": lambda: self.recent_news(60, limit=50, fields="compact"), "alerts": lambda: self.alerts(240, limit=100), "symbols": lambda: self.symbol_map(60, 1),
            "stats/latency": self.latency_stats, "stats/ingestion": self.ingestion_stats, "subscription": self.subscription,
            "watchlist": lambda: {"watchlist": self.watchlist}, "clock": self.clock, "halts": lambda: self.halts(240, limit=100),
        }
        of: dict[str, Callable[[], DataFrame | dict[str, object]]] = {"symbols": lambda: self.news_for_symbols([rest]), "article": lambda: self.article(int(rest)), "latest": lambda: self.latest([rest])}
        known = plain.get(path) or (of.get(name) if rest else None)
        if known is None:
            raise RequestError("unknown_resource", resource=path)
        return known()

    def rules(self) -> alert_ops.Rules:
        return alert_ops.Rules().extended(self.groups)

    def evaluate(self, articles: DataFrame, latency_ms: int | None = 30_000) -> DataFrame:
        """Alerts of articles under the rules and interest symbols in force."""
        return alert_ops.article_alerts(articles, self.rules(), self.interest, latency_ms)

    def set_keyword_group(self, group: str, phrases: list[str], critical_phrases: list[str] = (), bullish: list[str] = (), bearish: list[str] = ()) -> None:
        name = group.strip().lower()
        if not name or not (phrases or critical_phrases):
            raise RequestError("invalid_group", group=group)
        if name not in self.groups:
            bounded(len(self.groups) + 1, MAX_GROUPS)
        for words in (phrases, critical_phrases, bullish, bearish):
            bounded(len(words), MAX_PHRASES)
            for w in words:
                bounded(len(w), MAX_PHRASE_CHARS)
        self.groups |= alert_ops.clean_overrides({name: {"phrases": list(phrases), "critical_phrases": list(critical_phrases), "bullish": list(bullish), "bearish": list(bearish)}})

    def delete_keyword_group(self, group: str) -> bool:
        return self.groups.pop(group.strip().lower(), None) is not None

    def keyword_groups(self) -> list[dict[str, object]]:
        return [{"group": g, "builtin": g in alert_ops.KEYWORDS, "runtime": g in self.groups, "category": alert_ops.category(g), "phrases": p} for g, p in self.rules().groups.items()]

    @staticmethod
    def _changed(now: list[str], values: Iterable[str], mode: str, most: int) -> list[str]:
        given = set(symbols_of(values, most) or [])
        ways: dict[str, Callable[[], set[str]]] = {"replace": lambda: given, "add": lambda: set(now) | given, "remove": lambda: set(now) - given, "clear": set}
        if mode not in ways:
            raise RequestError("invalid_mode", mode=mode, valid=list(ways))
        out = sorted(ways[mode]())
        if out:
            bounded(len(out), most)
        return out

    def set_interest(self, symbols: Iterable[str], mode: str = "replace") -> list[str]:
        self.interest = self._changed(self.interest, symbols, mode, MAX_INTEREST)
        return self.interest

    def set_watchlist(self, symbols: Iterable[str], mode: str = "replace") -> list[str]:
        self.watchlist = self._changed(self.watchlist, symbols, mode, MAX_WATCHLIST)
        return self.watchlist

    def watch_story(self, article_id: int) -> None:
        if article_id not in self.watched:
            bounded(len(self.watched) + 1, MAX_WATCHED)
        self.watched[article_id] = self.as_of_us

    def unwatch_story(self, article_id: int) -> bool:
        return self.watched.pop(article_id, None) is not None

    def watched_stories(self) -> DataFrame:
        rows = self.spark.createDataFrame(list(self.watched.items()), "id long, watched_us long")
        return rows.join(self._articles().select("id", "headline", "update_count", "at_us"), "id", "left")

    def watched_updates(self, states: DataFrame) -> DataFrame:
        """Of updates applied by ``upsert.apply_updates``, an alert for each change of content of a watched story."""
        return alert_ops.watched_story_alerts(states, list(self.watched), self.rules())

    # -- market

    def _requested(self, symbols: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(s,) for s in symbols], "symbol string")

    def trades_window(self, symbol: str, minutes: int = 5, limit: int = 200) -> DataFrame:
        rows = self.rows("stock_trades").filter((F.col("symbol") == symbol.strip().upper()) & (F.col("ts_us") >= self._since(minutes, MAX_WINDOW_MINUTES)))
        newest = rows.orderBy(F.desc("ts_us"), F.desc("ingest_seq")).limit(bounded(limit, MAX_WINDOW_ROWS))
        return newest.orderBy("ts_us", "ingest_seq").select("ts_us", "price", "size", "exchange", "conditions", "tape")

    def quotes_window(self, symbol: str, minutes: int = 5, limit: int = 200) -> DataFrame:
        rows = self.rows("stock_quotes").filter((F.col("symbol") == symbol.strip().upper()) & (F.col("ts_us") >= self._since(minutes, MAX_WINDOW_MINUTES)))
        newest = rows.orderBy(F.desc("ts_us"), F.desc("ingest_seq")).limit(bounded(limit, MAX_WINDOW_ROWS))
        return newest.orderBy("ts_us", "ingest_seq").select("ts_us", "bid_price", "bid_size", "ask_price", "ask_size", "tape")

    def bars(self, symbol: str, timeframe: str = "1min", start: str | None = None, end: str | None = None, limit: int = 390) -> DataFrame:
        if timeframe not in (*bar_ops.STORED_TIMEFRAMES, *bar_ops.AGGREGATE_TIMEFRAMES):
            raise RequestError("invalid_timeframe", timeframe=timeframe)
        stored = timeframe if timeframe in bar_ops.STORED_TIMEFRAMES else "1min"
        rows = self.rows("stock_bars").filter((F.col("symbol") == symbol.strip().upper()) & (F.col("timeframe") == stored))
        lower, upper = time_bound("start", start), time_bound("end", end)
        if lower is not None:
            rows = rows.filter(F.col("ts") >= lower // 1_000_000)
        if upper is not None:
            rows = rows.filter(F.col("ts") <= upper // 1_000_000)
        if timeframe in bar_ops.AGGREGATE_TIMEFRAMES:
            rows = bar_ops.rebucket(rows, bar_ops.AGGREGATE_TIMEFRAMES[timeframe])
        return rows.orderBy(F.desc("ts")).limit(bounded(limit, MAX_BARS)).orderBy("ts").select("ts", *bar_ops.BAR_VALUES)

    def bars_since(self, cursor: int = 0, symbols: Iterable[str] | None = None, timeframe: str | None = None, limit: int = 500) -> dict[str, object]:
        rows = self.rows("stock_bars")
        wanted = symbols_of(symbols)
        if wanted:
            rows = rows.filter(F.col("symbol").isin(wanted))
        if timeframe is not None:
            if timeframe not in bar_ops.STORED_TIMEFRAMES:
                raise RequestError("invalid_timeframe", timeframe=timeframe)
            rows = rows.filter(F.col("timeframe") == timeframe)
        return self._delta(rows, cursor, limit, MAX_BARS_CURSOR)

    def halts(self, minutes: int = 240, symbols: Iterable[str] | None = None, limit: int = 100) -> DataFrame:
        rows = self._statuses().filter(F.col("ts_us") >= self._since(minutes))
        wanted = symbols_of(symbols)
        rows = rows if wanted is None else rows.filter(F.col("symbol").isin(wanted))
        return rows.orderBy(F.desc("ts_us"), F.desc("event_id")).limit(bounded(limit, MAX_STATUSES))

    def bands(self, minutes: int = 240, symbols: Iterable[str] | None = None, limit: int = 100) -> DataFrame:
        rows = self.rows("stock_lulds", "symbol string, ts_us long, limit_up double, limit_down double, indicator string, tape string").filter(F.col("ts_us") >= self._since(minutes))
        wanted = symbols_of(symbols)
        rows = rows if wanted is None else rows.filter(F.col("symbol").isin(wanted))
        return rows.orderBy(F.desc("ts_us")).limit(bounded(limit, MAX_STATUSES))

    def symbol_context(self, symbols: Iterable[str]) -> DataFrame:
        wanted = symbols_of(symbols, MAX_CONTEXT_SYMBOLS)
        if not wanted:
            raise RequestError("no_symbols")
        rows = self.rows("stock_bars").filter(F.col("symbol").isin(wanted))
        return context.symbol_context(rows, tape.halted(self._statuses()), self.as_of_us // 1_000_000)

    def tape_stats(self, symbol: str, minutes: int = 30, bucket_seconds: int = 60, block_size: int = 1000) -> DataFrame:
        since = self._since(minutes, MAX_WINDOW_MINUTES)
        bucket = max(10, min(bucket_seconds, 3600))
        if max(1, minutes) * 60 // bucket > MAX_TAPE_BUCKETS:
            raise RequestError("too_many_buckets", max_buckets=MAX_TAPE_BUCKETS)
        of = lambda name: self.rows(name).filter((F.col("symbol") == symbol.strip().upper()) & (F.col("ts_us") >= since))
        digest = tape.tape_stats(of("stock_trades"), bucket * 1_000_000, max(1, block_size))
        return tape.tape_with_quotes(digest, tape.quote_stats(of("stock_quotes"), bucket * 1_000_000)).orderBy("bucket_us")

    def watchlist_pulse(self, minutes: int = 5, symbols: Iterable[str] | None = None) -> DataFrame:
        wanted = symbols_of(symbols) or self.watchlist
        if not wanted:
            raise RequestError("no_symbols")
        recent = F.col("symbol").isin(wanted) & (F.col("ts_us") >= self._since(minutes, MAX_WINDOW_MINUTES))
        out = tape.pulse(self.rows("stock_trades").filter(recent), self.rows("stock_quotes").filter(recent), self._requested(wanted))
        flags = tape.halted(self._statuses()).select("symbol", F.lit(True).alias("halted"))
        return out.join(flags, "symbol", "left").fillna(False, ["halted"]).orderBy("symbol")

    def latest(self, symbols: Iterable[str]) -> DataFrame:
        """The newest trade, quote and minute bar of each symbol, with age and staleness."""
        wanted = symbols_of(symbols)
        if not wanted:
            raise RequestError("no_symbols")
        of = lambda name: self.rows(name).filter(F.col("symbol").isin(wanted))
        trade = tape.latest(of("stock_trades").filter("price IS NOT NULL"), ["symbol"], ["ts_us", "ingest_seq"], ["ts_us", "price", "size"]).withColumnRenamed("ts_us", "trade_us")
        quote = tape.latest(of("stock_quotes"), ["symbol"], ["ts_us", "ingest_seq"], ["ts_us", "bid_price", "ask_price"]).withColumnRenamed("ts_us", "quote_us")
        bar = tape.latest(of("stock_bars").filter("timeframe = '1min'"), ["symbol"], ["ts"], ["ts", "close"]).withColumnRenamed("ts", "bar_ts")
        out = self._requested(wanted).join(trade, "symbol", "left").join(quote, "symbol", "left").join(bar, "symbol", "left")
        age = F.greatest(F.lit(0.0), (F.lit(self.as_of_us) - F.greatest("trade_us", "quote_us", F.col("bar_ts") * 1_000_000)) / 1e6)
        missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(n)) for n, c in (("trade", "trade_us"), ("quote", "quote_us"), ("bar", "bar_ts")))))
        return out.withColumn("age_s", age).withColumn("stale", F.coalesce(age > STALE_SECONDS, F.lit(True))).withColumn("missing", missing)

    def snapshots(self, symbols: Iterable[str]) -> DataFrame:
        """The newest trade and quote, the newest minute bar, and the newest two daily bars of each symbol."""
        wanted = symbols_of(symbols, MAX_SNAPSHOTS)
        if not wanted:
            raise RequestError("no_symbols")
        bar = ["ts", *bar_ops.BAR_VALUES]
        of = lambda name: self.rows(name).filter(F.col("symbol").isin(wanted))
        one = lambda rows, order, values, name: rows.groupBy("symbol").agg(F.max_by(F.struct(*values), F.struct(*order)).alias(name))
        days = bar_ops.newest(of("stock_bars").filter("timeframe = '1day'"), ["symbol"], [F.desc("ts")], 2)
        daily = days.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(*bar))).alias("_d"))
        last = F.size("_d")
        daily = daily.select("symbol", F.get("_d", last - 1).alias("daily_bar"), F.when(last > 1, F.get("_d", last - 2)).alias("prev_daily_bar"))
        parts = (
            one(of("stock_trades").filter("price IS NOT NULL"), ["ts_us", "ingest_seq"], ["ts_us", "price", "size", "exchange"], "latest_trade"),
            one(of("stock_quotes"), ["ts_us", "ingest_seq"], ["ts_us", "bid_price", "bid_size", "ask_price", "ask_size"], "latest_quote"),
            one(of("stock_bars").filter("timeframe = '1min'"), ["ts"], bar, "minute_bar"), daily,
        )
        out = self._requested(wanted)
        for part in parts:
            out = out.join(part, "symbol", "left")
        return out

    def _daily(self) -> DataFrame:
        days = bar_ops.newest(self.rows("stock_bars").filter("timeframe = '1day'"), ["symbol"], [F.desc("ts")], 2)
        both = days.groupBy("symbol").agg(F.max_by("close", "ts").alias("price"), F.min_by("close", "ts").alias("before"), F.max_by("volume", "ts").alias("volume"), F.max_by("trade_count", "ts").alias("trade_count"), F.count(F.lit(1)).alias("_n"))
        return both.withColumn("percent_change", F.when(F.col("_n") == 2, (F.col("price") - F.col("before")) / F.nullif(F.col("before"), F.lit(0.0)) * 100.0)).drop("_n", "before")

    def movers(self, top: int = 10) -> DataFrame:
        top = bounded(top, MAX_TOP)
        days = self._daily().filter("percent_change IS NOT NULL")
        up = days.orderBy(F.desc("percent_change"), "symbol").limit(top).withColumn("side", F.lit("gainer"))
        return up.unionAll(days.orderBy("percent_change", "symbol").limit(top).withColumn("side", F.lit("loser")))

    def most_actives(self, by: str = "volume", top: int = 10) -> DataFrame:
        if by not in ("volume", "trades"):
            raise RequestError("invalid_by", by=by, valid=["volume", "trades"])
        return self._daily().orderBy(F.desc_nulls_last("volume" if by == "volume" else "trade_count"), "symbol").limit(bounded(top, 2 * MAX_TOP))

    def market_pulse(self, top: int = 10, news_minutes: int = 120) -> DataFrame:
        """Movers and most active symbols as one list, with news, halts and watchlist."""
        top = bounded(top, MAX_TOP)
        moved = self.movers(top).select("symbol", "side", "price", "percent_change", F.lit(None).cast("long").alias("volume"))
        active = self.most_actives(top=top).select("symbol", F.lit("most_active").alias("side"), F.lit(None).cast("double").alias("price"), F.lit(None).cast("double").alias("percent_change"), "volume")
        fused = moved.unionAll(active).groupBy("symbol").agg(F.array_sort(F.collect_set("side")).alias("sources"), F.max("price").alias("price"), F.max("percent_change").alias("percent_change"), F.max("volume").alias("volume"))
        index = self.rows("news_symbol_index").filter(instant_us("received_at") >= self._since(min(news_minutes, MAX_SYMBOL_MAP_MINUTES)))
        news = index.join(fused.select("symbol"), "symbol", "left_semi").groupBy("symbol").agg(F.count_distinct("article_id").alias("news_count"))
        flags = tape.halted(self._statuses()).select("symbol", F.lit(True).alias("halted"))
        out = fused.join(news, "symbol", "left").join(flags, "symbol", "left").fillna(0, ["news_count"]).fillna(False, ["halted"])
        out = out.withColumn("on_watchlist", F.col("symbol").isin(self.watchlist) if self.watchlist else F.lit(False))
        return out.orderBy(F.desc(F.abs(F.coalesce("percent_change", F.lit(0.0)))), F.desc(F.coalesce("volume", F.lit(0))), "symbol")

    def calendar(self, days: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
        """Trading days (``date``, ...) from ``start`` to ``end``, 90 days at most; from today on by default."""
        first = (time_bound("start", start) if start else self.as_of_us) // 86_400_000_000
        last = time_bound("end", end) // 86_400_000_000 if end else first + MAX_CALENDAR_DAYS
        bounded(last - first, MAX_CALENDAR_DAYS)
        day = F.unix_date(F.to_date("date"))
        return days.filter(day.between(first, last)).orderBy("date")

    def corporate_actions(self, actions: DataFrame, symbols: Iterable[str] | None = None, types: Iterable[str] | None = None, start: str | None = None, end: str | None = None, limit: int = 100) -> DataFrame:
        """Actions (``symbol``, ``type``, ``date``, ...) of symbols and types in a range of days, newest first."""
        rows, wanted = actions, symbols_of(symbols)
        if wanted:
            rows = rows.filter(F.col("symbol").isin(wanted))
        if types is not None:
            rows = rows.filter(F.col("type").isin([t.strip().lower() for t in types]))
        lower, upper = time_bound("start", start), time_bound("end", end)
        day = F.unix_date(F.to_date("date"))
        if lower is not None and upper is not None:
            bounded((upper - lower) // 86_400_000_000, MAX_CALENDAR_DAYS)
        rows = rows if lower is None else rows.filter(day >= lower // 86_400_000_000)
        rows = rows if upper is None else rows.filter(day <= upper // 86_400_000_000)
        return rows.orderBy(F.desc("date"), "symbol").limit(bounded(limit, MAX_ACTIONS))

    def clock(self, calendar: DataFrame | None = None) -> dict[str, object]:
        """Phase of the market and seconds to the next open and close, by a calendar (``date``, ``open_us``, ``close_us``) if there is one."""
        now = self.as_of_us
        phase = self.spark.range(1).select(market_phase(F.lit(now // 1_000_000)).alias("p")).first()["p"]
        out: dict[str, object] = {"as_of_us": now, "phase": phase, "is_open": phase == "open"}
        if calendar is not None:
            row = calendar.agg(
                F.bool_or((F.col("open_us") <= now) & (F.col("close_us") > now)).alias("open"),
                F.min(F.when(F.col("open_us") > now, F.col("open_us"))).alias("next_open"), F.min(F.when(F.col("close_us") > now, F.col("close_us"))).alias("next_close"),
                F.bool_or(floor_to(F.col("open_us"), 86_400_000_000) == now - now % 86_400_000_000).alias("today"),
            ).first()
            is_open = bool(row["open"])
            if not is_open and (phase == "open" or not row["today"]):
                phase = "closed"
            out |= {"is_open": is_open, "phase": "open" if is_open else phase}
            out |= {f"seconds_to_{k[5:]}": None if row[k] is None else (row[k] - now) // 1_000_000 for k in ("next_open", "next_close")}
        return out

    def loop_context(self, calendar: DataFrame | None = None, problems: Iterable[str] = ()) -> dict[str, object]:
        """The clock with a suggestion when to poll next: twice as long while streams have problems, 900 s at most."""
        out, reasons = self.clock(calendar), list(problems)
        wait = {"open": 30, "premarket": 120, "afterhours": 120, "unknown": 300}.get(str(out["phase"]), 600)
        return out | {"suggested_next_poll_seconds": min(wait * 2, 900) if reasons else wait, "reasons": reasons}

    def poll(self, news_cursor: int = -1, alerts_cursor: int = -1, bars_cursor: int = -1, symbols: Iterable[str] | None = None, include: Iterable[str] = ("news", "alerts", "bars", "snapshot", "context")) -> dict[str, object]:
        """All deltas in one call; a part that fails gives its error and leaves the others alone."""
        wanted = symbols_of(symbols) or self.watchlist
        parts: dict[str, Callable[[], object]] = {
            "news": lambda: self.news_since(news_cursor, symbols=symbols), "alerts": lambda: self.alerts_since(alerts_cursor), "bars": lambda: self.bars_since(bars_cursor, symbols=symbols),
            "snapshot": lambda: {"rows": self.latest(wanted[:MAX_SYMBOLS]), "omitted": max(0, len(wanted) - MAX_SYMBOLS)}, "context": self.loop_context,
        }
        out: dict[str, object] = {}
        for name in include:
            if name not in parts:
                raise RequestError("invalid_include", include=name, valid=list(parts))
            try:
                out[name] = parts[name]()
            except RequestError as e:
                out[name] = {"error": e.code, **e.fields}
        return out

    def started(self) -> dict[str, int]:
        """The cursors to start from."""
        latest = lambda rows: rows.agg(F.max("seq").alias("m")).first()["m"] or 0
        return {"news_cursor": latest(self.rows("news_articles")), "alerts_cursor": latest(self._alerts()), "bars_cursor": latest(self.rows("stock_bars"))}


#: The categories of alerts.
ALERT_CATEGORIES = (
    "held_or_interested_symbol", "breaking_keyword", "custom_keyword", "corporate_action_keyword", "earnings_keyword", "analyst_keyword", "legal_regulatory_keyword",
    "financing_keyword", "mna_keyword", "halt_risk_keyword", "high_latency", "stream_error", "stream_stale", "entitlement_error", "gap_fill_failure", "coverage_gap",
    "persist_failure", "watched_story_update", "price_move", "volume_spike", "day_range_break", "trading_halt", "trading_resume", "luld",
)
