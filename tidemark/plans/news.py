"""The registered news queries, with their SQL. "Now" is the newest arrival in the table read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.html import html_text
from tidemark.functions.text import content_hash, source_name, symbol_list, truncate
from tidemark.functions.times import DAY_US, instant_us
from tidemark.operators import alerts, retention, search, upsert
from tidemark.operators.bars import newest
from tidemark.operators.cursors import page
from tidemark.operators.ordered import order_statistics, percentile_ranks, with_positions
from tidemark.plans.market import newest_value
from tidemark.plans.problems import sql_instant_us
from tidemark.session import spread
from tidemark.sources.tables import table

HOUR_US = 3_600_000_000


def timed_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles with instants: ``at_us`` is the update, else creation, else arrival."""
    rows = table(spark, d, "news_articles")
    made, updated, seen = instant_us("created_at"), instant_us("updated_at"), instant_us("first_seen_at")
    return rows.withColumns({"created_us": made, "updated_us": updated, "seen_us": seen}).withColumn("at_us", F.coalesce("updated_us", "created_us", "seen_us"))


def _index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news_symbol_index").withColumn("received_us", instant_us("received_at"))


def newest_arrival(spark: SparkSession, d: str) -> int:
    return newest_value(table(spark, d, "news_articles").select(instant_us("first_seen_at").alias("t")), "t")


def article_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The normalised symbols of every article."""
    return table(spark, d, "news_articles").select("id", F.array_join(symbol_list("symbols_json"), ",").alias("symbols"))


def article_instants(spark: SparkSession, d: str) -> DataFrame:
    return timed_articles(spark, d).select("id", "created_us", "updated_us", "seen_us", "at_us", source_name("source").alias("source"))


def article_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news_articles").select("id", content_hash(F.col("headline"), F.col("summary"), F.col("content_html")).alias("content_hash"))


def article_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of every article's HTML."""
    return table(spark, d, "news_articles").select("id", html_text("content_html").alias("text"), (F.trim("content_html") != "").alias("has_content"))


def compact_articles(spark: SparkSession, d: str) -> DataFrame:
    """The compact projection; the update falls back to the creation."""
    rows = table(spark, d, "news_articles")
    return rows.select("id", "headline", F.array_join(symbol_list("symbols_json"), ",").alias("symbols"), "source", F.coalesce(F.nullif("updated_at", F.lit("")), "created_at").alias("updated_at"), "url")


def full_articles(spark: SparkSession, d: str) -> DataFrame:
    """The full projection with texts cut at 4000 characters."""
    rows = table(spark, d, "news_articles")
    return rows.select("id", "headline", "summary", "author", "url", "source", "update_count", "latency_ms", truncate(F.col("content_text"), 4000).alias("content_text"))


def recent_articles(spark: SparkSession, d: str) -> DataFrame:
    """The 200 newest articles of the last day."""
    since = newest_arrival(spark, d) - DAY_US
    recent = (F.col("updated_us") >= since) | (F.col("created_us") >= since) | (F.col("seen_us") >= since)
    return timed_articles(spark, d).filter(recent).orderBy(F.desc("at_us"), F.desc("id")).limit(200).select("id", "headline", "at_us")


def articles_for_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The 25 newest articles of every symbol."""
    index = _index(spark, d).select("symbol", "article_id").distinct()
    both = index.join(timed_articles(spark, d).select(F.col("id").alias("article_id"), "headline", "at_us"), "article_id")
    return newest(both, ["symbol"], [F.desc("at_us"), F.desc("article_id")], 25).select("symbol", "article_id", "headline", "at_us")


def symbol_map(spark: SparkSession, d: str) -> DataFrame:
    """The 500 symbols with most articles."""
    counts = table(spark, d, "news_symbol_index").groupBy("symbol").agg(F.count_distinct("article_id").alias("articles"))
    return counts.filter("articles >= 2").orderBy(F.desc("articles"), "symbol").limit(500)


def _alert_input(spark: SparkSession, d: str) -> DataFrame:
    return spread(timed_articles(spark, d)).select(
        "id", "headline", "summary", "content_text", symbol_list("symbols_json").alias("symbols"), "latency_ms", "seen_us",
        instant_us("last_seen_at").alias("received_us"), F.greatest("created_us", "updated_us").alias("latest_us"),
        content_hash(F.col("headline"), F.col("summary"), F.col("content_html")).alias("content_hash"),
    )


#: A group of words beside the built-in ones.
EXTRA = {"commodities": {"phrases": ["copper", "steel"], "bullish": ["rallied"], "bearish": ["slipped"]}}


def keyword_alert_rows(spark: SparkSession, d: str) -> DataFrame:
    return alerts.article_alerts(_alert_input(spark, d), alerts.Rules().extended(EXTRA), ["SEVI"])


def keyword_alerts(spark: SparkSession, d: str) -> DataFrame:
    """All alerts of all articles."""
    return keyword_alert_rows(spark, d).drop("reason").withColumn("symbols", F.array_join("symbols", ",")).withColumn("matches", F.array_join("matches", ","))


def alert_counts(spark: SparkSession, d: str) -> DataFrame:
    """Alerts by category, severity and direction."""
    return keyword_alert_rows(spark, d).groupBy("category", "severity", "direction").agg(F.count(F.lit(1)).alias("alerts"))


def _stamped(spark: SparkSession, d: str) -> DataFrame:
    hashes = _alert_input(spark, d).select(F.col("id").alias("article_id"), "content_hash", F.col("seen_us").alias("created_us"))
    return keyword_alert_rows(spark, d).join(hashes, "article_id")


def alerts_without_copies(spark: SparkSession, d: str) -> DataFrame:
    """Alerts kept when the same content alerted within a day under another id."""
    return alerts.without_copies(_stamped(spark, d).select("article_id", "category", "content_hash", "created_us"))


def symbol_pulse(spark: SparkSession, d: str) -> DataFrame:
    """Articles, alerts by direction and the newest headline of every symbol."""
    index = _index(spark, d).select("symbol", "article_id").distinct()
    counts = index.groupBy("symbol").agg(F.count(F.lit(1)).alias("articles"))
    heads = index.join(timed_articles(spark, d).select(F.col("id").alias("article_id"), "headline", "at_us"), "article_id")
    newest_head = heads.filter("at_us IS NOT NULL").groupBy("symbol").agg(F.max_by(F.struct("headline", "at_us"), F.struct("at_us", "article_id")).alias("_h"))
    named = keyword_alert_rows(spark, d).select(F.explode("symbols").alias("symbol"), "direction")
    ways = named.groupBy("symbol").agg(*(F.count_if(F.col("direction") == w).alias(w) for w in ("bullish", "bearish", "neutral")))
    out = counts.join(newest_head, "symbol", "left").join(ways, "symbol", "left")
    zero = F.lit(0).cast("long")
    return out.select("symbol", "articles", F.col("_h.headline").alias("latest_headline"), F.col("_h.at_us").alias("latest_us"), *(F.coalesce(w, zero).alias(w) for w in ("bullish", "bearish", "neutral")))


def breaking_digest(spark: SparkSession, d: str) -> DataFrame:
    """Of the 200 newest articles the 25 newest that carry a marker; markers here are words that occur."""
    rows = timed_articles(spark, d).orderBy(F.desc("at_us"), F.desc("id")).limit(200)
    text = F.lower(F.concat_ws(" ", "headline", "summary", "content_text"))
    marked = F.lit(False)
    for m in [*alerts.DIGEST_MARKERS, "guidance"]:
        marked = marked | F.contains(text, F.lit(m))
    return rows.filter(marked).orderBy(F.desc("at_us"), F.desc("id")).limit(25).select("id", "headline", truncate(F.col("summary"), 240).alias("summary"), "at_us")


def latency_stats(spark: SparkSession, d: str) -> DataFrame:
    """Exact percentiles of the latency, by index on the sorted values."""
    rows = table(spark, d, "news_articles").filter("latency_ms >= 0").select("latency_ms", F.lit(0).alias("_g"))
    picked = order_statistics(rows, ["_g"], "latency_ms", percentile_ranks(50, 90, 99))
    totals = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("sample_count"), F.max("latency_ms").alias("max_ms"), F.expr("sum(latency_ms) div count(1)").alias("avg_ms"))
    return picked.join(totals, "_g").select(*(F.col(p).cast("long").alias(f"{p}_ms") for p in ("p50", "p90", "p99")), "sample_count", "max_ms", "avg_ms")


def ingestion_stats(spark: SparkSession, d: str) -> DataFrame:
    one = lambda df, value: df.agg(value.cast("long").alias("n"))
    parts = {
        "articles": one(table(spark, d, "news_articles"), F.count(F.lit(1))),
        "versions": one(table(spark, d, "news_article_versions"), F.count(F.lit(1))),
        "symbols": one(table(spark, d, "news_symbol_index"), F.count_distinct("symbol")),
        "sources": one(table(spark, d, "news_articles"), F.count_distinct("source")),
    }
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("measure"), "n")
        out = row if out is None else out.unionAll(row)
    return out


def articles_since(spark: SparkSession, d: str) -> DataFrame:
    """A page of 500 articles after half of all numbers."""
    rows = table(spark, d, "news_articles").select("id", "headline", "seq")
    return page(rows, "seq", newest_value(rows, "seq") // 2, 500)


def oldest_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The oldest number of every symbol's feed, by which gaps are told."""
    index = table(spark, d, "news_symbol_index").select("symbol", F.col("article_id").alias("id")).distinct()
    return index.join(table(spark, d, "news_articles").select("id", "seq"), "id").groupBy("symbol").agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def seq_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Dense numbers by first arrival, then id, without one task holding all rows."""
    rows = timed_articles(spark, d).select("id", F.coalesce("seen_us", F.lit(0)).alias("seen_us"), F.lit(0).alias("_g"))
    # articles without arrival come first and are cut by their ids, the others by the hour
    slot = F.when(F.col("seen_us") == 0, F.expr("id div 4096") - (1 << 50)).otherwise(F.expr(f"seen_us div {HOUR_US}"))
    placed = with_positions(rows.withColumn("_hour", slot), ["_g"], "_hour", ["seen_us", "id"])
    return placed.select("id", (F.col("pos") + 1).cast("long").alias("seq"))


def search_like(spark: SparkSession, d: str) -> DataFrame:
    """All articles with a fragment of a word."""
    return search.containing(table(spark, d, "news_articles"), "uidanc").select("id", "headline")


def spread_texts(spark: SparkSession, d: str) -> DataFrame:
    """The texts that are searched, over all cores."""
    return spread(table(spark, d, "news_articles").select("id", *search.FIELDS))


def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """All articles with both terms in any inflection, ranked."""
    return search.scores(spread_texts(spark, d), "copper revenues").select("id", F.round("score", 6).alias("score"))


def version_feed(spark: SparkSession, d: str) -> DataFrame:
    """The versions table as a feed of updates."""
    v = table(spark, d, "news_article_versions")
    text = lambda c: F.lit(None).cast("string").alias(c)
    return v.select(
        F.col("article_id").alias("id"), "headline", F.array().cast("array<string>").alias("symbols"), "summary", text("author"), text("created_at"), "updated_at", text("content_html"),
        text("content_text"), text("url"), "source", "received_at", F.lit(None).cast("long").alias("latency_ms"), F.lit(0).alias("is_content_present"),
        instant_us("received_at").alias("received_us"), "version_id",
    )


def article_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The articles after all versions were applied in order of arrival."""
    states = upsert.apply_updates(version_feed(spark, d), ["received_us", "version_id"])
    return upsert.current(states).select("id", "headline", "summary", "updated_at", "source", "update_count", "first_seen_at", "last_seen_at")


def article_version_rows(spark: SparkSession, d: str) -> DataFrame:
    """The versions that are new or change content."""
    states = upsert.apply_updates(version_feed(spark, d), ["received_us", "version_id"])
    return upsert.new_versions(states).select("id", "version_id")


def article_versions(spark: SparkSession, d: str) -> DataFrame:
    """The newest 50 versions of every article, and how many it has."""
    v = table(spark, d, "news_article_versions").withColumn("received_us", instant_us("received_at"))
    counted = v.groupBy("article_id").agg(F.count(F.lit(1)).alias("versions"))
    top = newest(v, ["article_id"], [F.desc("received_us"), F.desc("version_id")], 50)
    return top.join(counted, "article_id").select("article_id", "version_id", "headline", "received_us", "versions")


def retention_keep(spark: SparkSession, d: str) -> DataFrame:
    """Rows that stay of each table if articles are kept for two days."""
    rows = timed_articles(spark, d)
    gone = retention.expired(rows, F.col("seen_us"), newest_arrival(spark, d) - 2 * DAY_US)
    kept = rows.withColumnRenamed("id", "article_id").select("article_id")
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("table_name"), "n")
    out = count(retention.keep_children(kept, gone), "news_articles")
    for n in ("news_article_versions", "news_symbol_index"):
        out = out.unionAll(count(retention.keep_children(table(spark, d, n).select("article_id"), gone), n))
    return out


QUERIES = {
    f.__name__: f
    for f in (
        article_symbols, article_instants, article_hashes, article_texts, compact_articles, full_articles, recent_articles, articles_for_symbols, symbol_map, keyword_alerts,
        alert_counts, alerts_without_copies, symbol_pulse, breaking_digest, latency_stats, ingestion_stats, articles_since, oldest_numbers, seq_backfill, search_like, search_terms,
        article_upsert, article_version_rows, article_versions, retention_keep,
    )
}

_SYMBOLS = """coalesce(list_sort(list_distinct(list_filter(list_transform(from_json(symbols_json, '["VARCHAR"]'), lambda x: upper(trim(x))), lambda x: x IS NOT NULL AND x <> ''))), [])"""
_ART = f"""(SELECT *, coalesce(updated_us, created_us, seen_us) AS at_us FROM (SELECT *, {sql_instant_us('created_at')} AS created_us, {sql_instant_us('updated_at')} AS updated_us, {sql_instant_us('first_seen_at')} AS seen_us FROM news_articles))"""
_HASH = "sha256(coalesce(headline, '') || chr(0) || coalesce(summary, '') || chr(0) || coalesce(content_html, ''))"
_INDEX = "(SELECT DISTINCT symbol, article_id FROM news_symbol_index)"


def _word(phrase: str) -> str:
    edge = lambda c: r"\b" if c.isalnum() or c == "_" else ""
    body = "".join(c if c.isalnum() or c == " " else "\\" + c for c in phrase)
    return f"{edge(phrase[0])}{body}{edge(phrase[-1])}"


def _list(words: list[str]) -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches(t, '{_word(w)}') THEN '{w}' END" for w in words)
    return f"list_sort(list_filter([{tests}], lambda x: x IS NOT NULL))"


def _alerts_sql() -> str:
    rules = alerts.Rules().extended(EXTRA)
    critical = "[" + ", ".join(f"'{w}'" for w in rules.critical) + "]"
    groups = list(rules.groups.items())
    lists = ", ".join(f"{_list(w)} AS g{i}" for i, (_, w) in enumerate(groups))
    base = f"""
      SELECT id AS article_id, symbols, latency, hits, CASE WHEN len(up) > len(down) THEN 'bullish' WHEN len(down) > len(up) THEN 'bearish' ELSE 'neutral' END AS direction,
             list_sort(CASE WHEN len(symbols) > 0 THEN symbols ELSE hits END) AS everyone, {', '.join(f'g{i}' for i in range(len(groups)))}, brk
      FROM (SELECT *, {lists}, {_list(rules.bullish)} AS up, {_list(rules.bearish)} AS down, {_list(alerts.BREAKING)} AS brk, list_filter(symbols, lambda x: x = 'SEVI') AS hits
            FROM (SELECT id, lower(coalesce(headline, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(content_text, '')) AS t, {_SYMBOLS} AS symbols,
                         coalesce(({sql_instant_us('last_seen_at')} - greatest(created_us, updated_us)) // 1000, latency_ms) AS latency FROM {_ART}))"""
    parts = ["SELECT article_id, 'held_or_interested_symbol' AS category, 'high' AS severity, array_to_string(hits, ',') AS symbols, '' AS matches, direction FROM b WHERE len(hits) > 0"]
    for i, (g, _) in enumerate(groups):
        plain = "high" if g in alerts.HIGH_GROUPS else "medium" if g in alerts.MEDIUM_GROUPS or g not in alerts.KEYWORDS else "low"
        severity = f"CASE WHEN list_has_any(g{i}, {critical}) THEN 'critical' WHEN len(hits) > 0 THEN 'high' ELSE '{plain}' END"
        parts.append(f"SELECT article_id, '{alerts.category(g)}', {severity}, array_to_string(everyone, ','), array_to_string(g{i}, ','), direction FROM b WHERE len(g{i}) > 0")
    parts.append("SELECT article_id, 'breaking_keyword', CASE WHEN len(hits) > 0 THEN 'high' ELSE 'medium' END, array_to_string(everyone, ','), '', direction FROM b WHERE len(brk) > 0")
    parts.append("SELECT article_id, 'high_latency', 'medium', array_to_string(symbols, ','), '', 'neutral' FROM b WHERE latency >= 30000")
    return f"WITH b AS ({base}) " + " UNION ALL ".join(parts)


_ALERTS = _alerts_sql()

_FEED = f"""
  WITH f AS (SELECT *, article_id AS id, {sql_instant_us('received_at')} AS r, coalesce(headline, '') AS h FROM news_article_versions),
  s AS (SELECT *, row_number() OVER w = 1 AS was_new, lag(h) OVER w AS ph,
               last_value(summary IGNORE NULLS) OVER p AS ps, last_value(updated_at IGNORE NULLS) OVER p AS pu,
               last_value(summary IGNORE NULLS) OVER u AS ms, last_value(updated_at IGNORE NULLS) OVER u AS mu, last_value(source IGNORE NULLS) OVER u AS mo,
               first_value(received_at) OVER u AS first_seen_at, lead(id) OVER w IS NULL AS is_last
        FROM f WINDOW w AS (PARTITION BY id ORDER BY r, version_id), p AS (PARTITION BY id ORDER BY r, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                      u AS (PARTITION BY id ORDER BY r, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  c AS (SELECT *, NOT was_new AND (h IS DISTINCT FROM ph OR (summary IS NOT NULL AND summary IS DISTINCT FROM ps) OR (updated_at IS NOT NULL AND updated_at IS DISTINCT FROM pu)) AS changed FROM s)"""

ORACLES = {
    "article_symbols": f"SELECT id, array_to_string({_SYMBOLS}, ',') AS symbols FROM news_articles",
    "article_instants": f"SELECT id, created_us, updated_us, seen_us, at_us, lower(trim(source, ' ')) AS source FROM {_ART}",
    "article_hashes": f"SELECT id, {_HASH} AS content_hash FROM news_articles",
    "article_texts": r"""SELECT id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(content_html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&amp;', '&'), '[\s\x{00A0}\x{2002}-\x{200A}\x{3000}]+', ' ', 'g'), ' ') AS text, trim(content_html) <> '' AS has_content FROM news_articles""",
    "compact_articles": f"SELECT id, headline, array_to_string({_SYMBOLS}, ',') AS symbols, source, coalesce(nullif(updated_at, ''), created_at) AS updated_at, url FROM news_articles",
    "full_articles": r"SELECT id, headline, summary, author, url, source, update_count, latency_ms, CASE WHEN length(content_text) <= 4000 THEN content_text ELSE regexp_replace(substr(content_text, 1, 3997), '\s+$', '') || '...' END AS content_text FROM news_articles",
    "recent_articles": f"""SELECT id, headline, at_us FROM {_ART} WHERE greatest(updated_us, created_us, seen_us) >= (SELECT max(seen_us) FROM {_ART}) - 86400000000 ORDER BY at_us DESC NULLS LAST, id DESC LIMIT 200""",
    "articles_for_symbols": f"SELECT symbol, article_id, headline, at_us FROM {_INDEX} JOIN {_ART} ON id = article_id QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY at_us DESC NULLS LAST, id DESC) <= 25",
    "symbol_map": "SELECT symbol, count(DISTINCT article_id) AS articles FROM news_symbol_index GROUP BY 1 HAVING count(DISTINCT article_id) >= 2 ORDER BY 2 DESC, 1 LIMIT 500",
    "keyword_alerts": _ALERTS,
    "alert_counts": f"SELECT category, severity, direction, count(*) AS alerts FROM ({_ALERTS}) GROUP BY 1, 2, 3",
    "alerts_without_copies": f"""
      WITH RECURSIVE a AS (SELECT article_id, category, {_HASH} AS content_hash, seen_us AS created_us FROM ({_ALERTS}) JOIN {_ART} ON id = article_id WHERE seen_us IS NOT NULL),
      o AS (SELECT category, content_hash, created_us, min(article_id) AS article_id, count(*) AS n FROM a GROUP BY 1, 2, 3),
      r AS (SELECT category, content_hash, min(created_us) AS created_us FROM o GROUP BY 1, 2
            UNION ALL SELECT r.category, r.content_hash, (SELECT min(o.created_us) FROM o WHERE o.category = r.category AND o.content_hash = r.content_hash AND o.created_us > r.created_us + 86400000000) FROM r WHERE r.created_us IS NOT NULL)
      SELECT o.article_id, category, content_hash, created_us FROM r JOIN o USING (category, content_hash, created_us)""",
    "symbol_pulse": f"""
      WITH n AS (SELECT symbol, count(*) AS articles FROM {_INDEX} GROUP BY 1),
      h AS (SELECT symbol, last(headline ORDER BY at_us, id) AS latest_headline, max(at_us) AS latest_us FROM {_INDEX} JOIN {_ART} ON id = article_id WHERE at_us IS NOT NULL GROUP BY 1),
      w AS (SELECT symbol, count(*) FILTER (direction = 'bullish') AS bullish, count(*) FILTER (direction = 'bearish') AS bearish, count(*) FILTER (direction = 'neutral') AS neutral
            FROM (SELECT unnest(string_split(symbols, ',')) AS symbol, direction FROM ({_ALERTS}) WHERE symbols <> '') GROUP BY 1)
      SELECT symbol, articles, latest_headline, latest_us, coalesce(bullish, 0) AS bullish, coalesce(bearish, 0) AS bearish, coalesce(neutral, 0) AS neutral FROM n LEFT JOIN h USING (symbol) LEFT JOIN w USING (symbol)""",
    "breaking_digest": rf"""
      WITH r AS (SELECT * FROM {_ART} ORDER BY at_us DESC NULLS LAST, id DESC LIMIT 200)
      SELECT id, headline, CASE WHEN length(summary) <= 240 THEN summary ELSE regexp_replace(substr(summary, 1, 237), '\s+$', '') || '...' END AS summary, at_us
      FROM r WHERE regexp_matches(lower(concat_ws(' ', headline, summary, content_text)), '{'|'.join([*alerts.DIGEST_MARKERS, 'guidance'])}') ORDER BY at_us DESC NULLS LAST, id DESC LIMIT 25""",
    "latency_stats": """
      WITH s AS (SELECT list_sort(list(latency_ms)) AS v, CAST(floor(avg(latency_ms)) AS BIGINT) AS avg_ms FROM news_articles WHERE latency_ms >= 0)
      SELECT v[CAST(round_even(0.5 * (len(v) - 1), 0) AS BIGINT) + 1] AS p50_ms, v[CAST(round_even(0.9 * (len(v) - 1), 0) AS BIGINT) + 1] AS p90_ms, v[CAST(round_even(0.99 * (len(v) - 1), 0) AS BIGINT) + 1] AS p99_ms,
             len(v) AS sample_count, v[len(v)] AS max_ms, avg_ms FROM s""",
    "ingestion_stats": """
      SELECT 'articles' AS measure, count(*) AS n FROM news_articles UNION ALL SELECT 'versions', count(*) FROM news_article_versions
      UNION ALL SELECT 'symbols', count(DISTINCT symbol) FROM news_symbol_index UNION ALL SELECT 'sources', count(DISTINCT source) FROM news_articles""",
    "articles_since": "SELECT id, headline, seq, count(*) OVER () > 500 AS has_more FROM (SELECT * FROM news_articles WHERE seq > (SELECT max(seq) FROM news_articles) // 2 ORDER BY seq LIMIT 501) QUALIFY row_number() OVER (ORDER BY seq) <= 500",
    "oldest_numbers": f"SELECT symbol, min(seq) AS min_seq, max(seq) AS max_seq FROM {_INDEX} JOIN news_articles ON id = article_id GROUP BY 1",
    "seq_backfill": f"SELECT id, row_number() OVER (ORDER BY coalesce(seen_us, 0), id) AS seq FROM {_ART}",
    "search_like": "SELECT id, headline FROM news_articles WHERE contains(lower(headline), 'uidanc') OR contains(lower(summary), 'uidanc') OR contains(lower(content_text), 'uidanc')",
    "search_terms": r"""
      WITH k AS (SELECT id, regexp_extract_all(lower(strip_accents(concat_ws(chr(10), headline, summary, content_text))), '[\p{L}\p{N}]+') AS w FROM news_articles),
      c AS (SELECT id, len(w) AS d, len(list_filter(w, lambda x: x IN ('copper', 'coppers'))) AS a, len(list_filter(w, lambda x: x IN ('revenue', 'revenues'))) AS b FROM k),
      n AS (SELECT count(*) AS n, avg(d) AS m, count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb FROM c)
      SELECT id, round(greatest(ln((n - na + 0.5::DOUBLE) / (na + 0.5)), 1e-6) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * d / m))
                     + greatest(ln((n - nb + 0.5::DOUBLE) / (nb + 0.5)), 1e-6) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * d / m)), 6) AS score
      FROM c, n WHERE a > 0 AND b > 0""",
    "article_upsert": f"{_FEED} SELECT id, h AS headline, ms AS summary, mu AS updated_at, mo AS source, (SELECT count(*) FROM c x WHERE x.id = c.id AND x.changed) AS update_count, first_seen_at, received_at AS last_seen_at FROM c WHERE is_last",
    "article_version_rows": f"{_FEED} SELECT id, version_id FROM c WHERE was_new OR changed",
    "article_versions": f"SELECT article_id, version_id, headline, {sql_instant_us('received_at')} AS received_us, count(*) OVER (PARTITION BY article_id) AS versions FROM news_article_versions QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY {sql_instant_us('received_at')} DESC NULLS LAST, version_id DESC) <= 50",
    "retention_keep": f"""
      WITH g AS (SELECT id FROM {_ART} WHERE seen_us < (SELECT max(seen_us) FROM {_ART}) - 172800000000)
      SELECT 'news_articles' AS table_name, count(*) AS n FROM news_articles WHERE id NOT IN (SELECT id FROM g)
      UNION ALL SELECT 'news_article_versions', count(*) FROM news_article_versions WHERE article_id NOT IN (SELECT id FROM g)
      UNION ALL SELECT 'news_symbol_index', count(*) FROM news_symbol_index WHERE article_id NOT IN (SELECT id FROM g)""",
}
