"""The registered queries of the general data-pipeline problems (1, 4 and 5), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import source_name
from tidemark.functions.times import DAY_S, DAY_US, instant_us
from tidemark.operators import history, spikes
from tidemark.operators.deliveries import TRADE_IDENTITY, first_deliveries
from tidemark.operators.revisions import Lateness, changelog, revised_periods, roll_up, settle, version_deltas
from tidemark.session import materialize
from tidemark.sources.tables import table

MINUTE_US = 60_000_000
HOUR_US = 3_600_000_000

NEWS_RULE = Lateness(HOUR_US, 6 * HOUR_US, 5 * MINUTE_US)


def _trades(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "stock_trades").select(*TRADE_IDENTITY, "ingest_seq", "received_us")
    return first_deliveries(trades, carry=("received_us",))


def _trade_log(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    rule = Lateness(5 * MINUTE_US, 15 * MINUTE_US, MINUTE_US, {"volume": F.col("size")})
    return changelog(version_deltas(_trades(spark, d), ["symbol"], "ts_us", "received_us", rule), ["symbol"], ["volume"]), ["volume"]


def _news_log(spark: SparkSession, d: str) -> DataFrame:
    news = table(spark, d, "news_articles").select(
        source_name("source").alias("source"), instant_us("created_at").alias("event_us"), instant_us("first_seen_at").alias("arrival_us")
    )
    return changelog(version_deltas(news, ["source"], "event_us", "arrival_us", NEWS_RULE), ["source"], [])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods of both feeds whose result was revised after their end."""
    log, _ = _trade_log(spark, d)
    trades = revised_periods(log, ["symbol"]).select(F.lit("stock_trades").alias("feed"), F.col("symbol").alias("entity"), "period_us")
    news = revised_periods(_news_log(spark, d), ["source"]).select(F.lit("news_articles").alias("feed"), F.col("source").alias("entity"), "period_us")
    return trades.unionAll(news).select("feed", "entity", F.expr("period_us div 1000000").alias("period_start"))


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    """The corrected five-minute trade counts and volumes, as the changelog leaves them."""
    log, measures = _trade_log(spark, d)
    done = settle(log, ["symbol", "period_us"], measures)
    return done.select("symbol", F.expr("period_us div 1000000").alias("period_start"), F.col("n").alias("trades"), "volume")


def p1_days(spark: SparkSession, d: str) -> DataFrame:
    """Daily totals fed by the five-minute changelog's retractions and assertions only."""
    log, measures = _trade_log(spark, d)
    done = roll_up(log, ["symbol"], measures, DAY_US)
    return done.select("symbol", F.expr("period_us div 1000000").alias("day_start"), F.col("n").alias("trades"), "volume")


def p1_news_hours(spark: SparkSession, d: str) -> DataFrame:
    """The corrected hourly article counts per source."""
    done = settle(_news_log(spark, d), ["source", "period_us"], [])
    return done.select("source", F.expr("period_us div 1000000").alias("period_start"), F.col("n").alias("articles"))


#: Loads in which the headline dimension is merged, by arrival.
HISTORY_LOADS = 2
_RANK = ["received_us", "version_id"]


def _headline_rows(spark: SparkSession, d: str) -> DataFrame:
    """Headline observations, written out so that each load reads parsed times."""
    rows = table(spark, d, "news_article_versions").select(
        "article_id", "version_id", instant_us("received_at").alias("received_us"), instant_us("updated_at").alias("updated_us"), F.trim(F.coalesce(F.col("headline"), F.lit(""))).alias("headline")
    )
    seen = history.observations(rows, "article_id", F.coalesce("updated_us", "received_us"), {c: F.col(c) for c in _RANK}, [F.col("headline")])
    return materialize(seen, "headline-rows")


def _headlines(spark: SparkSession, d: str) -> DataFrame:
    dimension = history.fold(_headline_rows(spark, d), "article_id", _RANK, "received_us", HISTORY_LOADS)
    return history.versions(dimension, "article_id").withColumn("valid_to_us", F.coalesce("valid_to_us", F.lit(-1)))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every state of every article's headline with its validity, -1 while open."""
    return _headlines(spark, d).select("article_id", "valid_from_us", "valid_to_us")


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    """The same history with the headline of each state."""
    heads = table(spark, d, "news_article_versions").select("article_id", "version_id", F.trim(F.coalesce(F.col("headline"), F.lit(""))).alias("headline"))
    return _headlines(spark, d).join(heads, ["article_id", "version_id"]).select("article_id", "valid_from_us", "valid_to_us", "headline")


def p4_last_day(spark: SparkSession, d: str) -> DataFrame:
    """What merging the last two UTC days of arrivals into the stored dimension closes, inserts, moves and withdraws."""
    rows = _headline_rows(spark, d)
    newest = rows.agg(F.max("received_us")).first()[0] or 0
    late = F.coalesce("received_us", F.lit(0)) >= newest - newest % DAY_US - DAY_US
    before = materialize(history.merge(None, rows.filter(~late), "article_id", _RANK), "dimension")
    after = history.merge(before, rows.filter(late), "article_id", _RANK)
    return history.changes(before, after, "article_id").withColumn("valid_to_us", F.coalesce("valid_to_us", F.lit(-1)))


def _trade_prices(spark: SparkSession, d: str) -> DataFrame:
    trades = table(spark, d, "stock_trades").select(*TRADE_IDENTITY, "ingest_seq")
    trades = trades.filter(F.col("price").isNotNull() & ~F.isnan("price"))
    return first_deliveries(trades).select("symbol", (F.col("ts_us") - F.pmod("ts_us", F.lit(DAY_US))).alias("day"), "ts_us", "ingest_seq", "price")


def _minute_volumes(spark: SparkSession, d: str) -> DataFrame:
    bars = table(spark, d, "stock_bars").filter((F.col("timeframe") == "1min") & F.col("volume").isNotNull())
    return bars.select("symbol", (F.col("ts") - F.pmod("ts", F.lit(DAY_S))).alias("day"), "ts", "seq", "volume")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Trades and minute bars implausible for their own symbol on that day."""
    prices = spikes.running_median_flags(
        _trade_prices(spark, d), ["symbol", "day"], F.expr("ts_us div 600000000"), ["ts_us", "ingest_seq"], "ingest_seq", "price",
        reach=10, factor=10.0, min_run=12,
    )
    volumes = spikes.level_flags(
        _minute_volumes(spark, d), ["symbol", "day"], F.expr("ts div 3600"), ["ts", "seq"], "seq", "volume",
        factor=15.0, min_run=10,
    )
    trades = prices.select(F.lit("stock_trades").alias("table_name"), F.col("ingest_seq").alias("row_seq"))
    return trades.unionAll(volumes.select(F.lit("stock_bars").alias("table_name"), F.col("seq").alias("row_seq")))


PRICE_MODEL = spikes.LocalLevel()
VOLUME_MODEL = spikes.LocalLevel(threshold=4.0, process=0.2)


def p5_innovations(spark: SparkSession, d: str) -> DataFrame:
    """Trades' prices and minute bars' volumes (as logarithms) a Kalman filter per symbol and day finds implausible, with the standardised innovation."""
    prices = spikes.kalman_flags(
        _trade_prices(spark, d), ["symbol", "day"], F.expr("ts_us div 600000000"), ["ts_us", "ingest_seq"], "ingest_seq",
        F.col("price"), F.col("price") <= 0, F.lit(False), PRICE_MODEL,
    )
    volumes = spikes.kalman_flags(
        _minute_volumes(spark, d), ["symbol", "day"], F.expr("ts div 3600"), ["ts", "seq"], "seq",
        F.log(F.greatest(F.col("volume"), F.lit(0)) + F.lit(1.0)), F.col("volume") < 0, F.col("volume") == 0, VOLUME_MODEL,
    )
    trades = prices.select(F.lit("stock_trades").alias("table_name"), "symbol", "day", F.col("ingest_seq").alias("row_seq"), "reason", F.round("score", 6).alias("score"))
    bars = volumes.select(F.lit("stock_bars").alias("table_name"), "symbol", (F.col("day") * 1_000_000).alias("day"), F.col("seq").alias("row_seq"), "reason", F.round("score", 6).alias("score"))
    return trades.unionAll(bars)


QUERIES = {f.__name__: f for f in (p1_found, p1_periods, p1_days, p1_news_hours, p4_found, p4_history, p4_last_day, p5_found, p5_innovations)}


def sql_instant_us(text: str) -> str:
    """DuckDB's epoch microseconds of a text time, null if it has no instant."""
    return (
        rf"CASE WHEN regexp_full_match(trim({text}), '\d{{4}}-\d{{2}}-\d{{2}}[T ].*(Z|[+-]\d{{2}}:?\d{{2}})') THEN epoch_us(try_cast(trim({text}) AS TIMESTAMPTZ))"
        rf" WHEN regexp_full_match(trim({text}), '\d{{4}}-\d{{2}}-\d{{2}}([T ].*)?') THEN epoch_us(try_cast(trim({text}) AS TIMESTAMP)) END"
    )


_FIRST = f"SELECT {', '.join(TRADE_IDENTITY)}, min(ingest_seq) AS ingest_seq, arg_min(received_us, ingest_seq) AS received_us FROM stock_trades GROUP BY {', '.join(TRADE_IDENTITY)}"

_TRADE_PERIODS = f"""
  SELECT symbol, size, p, received_us - (p + 300000000) AS late
  FROM (SELECT symbol, size, received_us, ts_us - ts_us % 300000000 AS p FROM ({_FIRST}) WHERE symbol IS NOT NULL AND ts_us IS NOT NULL AND received_us IS NOT NULL)"""

_NEWS_PERIODS = f"""
  SELECT source, p, a - (p + 3600000000) AS late
  FROM (SELECT source, a, e - e % 3600000000 AS p
        FROM (SELECT lower(trim(source)) AS source, {sql_instant_us('created_at')} AS e, {sql_instant_us('first_seen_at')} AS a FROM news_articles)
        WHERE source IS NOT NULL AND e IS NOT NULL AND a IS NOT NULL)"""

def _history_sql(where: str = "true") -> str:
    return f"""
  WITH v AS (
    SELECT article_id, coalesce({sql_instant_us('updated_at')}, {sql_instant_us('received_at')}) AS t,
           {sql_instant_us('received_at')} AS r, version_id, trim(coalesce(headline, ''), ' ') AS headline
    FROM news_article_versions),
  edge AS (SELECT max(r) - max(r) % 86400000000 - 86400000000 AS e FROM v),
  o AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id, t ORDER BY r DESC NULLS LAST, version_id DESC) AS k FROM v WHERE t IS NOT NULL AND article_id IS NOT NULL AND {where}) WHERE k = 1),
  s AS (
    SELECT * FROM (SELECT *, lag(headline) OVER (PARTITION BY article_id ORDER BY t) AS prev FROM o) WHERE prev IS DISTINCT FROM headline)
  SELECT article_id, t AS valid_from_us, coalesce(lead(t) OVER (PARTITION BY article_id ORDER BY t), -1) AS valid_to_us, headline FROM s"""


_HISTORY = _history_sql()



def _filter_sql(measured: str, model: spikes.LocalLevel) -> str:
    """The filter as a recursive query over ``measured`` (symbol, d, slot, t, q, x, bad, rest), for groups of one chunk."""
    t = f"{model.threshold}::DOUBLE"
    return f"""
  WITH RECURSIVE m AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY slot, t, q) AS i, abs(x - lag(x) OVER (PARTITION BY symbol, d, slot ORDER BY t, q)) AS step FROM ({measured})),
  u AS (
    SELECT symbol, d, q2, q3, q1, step FROM (
      SELECT symbol, d, list_sort(list(x)) AS l, list_sort(list(step) FILTER (step IS NOT NULL)) AS k, l[(len(l) + 3) // 4] AS q1, l[(len(l) + 1) // 2] AS q2, l[(3 * len(l) + 3) // 4] AS q3, k[(len(k) + 1) // 2] AS step
      FROM m WHERE NOT bad GROUP BY 1, 2)),
  n AS (SELECT symbol, d, q2, (q3 - q1) / 1.349::DOUBLE AS w, greatest(coalesce(step * 1.4826::DOUBLE, (q3 - q1) / 1.349::DOUBLE), abs(q2) * 1e-4::DOUBLE, 1e-9::DOUBLE) AS normal FROM u),
  f AS (
    SELECT symbol, d, 0::BIGINT AS i, NULL::BIGINT AS q, q2 AS level, greatest(w, normal) * greatest(w, normal) AS p, normal * normal AS r, normal * normal AS v, normal * normal AS nn, normal,
           0::BIGINT AS held, 0::DOUBLE AS agreed, 0::DOUBLE AS z, false AS far, false AS gone
    FROM n
    UNION ALL
    SELECT symbol, d, i, q,
           CASE WHEN moved THEN near_agreed WHEN fine THEN level + gain * e ELSE level END,
           CASE WHEN moved THEN r WHEN fine THEN ahead * (1 - gain) ELSE ahead END,
           CASE WHEN fine THEN greatest(0.98::DOUBLE * r + 0.02::DOUBLE * e * e * r / s, nn / 16) ELSE r END,
           CASE WHEN moved THEN nn WHEN fine THEN vv ELSE v END, nn, normal,
           CASE WHEN moved THEN 0 ELSE held END, near_agreed, z, far, fine AND vv < 0.001::DOUBLE * nn
    FROM (
      SELECT *, far AND held >= {model.restart} AS moved, CASE WHEN near THEN agreed + (x - agreed) / held WHEN far THEN x ELSE agreed END AS near_agreed, ahead / s AS gain, 0.5::DOUBLE * v + 0.5::DOUBLE * e * e AS vv
      FROM (
        SELECT * EXCLUDE (held), CASE WHEN near THEN held + 1 WHEN far THEN 1 WHEN fine THEN 0 ELSE held END AS held
        FROM (
          SELECT *, far AND held > 0 AND abs(x - agreed) / root <= {t} AS near, NOT far AND NOT bad AS fine
          FROM (
            SELECT *, abs(e) / root AS z, NOT bad AND abs(e) / root > {t} AS far
            FROM (SELECT *, sqrt(s) AS root, x - level AS e FROM (SELECT *, ahead + r AS s FROM (
              SELECT f.symbol, f.d, m.i, m.q, m.x, m.bad, f.level, f.p + {model.process}::DOUBLE * f.r AS ahead, f.r, f.v, f.nn, f.normal, f.held, f.agreed
              FROM f JOIN m ON f.symbol = m.symbol AND f.d = m.d AND m.i = f.i + 1)))))))),
  g AS (SELECT f.*, m.x, m.bad, m.rest, coalesce(abs(m.x - lag(m.x) OVER (PARTITION BY f.symbol, f.d ORDER BY f.i)) > 0.03::DOUBLE * f.normal, true) AS opens FROM f JOIN m USING (symbol, d, i)),
  h AS (SELECT *, sum(opens::INT) OVER (PARTITION BY symbol, d ORDER BY i) AS run FROM g),
  k AS (SELECT *, bool_or(gone) OVER (PARTITION BY symbol, d, run) AS stuck FROM h)
  SELECT symbol, d, q, CASE WHEN bad THEN 'impossible' WHEN far THEN 'spike' ELSE 'stuck' END AS reason, round(z, 6) AS score FROM k WHERE bad OR far OR (stuck AND NOT rest)"""


ORACLES = {
    "p1_found": f"""
      SELECT DISTINCT 'stock_trades' AS feed, symbol AS entity, p // 1000000 AS period_start FROM ({_TRADE_PERIODS}) WHERE late >= 0 AND late < 900000000
      UNION ALL
      SELECT DISTINCT 'news_articles', source, p // 1000000 FROM ({_NEWS_PERIODS}) WHERE late >= 0 AND late < 21600000000""",
    "p1_periods": f"SELECT symbol, p // 1000000 AS period_start, count(*) AS trades, CAST(sum(coalesce(size, 0)) AS BIGINT) AS volume FROM ({_TRADE_PERIODS}) WHERE late < 900000000 GROUP BY 1, 2",
    "p1_days": f"SELECT symbol, (p - p % 86400000000) // 1000000 AS day_start, count(*) AS trades, CAST(sum(coalesce(size, 0)) AS BIGINT) AS volume FROM ({_TRADE_PERIODS}) WHERE late < 900000000 GROUP BY 1, 2",
    "p1_news_hours": f"SELECT source, p // 1000000 AS period_start, count(*) AS articles FROM ({_NEWS_PERIODS}) WHERE late < 21600000000 GROUP BY 1, 2",
    "p4_found": f"SELECT article_id, valid_from_us, valid_to_us FROM ({_HISTORY})",
    "p4_history": _HISTORY,
    "p4_last_day": f"""
      SELECT article_id, valid_from_us, coalesce(n.valid_to_us, o.valid_to_us) AS valid_to_us,
             CASE WHEN o.headline IS NULL THEN 'inserted' WHEN n.headline IS NULL THEN 'withdrawn' WHEN o.valid_to_us = -1 AND n.valid_to_us <> -1 THEN 'closed' ELSE 'moved' END AS action
      FROM ({_history_sql("coalesce(r, 0) < (SELECT e FROM edge)")}) o FULL JOIN ({_HISTORY}) n USING (article_id, valid_from_us)
      WHERE o.headline IS DISTINCT FROM n.headline OR o.valid_to_us IS DISTINCT FROM n.valid_to_us""",
    "p5_found": f"""
      WITH t AS (SELECT symbol, ts_us // 86400000000 AS d, ts_us, ingest_seq, price FROM ({_FIRST}) WHERE price IS NOT NULL AND symbol IS NOT NULL),
      m AS (SELECT *, abs(price - median(price) OVER (PARTITION BY symbol, d ORDER BY ts_us, ingest_seq ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)) AS dev,
              row_number() OVER (PARTITION BY symbol, d ORDER BY ts_us, ingest_seq) - row_number() OVER (PARTITION BY symbol, d, price ORDER BY ts_us, ingest_seq) AS isle FROM t),
      u AS (SELECT symbol, d, median(dev) AS usual FROM m GROUP BY 1, 2),
      r AS (SELECT *, count(*) OVER (PARTITION BY symbol, d, price, isle) AS run FROM m),
      b AS (SELECT symbol, ts // 86400 AS d, ts, seq, volume FROM stock_bars WHERE timeframe = '1min' AND volume IS NOT NULL AND symbol IS NOT NULL),
      bm AS (SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY ts, seq) - row_number() OVER (PARTITION BY symbol, d, volume ORDER BY ts, seq) AS isle FROM b),
      bu AS (SELECT symbol, d, median(volume) AS usual FROM b GROUP BY 1, 2),
      br AS (SELECT *, count(*) OVER (PARTITION BY symbol, d, volume, isle) AS run FROM bm)
      SELECT 'stock_trades' AS table_name, ingest_seq AS row_seq FROM r JOIN u USING (symbol, d) WHERE price <= 0 OR dev > 10 * usual OR run >= 12
      UNION ALL
      SELECT 'stock_bars', seq FROM br JOIN bu USING (symbol, d) WHERE volume < 0 OR volume > 15 * usual OR (run >= 10 AND volume > 0)""",
    "p5_innovations": f"""
      SELECT 'stock_trades' AS table_name, symbol, d * 86400000000 AS day, q AS row_seq, reason, score FROM ({_filter_sql(
        f"SELECT symbol, ts_us // 86400000000 AS d, ts_us // 600000000 AS slot, ts_us AS t, ingest_seq AS q, price AS x, price <= 0 AS bad, false AS rest FROM ({_FIRST}) WHERE price IS NOT NULL AND symbol IS NOT NULL AND ts_us IS NOT NULL", PRICE_MODEL)})
      UNION ALL
      SELECT 'stock_bars', symbol, d * 86400000000, q, reason, score FROM ({_filter_sql(
        "SELECT symbol, ts // 86400 AS d, ts // 3600 AS slot, ts AS t, seq AS q, ln(1 + greatest(volume, 0)::DOUBLE) AS x, volume < 0 AS bad, volume = 0 AS rest FROM stock_bars WHERE timeframe = '1min' AND volume IS NOT NULL AND symbol IS NOT NULL AND ts IS NOT NULL", VOLUME_MODEL)})""",
}
