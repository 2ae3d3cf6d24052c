"""Jobs that bring articles and bars of a paged service into the published tables, and batches that survive a failed write."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.times import instant_us
from tidemark.operators import alerts as alert_ops
from tidemark.operators import ingest
from tidemark.sources import frames
from tidemark.streaming import publish


@dataclass(frozen=True)
class Run:
    """What a job did. ``failure`` tells why its window is incomplete, None if it isn't."""

    new: int
    updated: int
    duplicate: int
    failed: int
    truncated: bool
    failure: str | None

    @property
    def ingested(self) -> int:
        return self.new + self.updated + self.duplicate


def ingest_pages(target: publish.Published, pages: DataFrame, received_at: Column, batch: int, symbols: list[str] | None = None, since_us: int | None = None, most: int | None = None) -> tuple[Run, DataFrame | None]:
    """Articles of a paged source (``value``, ``page``) into the published articles.

    Only articles of ``symbols`` and from ``since_us`` on are taken, the ``most`` newest ones. Gives the
    counts and the states, from which the caller makes alerts; latency alerts make no sense for history.
    """
    good, bad = frames.articles(frames.decode(pages), received_at)
    failed = bad.count()
    if symbols is not None:
        good = good.filter(F.arrays_overlap("symbols", F.array(*map(F.lit, symbols))))
    at = F.unix_micros(F.coalesce("updated_at", "created_at"))
    if since_us is not None:
        good = good.filter(at >= since_us)
    truncated = False
    if most is not None:
        found = good.orderBy(F.desc(at), F.desc("id")).limit(most + 1).persist()
        truncated = found.count() > most
        good = found.orderBy(F.desc(at), F.desc("id")).limit(most)
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(c)
    rows = good.withColumn("_at", at).withColumn("arrival", F.row_number().over(publish.Window.partitionBy("id").orderBy("_at", "content_hash")).cast("long"))
    rows = rows.withColumns({c: text(c) for c in ("created_at", "updated_at", "received_at")})
    states = publish.upsert_articles(target, rows, batch)
    failure = f"{failed} item(s) failed to ingest" if failed else None
    if states is None:
        return Run(0, 0, 0, failed, truncated, failure), None
    n = {r["status"]: r["n"] for r in ingest.outcomes(states).collect()}
    return Run(n.get("new", 0), n.get("updated", 0), n.get("duplicate", 0), failed, truncated, failure), states


def alerts_of(states: DataFrame, rules: alert_ops.Rules, interest: list[str], watched: list[int] = (), latency_ms: int | None = None) -> DataFrame:
    """Alerts for the store from the states of an ingest: of new articles and changed content, and of watched stories."""
    fresh = states.filter("was_new OR content_changed").withColumn("received_us", instant_us("received_at"))
    fresh = fresh.withColumn("latest_us", F.greatest(instant_us("created_at"), instant_us("updated_at")))
    told = alert_ops.article_alerts(fresh, rules, interest, latency_ms)
    facts = fresh.groupBy("id").agg(F.max_by(F.struct("headline", "received_us", frames.content_hash(F.col("headline"), F.col("summary"), F.col("content_html")).alias("content_hash")), "arrival").alias("_f"))
    named = told.join(facts.withColumnRenamed("id", "article_id"), "article_id").select("article_id", "category", "severity", "symbols", "direction", "reason", "_f.*")
    stories = alert_ops.watched_story_alerts(states, list(watched), rules).withColumn("received_us", instant_us("received_at")).withColumn("content_hash", F.lit(None).cast("string"))
    both = named.unionByName(stories.drop("received_at"))
    return both.select(
        publish.alert_id(F.coalesce("article_id", F.lit(-1)), F.col("category"), F.col("reason"), F.col("received_us")).alias("alert_id"), "article_id", F.col("received_us").alias("created_us"), "severity", "category", "symbols", "headline", "reason", "content_hash", "direction",
    )


def bar_rows(fetched: DataFrame) -> DataFrame:
    """Bars of a paged source (``value`` with ``S`` and the keys of a bar frame), as the store takes them; rows without symbol or time drop out."""
    parsed = fetched.withColumn("f", F.from_json("value", "S string, t string, " + ", ".join(f"{k} {v}" for k, v in schemas.FRAME["b"].items())))
    named = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "trade_count": "n", "vwap": "vw"}
    rows = parsed.select(F.upper("f.S").alias("symbol"), F.lit("1min").alias("timeframe"), F.expr("unix_micros(try_cast(f.t as timestamp)) div 1000000").alias("ts"), *(F.col(f"f.{k}").alias(n) for n, k in named.items()), F.col("page").cast("long").alias("arrival"))
    return rows.filter(F.col("symbol").isNotNull() & F.col("ts").isNotNull())


def backfill_bars(target: publish.Published, fetched: DataFrame, starts: DataFrame, batch: int) -> int:
    """Fetched bars (:func:`bar_rows`) at or after the start of their own symbol into the published bars; gives how many were written."""
    written = publish.upsert_bars(target, ingest.since_own_start(fetched, starts), batch)
    return 0 if written is None else written.count()


def lasting(write: Callable[[DataFrame, int], None], recover: Callable[[DataFrame, int, Exception], None]) -> Callable[[DataFrame, int], None]:
    """A writer of micro-batches that tries a failed batch once more and then hands it to ``recover``, so that the stream goes on."""

    def safe(batch: DataFrame, number: int) -> None:
        try:
            write(batch, number)
        except Exception:
            try:
                write(batch, number)
            except Exception as e:
                recover(batch, number, e)

    return safe
