"""Versioned upsert of articles: updates of an article applied in order of arrival.

Merging depends on the order, but each rule looks back at the last value that was
not null, so running windows per article do it without a loop: headline, symbols
and raw text are overwritten, other fields keep the old value where the new one is
null, the first latency stays, and the update count grows with each real change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fields that keep their old value when an update brings null.
KEPT = ["summary", "author", "created_at", "updated_at", "content_html", "content_text", "url", "source"]
#: Those of them that make an update a change of content, beside the headline.
WATCHED = ["summary", "content_html", "updated_at"]


def apply_updates(updates: DataFrame, order: list[str]) -> DataFrame:
    """The state of each article after each of its updates.

    ``updates`` has ``id``, ``headline``, ``symbols``, the fields of ``KEPT``,
    ``received_at``, ``latency_ms`` and ``is_content_present``; a stored state comes
    in as the first update. Added are ``was_new``, ``content_changed``, ``changed``,
    ``update_count`` and ``is_last``. ``order`` must be unique per article.
    """
    line = Window.partitionBy("id").orderBy(*order)
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    named = updates.withColumn("headline", F.coalesce("headline", F.lit("")))
    was = {c: F.last(c, ignorenulls=True).over(before) for c in WATCHED}
    seen = named.withColumns({"was_new": F.row_number().over(line) == 1, "_headline": F.lag("headline").over(line), "_symbols": F.lag("symbols").over(line)} | {f"_{c}": v for c, v in was.items()})
    content = ~F.col("headline").eqNullSafe(F.col("_headline"))
    for c in WATCHED:
        content = content | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")))
    symbols = ~F.array_sort(F.array_distinct("symbols")).eqNullSafe(F.array_sort(F.array_distinct("_symbols")))
    judged = seen.withColumn("content_changed", ~F.col("was_new") & content).withColumn("changed", ~F.col("was_new") & (content | symbols))
    merged = judged.withColumns(
        {c: F.last(c, ignorenulls=True).over(upto) for c in KEPT}
        | {
            "latency_ms": F.first("latency_ms", ignorenulls=True).over(upto),
            "is_content_present": F.max("is_content_present").over(upto),
            "first_seen_at": F.first("received_at").over(upto),
            "last_seen_at": F.col("received_at"),
            "update_count": F.sum(F.col("changed").cast("int")).over(upto),
            "is_last": F.lead("id").over(line).isNull(),
        }
    )
    return merged.drop("_headline", "_symbols", *(f"_{c}" for c in WATCHED))


def current(states: DataFrame) -> DataFrame:
    """The last state of every article."""
    return states.filter("is_last").drop("is_last")


def new_versions(states: DataFrame) -> DataFrame:
    """The states that are versions of their own: first ones and changes of content."""
    return states.filter("was_new OR content_changed")


def symbol_index(articles: DataFrame) -> DataFrame:
    """One row per article and symbol, derived from the current articles, so removed symbols vanish with them."""
    return articles.select(F.explode("symbols").alias("symbol"), F.col("id").alias("article_id"), "created_at", "updated_at", F.col("last_seen_at").alias("received_at"), "source")
