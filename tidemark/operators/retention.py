"""Retention: what is kept of each table, children going with their article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expired(articles: DataFrame, seen_us: Column, cutoff_us: int) -> DataFrame:
    """Ids of the articles first seen before the cut-off; those with unknown time are kept."""
    return articles.filter(seen_us < cutoff_us).select(F.col("id").alias("article_id"))


def keep_children(children: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose article stays; rows without article stay too."""
    return children.join(gone, "article_id", "left_anti")


def keep_since(rows: DataFrame, time: str, cutoff: int) -> DataFrame:
    """Rows at or after the cut-off; on a table partitioned by day this drops whole folders."""
    return rows.filter(F.col(time) >= cutoff)
