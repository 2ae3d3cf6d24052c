"""Pages of a feed by a growing number, and what a consumer must know about gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, seq: str, cursor: int, limit: int) -> DataFrame:
    """The ``limit`` rows after ``cursor`` in order, with ``has_more``; one row more is read to know it.

    A page is bounded, so the window over it is too.
    """
    found = rows.filter(F.col(seq) > cursor).orderBy(seq).limit(limit + 1)
    more = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > limit
    return found.withColumn("has_more", more).orderBy(seq).limit(limit)


def next_cursor(seqs: list[int], cursor: int) -> int:
    """Where to go on: the last number of the page, else the cursor itself."""
    return seqs[-1] if seqs else cursor


def position(cursor: int, latest: int, oldest: int) -> dict[str, object]:
    """What a poll at ``cursor`` gets to know: start at the tail for -1, an error beyond the newest number, a gap if rows before it are gone.

    ``oldest`` is the smallest number still stored under the same filters, 0 for none.
    """
    if cursor == -1:
        return {"start": latest, "note": "started_from_tail"}
    if cursor > latest:
        return {"error": "cursor_out_of_range", "cursor": cursor, "latest_cursor": latest}
    out: dict[str, object] = {"start": cursor}
    if cursor == 0:
        return out
    resume = oldest - 1 if oldest else latest
    if cursor < resume:
        out |= {"gap": True, "oldest_available_cursor": resume}
    return out
