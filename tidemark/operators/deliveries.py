"""First deliveries: one row for each trade that was sent more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that make two deliveries the same trade (nulls equal).
TRADE_IDENTITY = ["symbol", "ts_us", "price", "size", "exchange", "conditions", "tape", "trade_id"]


def first_deliveries(df: DataFrame, identity: list[str] = TRADE_IDENTITY, seq: str = "ingest_seq", carry: tuple[str, ...] = ()) -> DataFrame:
    """The row of smallest ``seq`` for each distinct ``identity``, with the ``carry`` columns of that row.

    A hash aggregate over fixed-width buffers, so copies meet on the map side
    and a trade delivered very often never gathers in one task. Rows without
    ``seq`` lose against rows with one. Other columns of ``df`` are dropped.
    """
    picks = [F.min(seq).alias(seq), *(F.min_by(c, seq).alias(c) for c in carry)]
    return df.groupBy(*identity).agg(*picks)
