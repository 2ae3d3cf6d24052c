"""Instants from text and integer time arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shape of a text time: date, then optionally a time of day and an offset.
TEXT_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|z|[+-]\d{2}(:?\d{2})?)?)?$"
#: The usual shape, which the cast takes as it is.
PLAIN_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"
HAS_OFFSET = r"[T ].*(Z|z|[+-]\d{2}(:?\d{2})?)$"

DAY_S = 86_400
DAY_US = 86_400_000_000


def instant(text: Column | str) -> Column:
    """Timestamp of an ISO-8601 text; no offset means UTC, whatever the session's zone.

    Null, empty or unparsable text gives null; digits beyond microseconds are cut.
    """
    col = F.col(text) if isinstance(text, str) else text
    dotted = F.translate(F.upper(F.trim(col)), ",", ".")
    dated = F.when(F.length(dotted) == 10, F.concat(dotted, F.lit("T00:00:00"))).otherwise(dotted)
    dated = F.regexp_replace(dated, r"^(.{10}[T ]\d{2}:\d{2})(?=$|[Z+-])", "$1:00")
    zoned = F.when(dated.rlike(HAS_OFFSET), dated).otherwise(F.concat(dated, F.lit("Z")))
    return F.when(col.rlike(PLAIN_TIME), col.try_cast("timestamp")).when(F.trim(col).rlike(TEXT_TIME), zoned.try_cast("timestamp"))


def instant_us(text: Column | str) -> Column:
    """Epoch microseconds of :func:`instant`."""
    return F.unix_micros(instant(text))


def floor_to(value: Column, step: int) -> Column:
    """Largest multiple of ``step`` not above ``value``; exact for negative integers too."""
    return value - F.pmod(value, F.lit(step))
