"""Times as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

SECOND_US = 1_000_000


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a column; a time without a zone counts as it reads, whatever the session's zone."""
    at = F.col(name)
    if isinstance(df.schema[name].dataType, TimestampType):
        return F.unix_micros(at)
    seconds = F.unix_date(at.cast("date")).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60
    return seconds * SECOND_US + (F.date_part(F.lit("SECOND"), at) * SECOND_US).cast("long")
