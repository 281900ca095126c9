"""Time arithmetic that does not depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp, read off its own calendar fields."""
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * F.lit(DAY_US)
        + seconds.cast("bigint") * F.lit(1_000_000)
        + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    )
