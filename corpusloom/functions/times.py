"""Times as whole numbers, by the parts of the clock, so that local times give the same in any session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(time: Column) -> Column:
    """Whole seconds since 1970 as long."""
    days = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def micros(time: Column) -> Column:
    """Microseconds since 1970 as long."""
    fraction = F.extract(F.lit("SECOND"), time).cast("decimal(8,6)") - F.second(time).cast("decimal(8,6)")
    return seconds(time) * 1_000_000 + (fraction * 1_000_000).cast("long")


def slices(time: Column, hours: int) -> Column:
    """Number of the stretch of so many hours that a time lies in."""
    return F.floor(seconds(time) / (3600 * hours)).cast("long")
