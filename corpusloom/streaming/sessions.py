"""Sessions of a stream of events, by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, key: str, time: str, gap: str, late: str, event: str) -> DataFrame:
    """key, start, last, events of each session, given out once the watermark has passed its end.

    What comes more than `late` behind the latest time seen is dropped; an event that comes again within that time (by the column `event`)
    counts once. State holds open sessions and the ids of that time only. Rows with a null key or time are in no session. The
    batch form is operators.events.sessions, in which nothing is late.
    """
    # watermarks need instants, so local times are taken in the session's time zone
    known = events.withColumn(time, F.col(time).cast("timestamp")).filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    seen = known.withWatermark(time, late).dropDuplicatesWithinWatermark([event])
    found = seen.groupBy(key, F.session_window(time, gap).alias("_session")).agg(F.max(time).alias("last"), F.count("*").alias("events"))
    return found.select(key, F.col("_session.start").alias("start"), "last", "events")
