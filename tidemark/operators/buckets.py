"""Time buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of the calendar; weeks start on Monday.
CALENDAR = ("week", "month", "quarter", "year")


def bucket_start(time: Column, every: str) -> Column:
    """Start of the bucket that holds a time. Fixed lengths count from 1970-01-01 00:00 UTC; a week is the calendar's."""
    unit = every.strip().lower().removeprefix("1 ").rstrip("s")
    if unit in CALENDAR:
        return F.date_trunc(unit, time).cast("timestamp_ntz")
    return F.window(time, every).getField("start").cast("timestamp_ntz")
