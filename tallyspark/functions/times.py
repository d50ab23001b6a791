"""Instants as whole numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of what a timestamp's fields say, in any session time zone."""
    days = F.date_diff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return days * 86_400_000_000 + seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def millis(ts: Column) -> Column:
    """The same in milliseconds, floored."""
    us = micros(ts)
    return F.call_function("div", us - F.pmod(us, F.lit(1000)), F.lit(1000)).cast("long")
