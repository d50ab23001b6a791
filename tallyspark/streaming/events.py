"""Windows and last states over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_stream(events: DataFrame, ts: str, size: str, value: str, late: str) -> DataFrame:
    """Tumbling sums, counts and maxima; rows later than the watermark are dropped, so it differs from batch replay where events are that late."""
    grouped = events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"))
    return grouped.agg(F.sum(value).alias("value_sum"), F.count(F.lit(1)).alias("event_count"), F.max(value).alias("value_max")).select(F.col("w.start").alias("window_start"), "value_sum", "event_count", "value_max")


def last_state_stream(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The last value of each key so far, for update or complete mode."""
    return events.groupBy(key).agg(F.max_by(value, ts).alias("last_value"), F.max(ts).alias("last_ts"))


def unseen(events: DataFrame, identity: str, ts: str, late: str) -> DataFrame:
    """Events whose identity hasn't been seen within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([identity])
