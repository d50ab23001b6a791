"""Streams over files written from the tables, stopped and started again in between."""

import uuid

from pyspark.sql import functions as F

from tallyspark.queries import query
from tallyspark.sources.lineage import shared_folder
from tallyspark.sources.tables import table
from tallyspark.streaming.ledger import ledger_stream, run_to_end


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS counter, ts FROM events),
f AS (SELECT *, lag(counter) OVER w AS before, max(counter) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before,
  row_number() OVER (PARTITION BY user_id, event_type, counter ORDER BY ts, event_id) AS occurrence,
  list(CAST(event_id AS VARCHAR)) OVER w AS leaves FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, user_id, event_type, counter, coalesce(before, 0) + 1 AS expected, highest_before, occurrence,
  list_reduce(leaves, lambda h, x: sha256(h || x), 'genesis') AS head FROM f
""")
def q_stream_ledger(spark, sf_dir):
    """Counters, replays and chain heads of each user's events by kind, over micro-batches and a restart in mid-stream."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor("value").cast("long").alias("counter"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    root = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    middle = e.agg(F.percentile_approx("at", 0.5).alias("m")).first()["m"] or 0
    for part in (F.col("at") <= middle, F.col("at") > middle):
        e.where(part).write.mode("append").parquet(f"{root}/in")
        # A new query on the old checkpoint, as after a restart.
        stream = spark.readStream.schema(e.schema).parquet(f"{root}/in")
        told = ledger_stream(stream, ["user_id", "event_type"], [F.col("at"), F.col("event_id")], F.col("counter"), F.col("counter"), F.col("event_id"), genesis="genesis")
        run_to_end(told, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(told.schema).parquet(f"{root}/out").drop("at")
