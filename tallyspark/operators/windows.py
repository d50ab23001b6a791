"""Ordered computations within a group: velocity, gaps, chains, replay, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.times import micros


def tumbling(df: DataFrame, ts: str, size: str, value: str) -> DataFrame:
    """(window_start, sum, count, max) of every event-time window that holds an event; batch replay drops none."""
    return df.groupBy(F.window(ts, size).alias("w")).agg(F.sum(value).alias("value_sum"), F.count(F.lit(1)).alias("event_count"), F.max(value).alias("value_max")).select(F.col("w.start").alias("window_start"), "value_sum", "event_count", "value_max")


def window_index(ts_ms: Column, size_ms: int) -> Column:
    """The number of the window an instant falls in, floored also before the epoch."""
    return F.call_function("div", ts_ms - F.pmod(ts_ms, F.lit(size_ms)), F.lit(size_ms)).cast("long")


def forward_velocity(df: DataFrame, key: str, ts: str, chosen: Column, seconds: int, name: str) -> DataFrame:
    """For each key the largest number of chosen rows in [t, t + seconds) over chosen rows t; 0 without any."""
    marked = df.withColumn("_s", micros(F.col(ts))).withColumn("_in", F.coalesce(chosen, F.lit(False)).cast("long"))
    ahead = W.partitionBy(key).orderBy("_s").rangeBetween(W.currentRow, seconds * 1_000_000 - 1)
    counted = marked.withColumn("_n", F.when(F.col("_in") == 1, F.sum("_in").over(ahead)).otherwise(0))
    return counted.groupBy(key).agg(F.max("_n").cast("long").alias(name))


def rmssd(df: DataFrame, key: str, order: list[str], rate: str, name: str = "rmssd_ms") -> DataFrame:
    """Root mean square of successive differences of 60000 / rate within a key; fewer than two give 0."""
    beats = df.where(F.col(rate) > 0).withColumn("_rr", 60000.0 / F.col(rate))
    gaps = beats.withColumn("_d", F.lead("_rr").over(W.partitionBy(key).orderBy(*order)) - F.col("_rr"))
    return gaps.groupBy(key).agg(F.coalesce(F.sqrt(F.avg(F.col("_d") * F.col("_d"))), F.lit(0.0)).alias(name))


def islands(df: DataFrame, key: str, index: str, active: Column, least: int = 1) -> DataFrame:
    """(key, first, last) of runs of active rows with consecutive indexes, half-open, of at least so many."""
    on = df.where(active).withColumn("_g", F.col(index) - F.row_number().over(W.partitionBy(key).orderBy(index)))
    runs = on.groupBy(key, "_g").agg(F.min(index).alias("first"), (F.max(index) + 1).alias("last"))
    return runs.where(F.col("last") - F.col("first") >= least).drop("_g")


def frames(df: DataFrame, index: str, value: str, frame: int) -> DataFrame:
    """(frame, energy) of whole frames of so many samples; the rest at the end is left out."""
    grouped = df.groupBy((F.col(index) / frame).cast("long").alias("frame")).agg(F.sum(F.col(value).cast("long") * F.col(value)).alias("energy"), F.count(F.lit(1)).alias("held"))
    return grouped.where(F.col("held") == frame).drop("held")


def counter_gaps(df: DataFrame, group: list[str], counter: str) -> DataFrame:
    """Rows whose counter isn't one more than the one before it (0 before the first)."""
    before = F.coalesce(F.lag(counter).over(W.partitionBy(*group).orderBy(counter)), F.lit(0))
    return df.withColumn("expected", (before + 1).cast("long")).where(F.col(counter) != F.col("expected"))


def not_increasing(df: DataFrame, channel: list[str], order: list[str], counter: str) -> DataFrame:
    """Rows whose counter isn't above all earlier ones of their channel."""
    past = F.max(counter).over(W.partitionBy(*channel).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("highest_before", past).where(F.col(counter) <= F.col("highest_before"))


def replays(df: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """Rows that repeat an identity seen before."""
    at = F.row_number().over(W.partitionBy(*identity).orderBy(*order))
    return df.withColumn("occurrence", at.cast("long")).where(F.col("occurrence") > 1)


def broken_links(df: DataFrame, chain: list[str], order: list[str], own: str, previous: str) -> DataFrame:
    """Rows that don't carry the hash of the row before them."""
    expected = F.lag(own).over(W.partitionBy(*chain).orderBy(*order))
    return df.withColumn("expected", expected).where(F.col("expected").isNotNull() & ~F.col("expected").eqNullSafe(F.col(previous)))


def chain_head(df: DataFrame, chain: list[str], order: Column, leaf: Column, genesis: str, name: str = "head") -> DataFrame:
    """Folds h <- sha256(h || leaf) over each chain in order. A chain is hashed in sequence by its nature, so its leaves are gathered."""
    gathered = df.select(*chain, F.struct(order.alias("o"), leaf.alias("leaf")).alias("it")).groupBy(*chain).agg(F.array_sort(F.collect_list("it")).alias("its"))
    return gathered.select(*chain, F.aggregate("its", F.lit(genesis), lambda h, x: F.sha2(F.concat(h, x["leaf"]), 256)).alias(name))


def merkle_root(leaves: Column, leaf_prefix: str = "01", node_prefix: str = "00", levels: int = 20) -> Column:
    """The root over an array of hex digests: prefixed leaves, pairs hashed level by level, an odd last one paired with itself; no leaves give the hash of the leaf prefix alone.

    At most 2^levels leaves; more fail.
    """
    digest = lambda prefix, text: F.sha2(F.unhex(F.concat(F.lit(prefix), text)), 256)
    nodes = F.transform(leaves, lambda x: digest(leaf_prefix, x))

    def up(xs: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / 2).cast("int") - 1, F.lit(0)))
        joined = F.transform(pairs, lambda i: digest(node_prefix, F.concat(F.get(xs, 2 * i), F.coalesce(F.get(xs, 2 * i + 1), F.get(xs, 2 * i)))))
        return F.when(F.size(xs) > 1, joined).otherwise(xs)

    top = F.aggregate(F.sequence(F.lit(1), F.lit(levels)), nodes, lambda xs, _: up(xs))
    return F.when(F.size(leaves) == 0, F.sha2(F.unhex(F.lit(leaf_prefix)), 256)).when(F.size(top) > 1, F.raise_error(F.lit("too many leaves"))).otherwise(F.get(top, F.lit(0)))


def ranked(df: DataFrame, order: list[Column], advance: int) -> DataFrame:
    """Rank from 1 by (order), and whether a row is among the first so many.

    Only the best `advance` rows are ranked in one place; the rank of the
    others comes from ranges and their offsets.
    """
    spread = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    counts = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    at = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    out = spread.withColumn("_row", at).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_start") + F.col("_row"))
    return out.withColumn("advanced", F.col("rank") <= advance).drop("_part", "_row", "_start")
