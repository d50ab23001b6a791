"""Grouped and whole-table aggregates."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def filtered_count(df: DataFrame, predicate: dict[str, object], name: str = "n") -> DataFrame:
    """How many rows equal all the given values; a null is no value."""
    holds = F.lit(True)
    for column, value in predicate.items():
        holds = holds & F.col(column).eqNullSafe(F.lit(value))
    return df.agg(F.count_if(holds).alias(name))


def laplace_noise(scale: float, seed: int) -> float:
    """One Laplace variate by inverse distribution from a seeded Mersenne Twister; a scalar that goes into the plan as a literal."""
    u = random.Random(seed).random() - 0.5
    return -scale * math.copysign(1.0, u) * math.log(1.0 - 2.0 * abs(u))


def private_count(df: DataFrame, predicate: dict[str, object], epsilon: float, sensitivity: float, seed: int) -> DataFrame:
    """A count released with Laplace noise of scale sensitivity / epsilon."""
    noise = laplace_noise(sensitivity / epsilon, seed)
    return filtered_count(df, predicate, "true_count").select("true_count", (F.col("true_count").cast("double") + F.lit(noise)).alias("noised_count"))


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole; a whole of 0 fails."""
    return F.when(whole == 0, F.raise_error(F.lit("percentage of nothing"))).otherwise(100.0 * part / whole).cast("double")


def completeness(df: DataFrame, required: list[str]) -> DataFrame:
    """Per cent of rows in which no required column is null."""
    full = F.lit(True)
    for c in required:
        full = full & F.col(c).isNotNull()
    return df.agg(percent(F.count_if(full), F.count(F.lit(1))).alias("completeness_pct"))


def duplicate_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per cent of rows beyond the first of each tuple; nulls are equal. Two-level: tuples are grouped before they are counted."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    total = F.sum("_n")
    return groups.agg(percent(total - F.count(F.lit(1)), total).alias("duplicate_pct"), total.alias("n"))


def positive_rate(df: DataFrame, label: str) -> DataFrame:
    """Per cent of ones among labels that aren't null."""
    return df.agg(percent(F.count_if(F.col(label) == 1), F.count(label)).alias("positive_pct"))


def conditional_rate(df: DataFrame, condition: Column, event: Column) -> DataFrame:
    """Per cent of rows with the event among those with the condition; none of these fails."""
    return df.agg(F.count_if(condition).alias("n_condition"), percent(F.count_if(condition & event), F.count_if(condition)).alias("rate_pct"))


def disparate_impact(df: DataFrame, group: str, outcome: str) -> DataFrame:
    """The lowest over the highest favourable rate of the groups; fewer than two groups or no favourable outcome fails."""
    rates = df.groupBy(group).agg((F.sum(outcome) / F.count(outcome)).alias("rate"))
    low, high, n = F.min("rate"), F.max("rate"), F.count(F.lit(1))
    broken = (n < 2) | (high == 0)
    return rates.agg(n.alias("n_groups"), F.when(broken, F.raise_error(F.lit("no rates to compare"))).otherwise(low / high).cast("double").alias("disparate_impact"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Mann-Whitney's area with ties at their average rank; one class alone fails.

    Scores are grouped first and only their distinct values are ranked, with
    running totals of the two classes in doubled, exact integers. So that no
    task ranks them all, values are dealt into ranges, and ranges get their
    offsets from a small aggregate.
    """
    per = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    ranged = per.repartitionByRange(score).withColumn("_part", F.spark_partition_id())
    parts = ranged.groupBy("_part").agg(F.sum("q").alias("_q"))
    before = F.sum("_q").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    starts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.sum("q").over(W.partitionBy("_part").orderBy(score).rowsBetween(W.unboundedPreceding, 0))
    below = ranged.withColumn("_run", within).join(F.broadcast(starts), "_part").withColumn("_below", F.col("_start") + F.col("_run") - F.col("q"))
    won = F.sum(F.col("p") * (2 * F.col("_below") + F.col("q")))
    pos, neg = F.sum("p"), F.sum("q")
    broken = (pos == 0) | (neg == 0)
    return below.agg(pos.alias("n_pos"), neg.alias("n_neg"), F.when(broken, F.raise_error(F.lit("one class only"))).otherwise(won / (2.0 * pos * neg)).cast("double").alias("auc"))


def at_index(values: Column, share: float) -> Column:
    """The element of a sorted array at the whole part of size x share, from 0."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) * share).cast("int"))


def weakest(df: DataFrame, group: list[str], value: str, order: list[str], name: str = "weakest") -> DataFrame:
    """The lowest value of each group by an ordered list of names; a name not in it fails."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(value))
    known = F.when(F.coalesce(rank, F.lit(0)) == 0, F.raise_error(F.concat(F.lit("unknown value "), F.col(value)))).otherwise(rank).cast("int")
    low = df.groupBy(*group).agg(F.min(known).alias("_rank"))
    return low.select(*group, F.get(F.array(*[F.lit(x) for x in order]), F.col("_rank") - 1).alias(name))


def rounded_total(df: DataFrame, amount: Column, factor: Column, name: str) -> DataFrame:
    """The sum of products, each rounded to 6 places, in decimals: the same in any order."""
    return df.agg(F.sum(F.round((amount * factor).cast("decimal(28,8)"), 6)).cast("decimal(38,6)").alias(name))
