"""Combinations of one row from each of several relations: counts by status and the best k, without making all of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.lineage import cut

#: A function of the sums of all measures, by name.
OfSums = Callable[[dict[str, Column]], Column]


def _classes(side: DataFrame, measures: list[str], number: int) -> DataFrame:
    """Rows of equal measures are one class, with their count."""
    whole = side.where(reduce(lambda a, b: a & b, [F.col(m).isNotNull() for m in measures]))
    return whole.groupBy(*[F.col(m).alias(f"{m}_{number}") for m in measures]).agg(F.count(F.lit(1)).alias(f"n_{number}"))


def status_counts(sides: list[DataFrame], measures: list[str], status: OfSums) -> DataFrame:
    """(status, n): how many of all combinations have each status.

    Sides are folded one after another into a histogram of sums, so what is
    made is the number of different sums, not of combinations. Rows that lack
    a measure take no part; with an empty side there is no combination.
    Measures should be whole numbers or decimals: sums of doubles differ by
    order, and hardly two are equal.
    """
    total = None
    for i, side in enumerate(sides):
        here = _classes(side, measures, i)
        if total is None:
            total = here.select(*[F.col(f"{m}_{i}").alias(m) for m in measures], F.col(f"n_{i}").cast("decimal(38,0)").alias("n"))
        else:
            sums = [(F.col(m) + F.col(f"{m}_{i}")).alias(m) for m in measures]
            total = total.crossJoin(here).select(*sums, (F.col("n") * F.col(f"n_{i}")).cast("decimal(38,0)").alias("n"))
            total = total.groupBy(*measures).agg(F.sum("n").alias("n"))
    named = status({m: F.col(m) for m in measures})
    return total.groupBy(named.alias("status")).agg(F.sum("n").cast("decimal(38,0)").alias("n"))


def best_combinations(sides: list[DataFrame], keys: list[str], measures: list[str], passes: OfSums, least: OfSums, score: Callable[[list[Column], dict[str, Column]], Column], k: int, top: Callable[[list[Column]], Column] | None = None) -> DataFrame:
    """(id, score) of the k combinations that pass with the least scores, ties to the smaller id.

    passes and least see the sums of measures alone; least must never be above
    the score of a combination with these sums. score sees the keys, too. An
    id is the keys joined by `__` unless top makes it.

    Classes of equal measures are combined first. Some k combinations of the
    classes with the smallest bounds give a score that the k-th best cannot
    exceed, and only classes whose bound reaches it are made into rows, by
    equi-joins on their measures: every combination left out has k better
    ones. Rows that lack a measure take no part; fewer than k are all returned.
    """
    n = range(len(sides))
    top = top or (lambda parts: F.concat_ws("__", *parts))
    met = reduce(DataFrame.crossJoin, [_classes(side, measures, i) for i, side in enumerate(sides)])
    sums = {m: reduce(lambda a, b: a + b, [F.col(f"{m}_{i}") for i in n]) for m in measures}
    met = cut(met.where(passes(sums)).withColumn("_least", least(sums)).where("_least is not null"))

    def rows(classes: DataFrame) -> DataFrame:
        for i, side in enumerate(sides):
            own = side.select(F.col(keys[i]).cast("string").alias(f"_key{i}"), *[F.col(m).alias(f"_own_{m}") for m in measures])
            same = reduce(lambda a, b: a & b, [F.col(f"_own_{m}") == F.col(f"{m}_{i}") for m in measures])
            classes = classes.join(own, same).drop(*[f"_own_{m}" for m in measures])
        parts = [F.col(f"_key{i}") for i in n]
        return classes.select(top(parts).alias("id"), score(parts, sums).alias("score")).orderBy("score", "id").limit(k)

    first = rows(met.orderBy("_least").limit(k)).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("reach")).first()
    return rows(met if first["n"] < k else met.where(F.col("_least") <= F.lit(first["reach"])))
