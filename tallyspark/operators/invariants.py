"""Invariants as relations of violations; a check passes if its relation is empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def integrity(declared: DataFrame, found: DataFrame) -> DataFrame:
    """(path, reason) of declared files (path, sha256) that are missing or have another digest; case of hex is ignored."""
    joined = declared.select("path", F.lower("sha256").alias("wanted")).join(found.select("path", F.lower("sha256").alias("got")), "path", "left")
    reason = F.when(F.col("got").isNull(), "missing").when(F.col("got") != F.col("wanted"), "digest differs")
    return joined.select("path", reason.alias("reason")).where("reason is not null")


def set_closure(declared: DataFrame, found: DataFrame) -> DataFrame:
    """integrity(), and files found that nobody declared."""
    extra = found.join(declared, "path", "left_anti").select("path", F.lit("undeclared").alias("reason"))
    return integrity(declared, found).unionByName(extra)


def orphans(df: DataFrame, key: str, *owners: DataFrame) -> DataFrame:
    """Keys of df that no owner relation (with the same column) holds."""
    known = union_all([o.select(key) for o in owners])
    return df.join(known, key, "left_anti")


def conservation(paths: DataFrame, owners: DataFrame, priority: list[str]) -> DataFrame:
    """(path, owner): the first owner kind by priority of every path, `UNOWNED` where (path, kind) holds none."""
    rank = F.array_position(F.array(*[F.lit(k) for k in priority]), F.col("kind")).cast("int")
    held = owners.where(rank > 0).groupBy("path").agg(F.min(rank).alias("_r"))
    named = F.get(F.array(*[F.lit(k) for k in priority]), F.col("_r") - 1)
    return paths.select("path").distinct().join(held, "path", "left").select("path", F.coalesce(named, F.lit("UNOWNED")).alias("owner"))


def kind_counts(owned: DataFrame, kind: str = "owner") -> DataFrame:
    return owned.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def monotone_growth(prior: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Keys that were there and are gone."""
    return prior.select(key).distinct().join(current, key, "left_anti")


def rank_floor(df: DataFrame, declared: str, floor: str, order: list[str], allowed: list[str] | None = None, key: str = "path") -> DataFrame:
    """Rows declared weaker than their floor (order: weakest first) unless their key is allowed."""
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in order]), F.col(c))
    below = rank(declared) < rank(floor)
    return df.where(below & ~F.col(key).isin(allowed) if allowed else below)


def attribution(df: DataFrame, group: str, present: Column, mode: Column) -> DataFrame:
    """Groups without an attributed row (`first_match`) or with one that isn't (`all_attributed`)."""
    counts = df.groupBy(group, mode.alias("mode")).agg(F.count_if(present).alias("attributed"), F.count(F.lit(1)).alias("n"))
    fails = F.when(F.col("mode") == "first_match", F.col("attributed") == 0).otherwise(F.col("attributed") < F.col("n"))
    return counts.where(fails)


def coverage_sum(df: DataFrame, eligible: str, issued: str, withheld: str, reasons: str) -> DataFrame:
    """Rows whose counts don't add up, are negative, or whose reasons (a map of counts) don't sum to what is withheld."""
    total = F.aggregate(F.map_values(reasons), F.lit(0).cast("long"), lambda a, x: a + x)
    negative = (F.least(F.col(eligible), F.col(issued), F.col(withheld)) < 0) | F.exists(F.map_values(reasons), lambda x: x < 0)
    reason = F.when(negative, "negative count").when(F.col(issued) + F.col(withheld) != F.col(eligible), "issued + withheld <> eligible").when(total != F.col(withheld), "reasons <> withheld")
    return df.withColumn("reason", reason).where("reason is not null")


def subset_chain(df: DataFrame, outer: str, middle: str, inner: str) -> DataFrame:
    """Rows of three arrays in which inner isn't within middle, middle isn't within outer, or one isn't sorted."""
    reason = (
        F.when(F.size(F.array_except(middle, outer)) > 0, f"{middle} not in {outer}")
        .when(F.size(F.array_except(inner, middle)) > 0, f"{inner} not in {middle}")
        .when(not_sorted(outer) | not_sorted(middle) | not_sorted(inner), "not sorted")
    )
    return df.withColumn("reason", reason).where("reason is not null")


def not_sorted(array: str) -> Column:
    return F.array_sort(array) != F.col(array)


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value isn't one of those allowed; null isn't."""
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def implications(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row per broken rule: where the first condition holds and the second doesn't."""
    broken = F.array(*[F.when(F.coalesce(a, F.lit(False)) & ~F.coalesce(b, F.lit(False)), F.lit(name)) for name, (a, b) in rules.items()])
    return df.withColumn("rule", F.explode(F.filter(broken, lambda x: x.isNotNull())))


def interval_conflicts(df: DataFrame, group: str, low: str, high: str) -> DataFrame:
    """Groups in which some interval begins after another has ended: the largest low end is above the smallest high end."""
    return df.groupBy(group).agg(F.max(low).alias("max_low"), F.min(high).alias("min_high")).where("max_low > min_high")


def uncovered(present: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    """Keys that are present and that nobody verified: what could not be concluded."""
    return present.select(key).distinct().join(verified, key, "left_anti")


def count_mismatch(declared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, declared, found) of keys declared and found in different numbers."""
    d = declared.groupBy(key).agg(F.count(F.lit(1)).alias("declared"))
    f = found.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    joined = d.join(f, key, "full").na.fill(0, ["declared", "found"])
    return joined.where("declared <> found or declared <> 1")


def one_value_each(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys bound to more than one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def weakest_mismatch(df: DataFrame, claimed: str, derived: str) -> DataFrame:
    """Rows whose claimed aggregate isn't exactly the derived one, neither above nor below."""
    return df.where(~F.col(claimed).eqNullSafe(F.col(derived)))


def low_entropy(df: DataFrame, content: str, least: int = 32) -> DataFrame:
    """Contents so short that their digest can be guessed."""
    return df.where(F.octet_length(content) < least)


def revocation(df: DataFrame, now: str, max_age_days: int) -> DataFrame:
    """Adds the state of a revocation list: not_yet_valid, expired (only after expires_at itself), stale, revoked or fresh, in this order."""
    at = F.lit(now).cast("timestamp")
    state = (
        F.when(F.col("issued_at") > at, "not_yet_valid")
        .when(F.col("expires_at").isNotNull() & (F.col("expires_at") < at), "expired")
        .when(F.col("issued_at") + F.expr(f"interval {max_age_days} days") < at, "stale")
        .when(F.col("not_after").isNotNull() & (F.col("not_after") <= at), "revoked")
    )
    return df.withColumn("state", state).withColumn("state", F.coalesce("state", F.lit("fresh")))


def balanced(text: Column) -> Column:
    """Whether parentheses close in order."""
    marks = F.split(F.regexp_replace(text, r"[^()]", ""), "")
    depth = F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda s, c: F.struct((s["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), F.least(s["low"], s["d"] + F.when(c == ")", -1).otherwise(0)).alias("low")))
    return (depth["d"] == 0) & (depth["low"] >= 0)


def componentwise_below(df: DataFrame, declared: list[str], floor: list[str]) -> DataFrame:
    """Rows whose declared profile isn't at least the floor in every component."""
    short = reduce(lambda a, b: a | b, [F.col(d) < F.col(f) for d, f in zip(declared, floor, strict=True)])
    return df.where(short)
