"""Joins with rules, tiers, validity intervals, keywords and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.functions.numbers import compare
from tallyspark.functions.text import holds

#: Rules a literal table may hold. Beyond it, pass a DataFrame and an equi-key instead.
MOST_RULES = 10_000

Condition = tuple[str, str, object]


def conjunction(conditions: list[Condition]) -> Column:
    """All of (column, operator, value); none hold always, a missing value never."""
    return reduce(lambda a, c: a & compare(c[1], F.col(c[0]), c[2]), conditions, F.lit(True))


def _checked(rules: list) -> list:
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; a literal table holds {MOST_RULES} at most")
    return rules


def policy_matrix(df: DataFrame, rules: list[tuple[str, list[Condition], str]], missed: str = "NOT_APPLICABLE") -> DataFrame:
    """Every row with every rule (rule_id, conditions, verdict): the verdict where all conditions hold.

    Rules are literals, so this is a projection and an explode; nothing is
    joined or shuffled.
    """
    verdicts = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.when(conjunction(c), F.lit(v)).otherwise(F.lit(missed)).alias("verdict")) for i, c, v in _checked(rules)])
    return df.withColumn("_it", F.explode(verdicts)).select(*df.columns, "_it.*")


def first_match(df: DataFrame, rules: list[tuple[str, list[Condition], str]], default: str) -> DataFrame:
    """The verdict of the rule with the lowest rule_id whose conditions all hold; else the default with a null rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(default)
    for i, conditions, v in sorted(_checked(rules), reverse=True):
        holds = conjunction(conditions)
        rule, verdict = F.when(holds, F.lit(i)).otherwise(rule), F.when(holds, F.lit(v)).otherwise(verdict)
    return df.withColumns({"rule_id": rule, "verdict": verdict})


def division(facts: DataFrame, rules: DataFrame, entity: list[str], item: str, rule: str) -> DataFrame:
    """(entity, rule) for which an entity has every item that the rule requires.

    facts (entity, item) and rules (rule, item) may both be large; duplicate
    facts count once.
    """
    required = rules.select(rule, item).distinct()
    sizes = required.groupBy(rule).agg(F.count(F.lit(1)).alias("_needed"))
    met = facts.select(*entity, item).distinct().join(required, item).groupBy(*entity, rule).agg(F.count(F.lit(1)).alias("_met"))
    return met.join(sizes, rule).where(F.col("_met") == F.col("_needed")).select(*entity, rule)


def tier(value: Column, tiers: list[tuple[float, float, str]]) -> Column:
    """The first half-open tier (from, to, name) that holds the value; the last one where none does."""
    out = F.lit(tiers[-1][2])
    for low, high, name in reversed(tiers):
        out = F.when((value >= low) & (value < high), F.lit(name)).otherwise(out)
    return out


def valid_at(df: DataFrame, ts: str, intervals: DataFrame, key: str | None = None) -> DataFrame:
    """The first interval (ordinal, start, end) that covers each instant, [start, end) with a null end open; none fails.

    intervals are a small literal table, or one with an equi-key.
    """
    covers = (F.col("start") <= F.col(ts)) & (F.col("end").isNull() | (F.col(ts) < F.col("end")))
    condition = covers if key is None else (df[key] == intervals[key]) & covers
    marked = df.withColumn("_row", F.monotonically_increasing_id())
    joined = marked.join(F.broadcast(intervals) if key is None else intervals, condition, "left")
    if key is not None:
        joined = joined.drop(intervals[key])
    first = joined.withColumn("_at", F.row_number().over(W.partitionBy("_row").orderBy("ordinal"))).where("_at = 1")
    known = F.when(F.col("ordinal").isNull(), F.raise_error(F.lit("no interval covers the instant"))).otherwise(F.col("ordinal"))
    return first.withColumn("ordinal", known).drop("_row", "_at")


def resolve(df: DataFrame, corpus: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Left join on a key that must be unique in the corpus; adds columns and resolved. A key held by different rows fails."""
    known = corpus.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in columns])
    unique = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("ambiguous key "), F.col(key)))).otherwise(F.lit(True)).cast("boolean")
    return df.join(known.withColumn("resolved", unique).drop("_n"), key, "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


#: Items (two longs each) whose keys are broadcast at most; more are joined.
MOST_KEYS = 500_000


def quoted(items: DataFrame, docs: DataFrame, key: str, block: int = 5_000) -> DataFrame:
    """Rows of docs whose `whole` holds the `quote` of a row of items, with that row.

    A text that holds a quote of five words or more, words being what stands
    between single spaces, has the quote's second to fourth word as they are:
    their hash finds the candidates, containment decides. Shorter quotes are
    tried against all docs in blocks of about so many, each broadcast.
    """
    words = lambda c: F.split(F.col(c), " ", -1)
    three = lambda ws, i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    is_long = F.coalesce(F.size(words("quote")) >= 5, F.lit(False))
    known = items.where(is_long).withColumn("_key", three(words("quote"), F.lit(1)))
    keys = known.select("_key").distinct()
    hashed = docs.select(F.xxhash64("whole").alias("_text"), words("whole").alias("_words")).where(F.size("_words") >= 5)
    in_text = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda i: three(F.col("_words"), i)))
    met = hashed.select("_text", F.explode(in_text).alias("_key"))
    met = met.join(F.broadcast(keys) if items.count() <= MOST_KEYS else keys, "_key").distinct()
    pairs = met.join(known, "_key").drop("_key")
    long = docs.withColumn("_text", F.xxhash64("whole")).join(pairs, "_text").where(holds(F.col("whole"), F.col("quote"))).drop("_text")
    rest = items.where(~is_long & (F.length("quote") > 0))
    blocks = -(-rest.count() // block)
    mine = [rest if blocks == 1 else rest.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i) for i in range(blocks)]
    return reduce(DataFrame.unionByName, [docs.join(F.broadcast(b), holds(F.col("whole"), F.col("quote"))) for b in mine], long)


def keyword_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, word: str) -> DataFrame:
    """(left_id, right_id, overlap) of the pairs that share a keyword; both sides hold a row per (id, word)."""
    a, b = left.select(left_id, word).distinct(), right.select(right_id, word).distinct()
    return a.join(b, word).groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("overlap"))


def best_overlaps(pairs: DataFrame, left_id: str, right_id: str, most: int) -> DataFrame:
    """The best partners of each left row by overlap, then id."""
    at = F.row_number().over(W.partitionBy(left_id).orderBy(F.desc("overlap"), F.col(right_id)))
    return pairs.withColumn("rank", at.cast("long")).where(F.col("rank") <= most)


def all_rooted(df: DataFrame, rooted: Column) -> DataFrame:
    """Whether there are rows and every one is rooted."""
    return df.agg((F.coalesce(F.bool_and(rooted), F.lit(False)) & (F.count(F.lit(1)) > 0)).alias("admitted"), F.count(F.lit(1)).alias("n"))
