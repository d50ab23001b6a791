"""Comparators: relations that hold what differs. Equal results give no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.numbers import finite
from tallyspark.functions.text import normalise, normalise_ascii

KINDS = ("exact", "scalar_epsilon", "set", "text_normalized", "structured")


def _typed(expected: DataFrame, actual: DataFrame, columns: list[str]) -> None:
    for c in columns:
        if expected.schema[c].dataType != actual.schema[c].dataType:
            raise TypeError(f"column {c}: {expected.schema[c].dataType} and {actual.schema[c].dataType}")


def by_ordinal(expected: DataFrame, actual: DataFrame, ordinal: str, columns: list[str], differs: Callable[[Column, Column], Column]) -> DataFrame:
    """(ordinal, column, expected, actual) of what differs; a row on one side alone differs as `<row>`."""
    _typed(expected, actual, columns)
    e = expected.select(F.col(ordinal), F.struct(*columns).alias("e"))
    a = actual.select(F.col(ordinal), F.struct(*columns).alias("a"))
    joined = e.join(a, ordinal, "full")
    lone = F.col("e").isNull() | F.col("a").isNull()
    cell = lambda c: F.struct(F.lit(c).alias("column"), F.col(f"e.{c}").cast("string").alias("expected"), F.col(f"a.{c}").cast("string").alias("actual"), differs(F.col(f"e.{c}"), F.col(f"a.{c}")).alias("differs"))
    row = F.array(F.struct(F.lit("<row>").alias("column"), F.col("e").cast("string").alias("expected"), F.col("a").cast("string").alias("actual"), F.lit(True).alias("differs")))
    cells = F.when(lone, row).otherwise(F.array(*[cell(c) for c in columns]))
    return joined.select(ordinal, F.explode(cells).alias("it")).where("it.differs").select(ordinal, "it.column", "it.expected", "it.actual")


def exact(expected: DataFrame, actual: DataFrame, ordinal: str, columns: list[str] | None = None) -> DataFrame:
    """Row by row in order, column by column, nulls equal. Types must be the same."""
    columns = columns or [c for c in expected.columns if c != ordinal]
    return by_ordinal(expected, actual, ordinal, columns, lambda x, y: ~x.eqNullSafe(y))


def scalar_epsilon(expected: DataFrame, actual: DataFrame, ordinal: str, columns: list[str], epsilon: float) -> DataFrame:
    """Numbers more than epsilon apart; what is null or not finite on either side differs always."""
    if not 0 <= epsilon < float("inf"):
        raise ValueError("epsilon must be finite and not negative")
    near = lambda x, y: F.coalesce(finite(x) & finite(y) & (F.abs(x - y) <= epsilon), F.lit(False))
    return by_ordinal(expected, actual, ordinal, columns, lambda x, y: ~near(x, y))


def multiset(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows one side holds more often than the other, with the surplus of expected (negative: of actual). One aggregate of both."""
    columns = expected.columns
    _typed(expected, actual, columns)
    both = expected.select(*columns, F.lit(1).alias("_s")).unionByName(actual.select(*columns, F.lit(-1).alias("_s")))
    return both.groupBy(*columns).agg(F.sum("_s").alias("surplus")).where("surplus <> 0")


def text_normalized(expected: DataFrame, actual: DataFrame, ordinal: str, columns: list[str], ascii_only: bool = False) -> DataFrame:
    """Texts that differ after normalisation."""
    profile = normalise_ascii if ascii_only else normalise
    shown = lambda df: df.select(ordinal, *[profile(F.col(c)).alias(c) for c in columns])
    return exact(shown(expected), shown(actual), ordinal, columns)


def structured(expected: DataFrame, actual: DataFrame, ordinal: str, listed: list[str]) -> DataFrame:
    """As exact, by the listed columns alone."""
    return exact(expected.select(ordinal, *listed), actual.select(ordinal, *listed), ordinal, listed)


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n) of number columns (or arrays of numbers) that hold infinities or NaN."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    bad = lambda c: F.exists(c, lambda x: ~finite(x)) if c in arrays else ~finite(F.col(c))
    counts = df.agg(*[F.count_if(bad(c)).alias(c) for c in columns])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("it")).select("it.*").where("n > 0")


def comparator(kind: str, **params) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A comparator by name with its parameters; unknown names and parameters fail before anything is read."""
    wanted = {"exact": {"ordinal"}, "scalar_epsilon": {"ordinal", "columns", "epsilon"}, "set": set(), "text_normalized": {"ordinal", "columns"}, "structured": {"ordinal", "listed"}}
    if kind not in wanted:
        raise ValueError(f"unknown comparator {kind!r}")
    if set(params) != wanted[kind]:
        raise ValueError(f"{kind} takes {sorted(wanted[kind])}, not {sorted(params)}")
    if kind == "scalar_epsilon" and not (isinstance(params["epsilon"], int | float) and not isinstance(params["epsilon"], bool) and 0 <= params["epsilon"] < float("inf")):
        raise ValueError("epsilon must be a finite number, not negative")
    run = {"exact": exact, "scalar_epsilon": scalar_epsilon, "set": multiset, "text_normalized": text_normalized, "structured": structured}[kind]
    return lambda expected, actual: run(expected, actual, **params)
