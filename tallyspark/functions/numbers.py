"""Exact integer arithmetic, scores and hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column) -> Column:
    """An amount as whole cents."""
    return F.round(amount * 100).cast("long")


def half_up(numerator: Column, denominator: Column | int) -> Column:
    """Integer division rounded half up, for what isn't negative; a negative numerator fails."""
    d = F.lit(denominator).cast("long") if isinstance(denominator, int) else denominator
    exact = F.call_function("div", numerator + F.call_function("div", d, F.lit(2).cast("long")), d)
    return F.when(numerator < 0, F.raise_error(F.lit("negative numerator"))).otherwise(exact).cast("long")


def floor_div(a: Column, b: int) -> Column:
    """Division towards minus infinity."""
    return F.call_function("div", a - F.pmod(a, F.lit(b)), F.lit(b)).cast("long")


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def min_max(value: Column, low: float, high: float) -> Column:
    """Where a value stands between two bounds, from 0 to 1."""
    return clip((value - low) / (high - low), 0.0, 1.0)


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def logistic(terms: dict[str, float], intercept: float) -> Column:
    """1 / (1 + e^-z) of a linear form over columns, added in the order given."""
    z = reduce(lambda total, t: total + F.col(t[0]) * t[1], terms.items(), F.lit(intercept))
    return 1.0 / (1.0 + F.exp(-z))


def hash_unit(text: Column) -> Column:
    """A double in [0, 1): the first 64 bits of the text's SHA-256, big-endian, over 2^64."""
    high = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return high.cast("double") / float(2**64)


def dot(weights: list, values: Column) -> Column:
    """The integer dot product with a literal vector."""
    w = F.array(*[F.lit(int(x)).cast("long") for x in weights])
    return F.aggregate(F.zip_with(w, values, lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b)


def first_argmax(scores: Column) -> Column:
    """The number, from 0, of the first largest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def float32_dot(weights: list[float], values: Column, bias: float) -> Column:
    """A dot product added up as doubles and rounded once to a float."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    total = F.aggregate(F.zip_with(w, values, lambda a, b: a * b.cast("double")), F.lit(float(bias)), lambda a, b: a + b)
    return total.cast("float").cast("double")


def character_buckets(text: Column, buckets: int = 32) -> Column:
    """How many characters fall into each bucket by the CRC-32 of their UTF-8 bytes."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    numbers = F.transform(chars, lambda c: F.crc32(F.encode(c, "UTF-8")) % buckets)
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(numbers, lambda n: n == b)))


def cascade(*rules: tuple[Column, object], otherwise) -> Column:
    """The value of the first rule whose condition holds; a null condition doesn't."""
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), F.lit(rules[0][1]) if not isinstance(rules[0][1], Column) else rules[0][1])
    for condition, value in rules[1:]:
        out = out.when(F.coalesce(condition, F.lit(False)), value)
    return out.otherwise(otherwise)


def compare(op: str, left: Column, right) -> Column:
    """A condition of a rule by the name of its operator; missing values make it false, unknown names fail."""
    ops = {
        "gt": lambda: left > right, ">": lambda: left > right, "lt": lambda: left < right, "<": lambda: left < right,
        "ge": lambda: left >= right, ">=": lambda: left >= right, "le": lambda: left <= right, "<=": lambda: left <= right,
        "eq": lambda: left == right, "==": lambda: left == right, "ne": lambda: left != right, "!=": lambda: left != right,
        "in": lambda: left.isin(*right), "not_in": lambda: ~left.isin(*right),
    }
    if op not in ops:
        raise ValueError(f"unknown comparator {op!r}")
    return F.coalesce(ops[op](), F.lit(False))
