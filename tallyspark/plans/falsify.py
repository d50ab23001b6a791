"""Whether a rule can fire at all, tried over a small bounded domain."""

from __future__ import annotations

import ast
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOMAIN = (-2, 2)
_COMPARES = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


def condition(node: ast.AST, named: Callable[[str], Column] = F.col) -> Column:
    """A Column of a boolean expression of names, whole numbers, comparisons, and, or, not; anything else fails. named tells what a name is."""
    if isinstance(node, ast.Expression):
        return condition(node.body, named)
    if isinstance(node, ast.BoolOp):
        parts = [condition(v, named) for v in node.values]
        return reduce((lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b), parts)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ~condition(node.operand, named)
    if isinstance(node, ast.Compare):
        terms = [_term(x, named) for x in (node.left, *node.comparators)]
        parts = [_COMPARES[type(op)](a, b) for op, a, b in zip(node.ops, terms, terms[1:], strict=False) if type(op) in _COMPARES]
        if len(parts) == len(node.ops):
            return reduce(lambda a, b: a & b, parts)
    if isinstance(node, ast.Constant) and isinstance(node.value, bool):
        return F.lit(node.value)
    if isinstance(node, ast.Name | ast.Constant):
        return _term(node, named) != 0
    raise ValueError(f"not in the grammar: {ast.dump(node)}")


def _term(node: ast.AST, named: Callable[[str], Column] = F.col) -> Column:
    if isinstance(node, ast.Name):
        return named(node.id)
    if isinstance(node, ast.Constant) and isinstance(node.value, int):
        return F.lit(int(node.value))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant) and isinstance(node.operand.value, int):
        return F.lit(-node.operand.value)
    raise ValueError(f"not in the grammar: {ast.dump(node)}")


def falsifiable(spark: SparkSession, rules: dict[str, str]) -> DataFrame:
    """(rule_id, falsifiable): whether some assignment of -2 to 2 makes the rule true; null where it isn't in the grammar."""
    out = []
    for rule, text in rules.items():
        try:
            tree = ast.parse(text, mode="eval")
            fires = condition(tree)
        except (SyntaxError, ValueError):
            out.append(spark.createDataFrame([(rule, None)], "rule_id string, falsifiable boolean"))
            continue
        names = sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)})
        values = spark.range(1).select()
        for name in names:
            values = values.select("*", F.explode(F.sequence(F.lit(DOMAIN[0]), F.lit(DOMAIN[1]))).alias(name))
        out.append(values.agg(F.coalesce(F.bool_or(fires), F.lit(False)).alias("falsifiable")).select(F.lit(rule).alias("rule_id"), "falsifiable"))
    return reduce(DataFrame.unionByName, out)


def can_fire(rule: str, free: list[str]) -> Column:
    """Whether some assignment of -2 to 2 to the free names makes a rule true, its other names being columns: one rule for a whole table of parameters.

    A null parameter counts as an assignment that doesn't fire where the rule comes out null by it.
    """
    tree = ast.parse(rule, mode="eval")
    domain = F.sequence(F.lit(DOMAIN[0]), F.lit(DOMAIN[1]))

    def over(names: list[str], bound: dict[str, Column]) -> Column:
        if not names:
            return F.coalesce(condition(tree, lambda n: bound[n] if n in bound else F.col(n)), F.lit(False))
        return F.exists(domain, lambda v: over(names[1:], bound | {names[0]: v}))

    return over(free, {})
