"""Findings and the verdict they compose to."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From best to worst. A crash hides what else was found, so it outranks a rejection; what could not be concluded doesn't.
ORDER = ("OK", "INCOMPLETE", "REJECT", "CRASH")
#: Three states: a crash and an incomplete check are both ERROR.
STATE = {"OK": "OK", "INCOMPLETE": "ERROR", "REJECT": "REJECT", "CRASH": "ERROR"}
FINDINGS = "check string, severity string, code string, key string, detail string"


def findings(violations: DataFrame, check: str, severity: str, code: str, key: str) -> DataFrame:
    """Violations as findings; the row itself is the detail."""
    return violations.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(key).cast("string").alias("key"), F.to_json(F.struct(*violations.columns)).alias("detail"))


def compose(found: DataFrame, gating: list[str] | None = None) -> DataFrame:
    """One row (verdict, severity, n_findings): the worst severity of checks that gate; advisory ones don't count. No finding is OK."""
    ranks = F.array(*[F.lit(s) for s in ORDER])
    rank = F.array_position(ranks, F.col("severity")).cast("int")
    known = F.when(F.coalesce(rank, F.lit(0)) == 0, F.raise_error(F.concat(F.lit("unknown severity "), F.col("severity")))).otherwise(rank)
    counted = found if gating is None else found.where(F.col("check").isin(gating))
    worst = counted.agg(F.coalesce(F.max(known), F.lit(1)).alias("worst"), F.count_if(F.col("severity") != "OK").alias("n_findings"))
    severity = F.get(ranks, F.col("worst") - 1)
    state = reduce(lambda out, s: out.when(severity == s, STATE[s]), ORDER[1:], F.when(severity == "OK", "OK"))
    return worst.select(state.alias("verdict"), severity.alias("severity"), "n_findings")


@dataclass(frozen=True)
class Output:
    """A claimed result and how it is recomputed and compared."""

    name: str
    kind: str
    claimed: DataFrame


@dataclass(frozen=True)
class Binding:
    """What a kind of output is bound to: a derivation (spark, sources, params) -> DataFrame, a comparator, parameters."""

    derive: object
    comparator: object
    params: dict


def verify(spark, sources: dict[str, DataFrame], outputs: list[Output], bindings: dict[str, Binding]) -> DataFrame:
    """Findings of every output: recomputed from the sources, compared with what is claimed.

    An output whose kind nothing is bound to could not be concluded; a name
    declared twice and a result that differs are rejected.
    """
    found = [spark.createDataFrame([], FINDINGS)]
    names = [o.name for o in outputs]
    for o in outputs:
        if names.count(o.name) > 1:
            found.append(spark.createDataFrame([(o.name, "REJECT", "declared_twice", o.name, "")], FINDINGS))
        elif o.kind not in bindings:
            found.append(spark.createDataFrame([(o.name, "INCOMPLETE", "nothing_bound", o.kind, "")], FINDINGS))
        else:
            bound = bindings[o.kind]
            differing = bound.comparator(bound.derive(spark, sources, bound.params), o.claimed)
            found.append(findings(differing, o.name, "REJECT", "differs", differing.columns[0]))
    return reduce(DataFrame.unionByName, found)


def ambiguous_bindings(bindings: DataFrame) -> DataFrame:
    """Kinds that more than one anchored specification binds."""
    return bindings.groupBy("kind").agg(F.count_distinct("spec").alias("n_specs")).where("n_specs > 1")


def unanchored(bindings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Bindings of specifications whose (id, digest) no auditor anchored."""
    return bindings.join(anchors, ["spec", "sha256"], "left_anti")
