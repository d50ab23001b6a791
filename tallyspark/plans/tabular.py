"""Aggregates declared as JSON: select, group_by, order_by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _select(spec: dict) -> tuple[list[str], list[Column], list[str]]:
    """Group columns, aggregates and names in the order of selection; anything unknown fails."""
    groups, aggregates, names = list(spec["group_by"]), [], []
    for item in spec["select"]:
        if item["kind"] == "column":
            if item["name"] not in groups:
                raise ValueError(f"{item['name']} is selected but not grouped by")
            names.append(item["name"])
        elif item["kind"] == "agg" and item["func"] == "sum":
            aggregates.append(F.sum(F.col(item["column"]).cast("long")).cast("long").alias(item["alias"]))
            names.append(item["alias"])
        elif item["kind"] == "agg" and item["func"] == "count":
            aggregates.append(F.count(F.lit(1)).alias(item["alias"]))
            names.append(item["alias"])
        else:
            raise ValueError(f"cannot select {item}")
    return groups, aggregates, names


def aggregate(df: DataFrame, spec: dict) -> DataFrame:
    """The grouped result, ordered by its order_by columns as text."""
    groups, aggregates, names = _select(spec)
    return df.groupBy(*groups).agg(*aggregates).select(*names).orderBy(*[F.col(c).cast("string") for c in spec["order_by"]])


def result_digest(df: DataFrame, spec: dict) -> DataFrame:
    """SHA-256 of the result as CSV: a header, LF between lines, none at the end. The result, not the input, is gathered."""
    groups, aggregates, names = _select(spec)
    result = df.groupBy(*groups).agg(*aggregates)
    order = F.struct(*[F.col(c).cast("string") for c in [*spec["order_by"], *names]])
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in names])
    lines = result.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("line")))).alias("rows"))
    body = F.concat(F.array(F.lit(",".join(names))), F.transform("rows", lambda r: r["line"]))
    return lines.select(F.sha2(F.array_join(body, "\n"), 256).alias("result_sha"))
