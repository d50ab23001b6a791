"""Bounded traversal of edge relations."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.sources.lineage import cut


def reachable(edges: DataFrame, starts: DataFrame, most: int | None) -> DataFrame:
    """(start, node, depth): what is reached over edges (src, dst) in at most so many steps (None: all), at its least depth; the start itself never is.

    A step joins the frontier with the edges and drops what was seen before,
    so cycles end; the loop stops when a frontier is empty. Edges, dealt by
    src, and frontiers are checkpointed; none is collected or broadcast, as
    every broadcast of every step passes the driver.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = cut(edges.select("src", "dst").distinct().repartition(parts, "src").sortWithinPartitions("src")).hint("merge")
    frontier = starts.select(F.col("start"), F.col("start").alias("node")).distinct()
    seen = frontier.withColumn("depth", F.lit(0))
    for depth in itertools.count(1) if most is None else range(1, most + 1):
        step = frontier.join(links, frontier["node"] == links["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen.hint("merge"), ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
    return seen.where("depth > 0")


def dependency_closure(packages: DataFrame, root: str, most: int | None = None) -> DataFrame:
    """(id, depth, hash, n_deps) of a root and all it depends on; ids without a package are leaves with an empty hash. What is deeper than a stated `most` fails."""
    edges = packages.select(F.col("id").alias("src"), F.explode("deps").alias("dst"))
    spark = packages.sparkSession
    start = spark.createDataFrame([(root,)], "start string")
    below = reachable(edges, start, None if most is None else most + 1)
    if most is not None and not below.where(F.col("depth") > most).isEmpty():
        raise ValueError(f"dependencies deeper than {most}")
    found = below.select(F.col("node").alias("id"), "depth").unionByName(start.select(F.col("start").alias("id"), F.lit(0).alias("depth")))
    # Files of few bytes can hold millions of packages, and Spark would broadcast them by their bytes.
    joined = found.join(packages.hint("merge"), "id", "left")
    return joined.select("id", "depth", F.coalesce("hash", F.lit("")).alias("hash"), F.coalesce(F.size("deps"), F.lit(0)).alias("n_deps"))
