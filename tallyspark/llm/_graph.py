"""Connected components and the search for links that avoids all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm._common import Table, drop_tables, small, write_table

#: Comparisons for each entry up to which all pairs across components are tried at once.
LOAD = 5
#: Most rows (two longs each) of a relation of nodes that is broadcast.
FEW = 500_000


def components(edges: DataFrame) -> Table:
    """Edges (a, b) from each node to the smallest node reachable from it; that one itself is in no row as a.

    Alternates the large-star and small-star steps until they change nothing.
    Each step is a minimum per node (combined map-side) joined back to the
    edges, so a node with very many neighbours is never gathered; every round
    is written. Null ends and loops are dropped; no edges give no rows.
    """
    print_of = F.bit_xor(F.xxhash64("a", "b"))
    now = write_table(_stars(edges.where("a <> b")), print=print_of)
    while now.count:
        then = write_table(_stars(now.rows), print=print_of)
        drop_tables(now)
        if (then.count, then.also["print"]) == (now.count, now.also["print"]):
            return then
        now = then
    return now


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step and one small-star step."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    ends = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return ends.select("e.*").where("a <> b").distinct()


def linked_components(
    entries: Table,
    traits: DataFrame,
    screen: Callable[[DataFrame], DataFrame],
    near: Callable[[DataFrame, DataFrame, bool], DataFrame],
    verify: Callable[[Table], Table],
    crowded: Column | None = None,
    crowd_links: Callable[[DataFrame], DataFrame] | None = None,
) -> Table:
    """The components, as edges to their smallest nodes, of the graph whose links are the verified pairs among nodes that share a key.

    entries: (key, block, node, ...) with keys of two nodes or more; traits:
    (node, ...) that near() also needs. near(left, right, once) joins two such
    sets on what can link, giving (a, b) for each key that both have or, if it
    can and once is set, for one of them; screen(pairs) keeps those of (a, b)
    that can; verify(pairs) keeps those that do link.

    1. Each node is tried against one centre: of the nodes that have most
       keys in common with others in its keys (in a group of near copies those
       nearest to what they were copied from), the one it shares most keys with.
    2. What stands in keys with several components is open. While pairs across
       components are many for the entries there are, each node outside its
       key's largest component is tried against one member of that.
    3. Once they are few, or a round of 2 doesn't halve them, all are tried;
       those of crowded entries (a condition on what _open gives) not as rows:
       crowd_links(entries) gives their links.

    A pair is left untried only if both ends lie in one component already, so
    the components are those of all links, while a group that is joined early
    costs nothing more, whatever its size.
    """
    tried = [write_table(screen(_to_centres(entries.rows)))]
    links = verify(tried[0])
    placed = components(links.rows)
    last, load = False, float("inf")
    while not last:
        open_ = write_table(_open(entries.rows, placed, traits), load=F.sum(F.when(F.col("component") != F.col("largest"), F.col("entries")).otherwise(0)))
        if not open_.count:
            drop_tables(open_)
            break
        outside = open_.rows.where("component <> largest")
        last = not links.count or open_.also["load"] <= LOAD * entries.count or open_.also["load"] > load / 2
        load = open_.also["load"]
        if last and crowd_links is not None:
            # A pair may share a crowded key before one that is not, so all of the latter give it.
            pairs = near(outside.where(~crowded), open_.rows.where(~crowded), False).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        elif last:
            pairs = near(outside, open_.rows, True).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        else:
            pairs = _met_most(near(outside, _one_of_the_largest(open_.rows), False))
        for t in tried:
            pairs = pairs.join(t.rows.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")), (F.greatest("a", "b") == F.col("x")) & (F.least("a", "b") == F.col("y")), "left_anti")
        tried.append(write_table(pairs))
        drop_tables(links)
        links = verify(tried[-1])
        found = [links]
        if last and crowd_links is not None and not open_.rows.where(crowded).isEmpty():
            found.append(write_table(crowd_links(open_.rows.where(crowded))))
        drop_tables(open_)
        if any(t.count for t in found):
            before, placed = placed, components(reduce(DataFrame.union, [t.rows.select("a", "b") for t in (placed, *found)]))
            drop_tables(before, *found[1:])
    drop_tables(links, *tried)
    return placed


def _to_centres(entries: DataFrame) -> DataFrame:
    """(a, b): each node and the one centre that it shares most keys with."""
    shared = entries.groupBy("node").agg(F.count(F.lit(1)).alias("keys"))
    ranked = entries.select("key", "block", "node").join(shared, "node")
    centres = ranked.groupBy("key", "block").agg(F.max(F.struct("keys", "node")).alias("top"), F.count(F.lit(1)).alias("held")).where("held > 1")
    pairs = entries.select("key", "block", "node").join(centres.select("key", "block", F.col("top.node").alias("centre")), ["key", "block"])
    return _met_most(pairs.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")))


def _open(entries: DataFrame, placed: Table, traits: DataFrame) -> DataFrame:
    """The entries of keys with several components: theirs, the largest one of the key, and how many entries the key has."""
    named = small(placed, FEW).select(F.col("a").alias("node"), F.col("b").alias("component"))
    known = entries.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("held"))
    split = sizes.groupBy("key").agg(F.max_by("component", F.struct("held", "component")).alias("largest"), F.sum("held").alias("entries"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts")
    return known.join(split, "key").join(traits, "node")


def _met_most(pairs: DataFrame) -> DataFrame:
    """For each a, the b it is paired with most often."""
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"))
    return counted.groupBy("a").agg(F.max(F.struct("met", "b")).alias("best")).select("a", F.col("best.b").alias("b"))


def _one_of_the_largest(open_: DataFrame) -> DataFrame:
    """For each key, the member of its largest component that a hash of both picks."""
    named = [c for c in open_.columns if c != "key"]
    pick = F.max_by(F.struct(*named), F.struct(F.xxhash64("key", "node"), "node"))
    return open_.where("component = largest").groupBy("key").agg(pick.alias("it")).select("key", "it.*")
