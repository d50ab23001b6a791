"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from tallyspark.llm._common import columns_free_of, cut

#: Hash ranges whose sizes the driver sees; with the large groups, all it ever sees, whatever the input.
CELLS = 1 << 16
#: Sub-ranges of a group that is larger than a shard may be, and of a shard when slots are counted.
PARTS = 256


class Ring:
    """Shards stand at `points` places each on a ring of 2^64 positions."""

    def __init__(self, shards: int, points: int = 128):
        spots = sorted((int.from_bytes(hashlib.sha256(f"shard {s} point {p}".encode()).digest()[:8], "big"), s) for s in range(shards) for p in range(points))
        self.places = [x for x, _ in spots]
        owners = [s for _, s in spots]
        # For each point, the shards in the order in which a clockwise walk first meets them.
        self.walks: list[tuple[int, ...]] = [()] * len(owners)
        after: list[int] = []
        for at in range(2 * len(owners) - 1, -1, -1):
            owner = owners[at % len(owners)]
            after = [owner, *(s for s in after if s != owner)]
            self.walks[at % len(owners)] = tuple(after)

    def walk(self, position: int) -> tuple[int, ...]:
        return self.walks[bisect.bisect_left(self.places, position) % len(self.places)]


def place(loads: list[tuple[int, int]], ring: Ring, free: np.ndarray) -> list[int]:
    """A shard for each (position, size) in turn: the first clockwise with room, else the one with most room left."""
    out = []
    for position, size in loads:
        shard = next((s for s in ring.walk(position) if free[s] >= size), None)
        shard = int(np.argmax(free)) if shard is None else shard
        free[shard] -= size
        out.append(shard)
    return out


def ring_shards(docs: DataFrame, shards: int = 16, slack: float = 0.0005, group: Column | None = None, size: Column | None = None) -> DataFrame:
    """Adds shard (int) and slot (long, gapless from 0 in each shard) to every row.

    Rows of one group (default: equal texts; null counts as the empty text)
    share a shard, sizes (default: UTF-8 bytes + 1) are near equal: no shard
    gets over (1 + slack) times the mean as long as single groups allow it.
    Groups go to the first virtual node clockwise from their hash; those that
    find the shard full go on clockwise. Order of placing: groups over
    slack / (4 shards) of all bytes, largest first; then the rest as 65,536
    hash ranges in ring order. Only those bounded summaries reach the driver
    (at most 4 shards / slack groups). A group larger than a whole shard's
    bound cannot be held by one: its rows are dealt in 256 parts by a hash of
    the whole row (equal rows, where many, evenly). Repeated rows get a slot each; an empty table gives no
    rows; other columns are kept whatever their names, if they don't clash with
    shard and slot, which are then written with an underscore.
    """
    group = F.coalesce(F.col("text"), F.lit("")) if group is None else group
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1 if size is None else size
    key, weight, cell, part, shard, slot, own_key, own_part, home, own_range = columns_free_of(docs, "_key", "_weight", "_cell", "_part", "shard", "slot", "_k", "_p", "_home", "_range")
    keyed = with_parts(docs, part).withColumns({key: F.xxhash64(group), weight: size})
    keyed = keyed.withColumn(cell, F.shiftrightunsigned(key, 48).cast("int"))

    groups = cut(keyed.groupBy(key, cell).agg(F.sum(weight).alias("total")))
    everything = groups.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("all")).first()["all"]
    cap = int((1 + slack) * everything / shards) + 1
    least = max(1, int(slack * everything / (4 * shards)))
    large = sorted(((r["total"], r[key]) for r in groups.where(F.col("total") > least).collect()), key=lambda r: (-r[0], r[1]))
    cells = sorted((r[cell], r["total"]) for r in groups.where(F.col("total") <= least).groupBy(cell).agg(F.sum("total").alias("total")).collect())

    ring, free = Ring(shards), np.full(shards, cap, np.int64)
    split = [k for total, k in large if total > cap]
    whole = [(k, total) for total, k in large if total <= cap]
    pieces: list[tuple[int, int, int]] = []
    if split:
        parts = keyed.where(F.col(key).isin(split)).groupBy(key, part).agg(F.sum(weight).alias("total"))
        pieces = sorted((r[key], r[part], r["total"]) for r in parts.collect())
    at = lambda k: k % (1 << 64)
    piece_shards = place([(at(k), total) for k, _, total in pieces], ring, free)
    whole_shards = place([(at(k), total) for k, total in whole], ring, free)
    cell_shards = place([(c << 48, total) for c, total in cells], ring, free)

    session = docs.sparkSession
    homes = [(k, -1, s) for (k, _), s in zip(whole, whole_shards, strict=True)] + [(k, p, s) for (k, p, _), s in zip(pieces, piece_shards, strict=True)]
    by_group = session.createDataFrame(homes, f"`{own_key}` long, `{own_part}` int, `{home}` int")
    by_cell = [0] * CELLS
    for (c, _), s in zip(cells, cell_shards, strict=True):
        by_cell[c] = s
    by_range = session.createDataFrame(list(enumerate(by_cell)), f"`{cell}` int, `{own_range}` int")
    same_part = (F.col(own_part) == -1) | (F.col(own_part) == F.col(part))
    placed = keyed.join(F.broadcast(by_group), (F.col(key) == F.col(own_key)) & same_part, "left")
    placed = placed.join(F.broadcast(by_range), cell).withColumn(shard, F.coalesce(home, own_range)).drop(home, own_key, own_part, own_range)
    return number(placed, shard, part, slot).select(*docs.columns, shard, slot)


def _row_hash(df: DataFrame) -> Column:
    """A hash of all of a row's values that can be written as text; the same wherever the row is read."""
    plain = [F.col(f"`{f.name}`").cast("string") for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    return F.xxhash64(*plain, F.lit("part"))


def with_parts(df: DataFrame, name: str) -> DataFrame:
    """Adds one of PARTS (int) by the row's own hash; rows that are equal through and through and many are dealt to all parts.

    Many: more than a 65,536th of all rows and than 1,024, so at most 65,536
    hashes are sent round. Those rows are counted (combined before the
    shuffle) and made again from one row and their count, each with a number
    that its part depends on: the same parts in every run, whichever task is
    lost. Rows with a VARIANT or a map cannot be counted and keep their hash's part.
    """
    hashed, count, sample, block, at = columns_free_of(df, "_hash", "_count", "_sample", "_block", "_at")
    part = lambda c: F.pmod(c, F.lit(PARTS)).cast("int")
    keyed = df.withColumn(hashed, _row_hash(df))
    if any(isinstance(f.dataType, (MapType, VariantType)) for f in df.schema.fields):
        return keyed.withColumn(name, part(F.col(hashed))).drop(hashed)
    counts = keyed.groupBy(hashed).agg(F.count(F.lit(1)).alias(count))
    least = max(1_024, df.count() >> 16)
    many = [r[hashed] for r in counts.where(F.col(count) > least).collect()]
    alone = keyed.withColumn(name, part(F.col(hashed)))
    if not many:
        return alone.drop(hashed)
    hot = F.broadcast(df.sparkSession.createDataFrame([(h,) for h in many], f"`{hashed}` long"))
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    counted = keyed.join(hot, hashed, "left_semi").groupBy(hashed, *[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias(count), F.first(whole).alias(sample)).select(hashed, count, sample)
    # Blocks of a thousand, dealt out before their rows are made.
    blocks = counted.select(hashed, count, sample, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / 1_000))).alias(block))
    blocks = blocks.repartition(F.xxhash64(hashed, block))
    last = F.least(F.col(block) * 1_000 + 999, F.col(count) - 1)
    made = blocks.select(hashed, sample, F.explode(F.sequence(F.col(block) * 1_000, last)).alias(at))
    again = made.select(*[F.col(sample)[c].alias(c) for c in df.columns], part(F.xxhash64(hashed, at)).alias(name))
    return alone.join(hot, hashed, "left_anti").drop(hashed).unionByName(again)


def number(df: DataFrame, group: str, part: str, name: str) -> DataFrame:
    """Numbers the rows of each group from 0 without a gap; part splits a group evenly, so no task takes a whole one.

    Within a part the order is that of doc_id and piece, where there are such,
    then of a hash of the row, so only rows that are equal change places when
    a task is run again.
    """
    n, start, row, own_group, own_part = columns_free_of(df, "_n", "_start", "_row", "_group", "_of")
    counts = df.groupBy(group, part).agg(F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(F.col(group).alias(own_group), F.col(part).alias(own_part), F.coalesce(before, F.lit(0)).alias(start))
    within = F.row_number().over(W.partitionBy(group, part).orderBy(*[c for c in ("doc_id", "piece") if c in df.columns], _row_hash(df)))
    numbered = df.withColumn(row, within.cast("long")).join(starts, (F.col(group) == F.col(own_group)) & (F.col(part) == F.col(own_part)))
    return numbered.withColumn(name, F.col(start) + F.col(row) - 1).drop(start, row, own_group, own_part)
