"""Hard-negative mining: exact inner-product searches over R-trees packed by sort-tile-recurse.

Vectors are dealt by ranges of label and of their most varying coordinate; a
task packs its own into trees whose boxes bound the label and every
coordinate. A box and an anchor give an interval of inner products, so a
best-first queue opens only boxes that can hold an answer.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm._common import Table, small, write_table

#: Entries of a leaf (one product with an anchor each), and nodes below a node.
LEAF, FANOUT = 256, 8
#: Entries of a tree at least, at most, and per root of their number: anchors meet every tree, so trees grow with the root.
TREE_ROWS, TREE_MOST, TREE_ROOT = 16_384, 131_072, 16
#: Anchors that one search handles.
BLOCK_ROWS = 512
#: Doubles hold every integer up to this; beyond it, products are Python integers.
EXACT = 1 << 53
_LONG = (1 << 63) - 1
#: Trees whose ids are told to all tasks; more of them are joined by a shuffle.
TOLD = 200_000

_TREE = "tree long, dim int, labels array<long>, wide boolean, vectors binary, label binary, members binary, held binary, lows binary, highs binary, first binary, last binary, leaves int"


def pack(vectors: np.ndarray, labels: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Sort-tile-recurse: an order of the rows, (lows, highs, first, last) of all nodes, leaves first and the root last, and how many leaves.

    Labels are the first coordinate of the tiles and the last of the boxes. A
    leaf's first and last are rows in that order, those of other nodes are
    nodes.
    """
    points = np.column_stack([vectors, labels])
    slabs_of_label = len(np.unique(labels))
    spread = np.argsort(-vectors.astype(np.float64).var(0), kind="stable")
    axes = [points.shape[1] - 1, *spread[: max(1, math.ceil(math.log2(max(2, len(points) / leaf / slabs_of_label))))]]

    def tile(rows: np.ndarray, depth: int) -> list[np.ndarray]:
        pages = math.ceil(len(rows) / leaf)
        rows = rows[np.argsort(points[rows, axes[min(depth, len(axes) - 1)]], kind="stable")]
        if pages <= 1 or depth == len(axes):
            return [rows[i : i + leaf] for i in range(0, len(rows), leaf)]
        slabs = min(pages, slabs_of_label) if depth == 0 else max(2, math.ceil(pages ** (1 / (len(axes) - depth))))
        step = leaf * math.ceil(pages / slabs)
        return [t for i in range(0, len(rows), step) for t in tile(rows[i : i + step], depth + 1)]

    tiles = tile(np.arange(len(points)), 0)
    order = np.concatenate(tiles)
    ends = np.cumsum([len(t) for t in tiles])
    firsts = ends - [len(t) for t in tiles]
    lows, highs = np.minimum.reduceat(points[order], firsts), np.maximum.reduceat(points[order], firsts)
    first, last, at = [firsts], [ends], 0
    all_lows, all_highs, level = [lows], [highs], len(tiles)
    while level > 1:
        starts = np.arange(0, level, fanout)
        first.append(at + starts)
        last.append(at + np.minimum(starts + fanout, level))
        lows, highs = np.minimum.reduceat(lows, starts), np.maximum.reduceat(highs, starts)
        all_lows.append(lows)
        all_highs.append(highs)
        at, level = at + level, len(starts)
    return order, [np.concatenate(x) for x in (all_lows, all_highs, first, last)], len(tiles)


def _build(parts: Iterator[pd.DataFrame], keep: int, most: int) -> Iterator[pd.DataFrame]:
    """The rows of a task, a range of labels and of one coordinate, as one tree for each dimension and `most` rows."""
    rows = pd.concat([pd.DataFrame(columns=["dim", "label", "h1", "h2", "members", "vector"]), *parts]).sort_values(["dim", "label", "h1", "h2"])
    made = TaskContext.get().partitionId() << 32
    for dim, of_dim in rows.groupby("dim"):
        for i in range(0, len(of_dim), most):
            some = of_dim.iloc[i : i + most]
            vectors, labels = np.array(some["vector"].tolist(), np.int64), some["label"].to_numpy(np.int64)
            order, nodes, leaves = pack(vectors, labels)
            members, held = np.zeros((len(some), keep), np.int64), np.zeros(len(some), np.int64)
            for at, ids in enumerate(some["members"].iloc[order]):
                members[at, : len(ids)], held[at] = ids, len(ids)
            wide = bool(vectors.min() < -(1 << 15) or vectors.max() >= 1 << 15)
            flat = [x.astype(np.int64).tobytes() for x in (labels[order], members, held, *nodes)]
            packed = vectors[order].astype(np.int64 if wide else np.int16).tobytes()
            yield pd.DataFrame([(made, int(dim), sorted(set(labels.tolist())), wide, packed, *flat, leaves)], columns=[c.split()[0] for c in _TREE.split(", ")])
            made += 1


class Tree:
    """A packed tree as flat arrays."""

    def __init__(self, row: pd.Series, keep: int) -> None:
        dim = int(row["dim"])
        read = lambda name: np.frombuffer(row[name], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64 if row["wide"] else np.int16).reshape(-1, dim)
        lows, highs = (read(c).reshape(-1, dim + 1) for c in ("lows", "highs"))
        self.lows, self.highs, self.least_label, self.most_label = lows[:, :dim], highs[:, :dim], lows[:, dim], highs[:, dim]
        self.label, self.members, self.held = read("label"), read("members").reshape(-1, keep), read("held")
        self.first, self.last, self.leaves = read("first"), read("last"), int(row["leaves"])

    def exact_for(self, asked: np.ndarray) -> np.ndarray:
        """The anchors as doubles (and so for BLAS) where all sums are exact in them, as Python integers otherwise; the tree likewise."""
        size = lambda x: int(np.abs(x.astype(object)).max(initial=0))
        kind = np.float64 if max(size(self.lows[-1:]), size(self.highs[-1:])) * size(asked) * asked.shape[1] < EXACT else object
        self.vectors, self.lows, self.highs = (x.astype(kind) for x in (self.vectors, self.lows, self.highs))
        return asked.astype(kind)

    def bounds(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner products of each anchor with anything in each box."""
        up, down = np.maximum(asked, 0), np.minimum(asked, 0)
        return up @ self.lows.T + down @ self.highs.T, up @ self.highs.T + down @ self.lows.T

    def search(self, own: int, label: int, same: bool, q: np.ndarray, lows: np.ndarray, highs: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window of scores (both ends in it), its k best (score, -id) of the label (or of all others), ids other than own, best first.

        The queue opens the box with the largest bound first. Boxes outside
        the label or all windows are no part of it, and it ends where bounds
        are strictly below what every window still wants: at the bound itself
        an equal score with a smaller id may still come.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        floor, ceiling = min(w[0] for w in windows), max(w[1] for w in windows)
        fits = (self.least_label <= label) & (self.most_label >= label) if same else (self.least_label != label) | (self.most_label != label)
        fits &= (highs >= floor) & (lows <= ceiling)
        root = len(self.first) - 1
        queue = [(-highs[root], root)] if fits[root] else []
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor:
                break
            a, b = int(self.first[node]), int(self.last[node])
            if node >= self.leaves:
                for child in range(a, b):
                    if fits[child] and highs[child] >= floor:
                        heapq.heappush(queue, (-highs[child], child))
                continue
            scores = self.vectors[a:b] @ q
            hits = (scores >= floor) & (scores <= ceiling)
            if self.least_label[node] != self.most_label[node]:
                hits &= (self.label[a:b] == label) == same
            at = np.flatnonzero(hits)
            if not len(at):
                continue
            best = sorted(((-int(x), int(self.members[a + i, 0]), a + i) for i, x in zip(at.tolist(), scores[at].tolist(), strict=True))) if len(at) <= 64 or scores.dtype == object else self._sorted(a + at, scores[at])
            for f, (low, high) in zip(found, windows, strict=True):
                taken = 0
                for minus, _, i in best:
                    # Answers lie in the first k + 1 entries: each brings an id below all of any later one.
                    if -minus > high:
                        continue
                    if taken > k or -minus < low or (len(f) >= k and -minus < f[0][0]):
                        break
                    taken += 1
                    for v in self.members[i, : self.held[i]].tolist():
                        if v != own:
                            if len(f) < k:
                                heapq.heappush(f, (-minus, -v))
                            elif (-minus, -v) > f[0]:
                                heapq.heapreplace(f, (-minus, -v))
                            else:
                                break
            floor = min(max(low, f[0][0]) if len(f) >= k else low for f, (low, _) in zip(found, windows, strict=True))
        return [sorted(f, reverse=True) for f in found]

    def _sorted(self, rows: np.ndarray, scores: np.ndarray) -> list[tuple[int, int, int]]:
        order = np.lexsort((self.members[rows, 0], -scores))
        return list(zip((-scores[order]).astype(np.int64).tolist(), self.members[rows[order], 0].tolist(), rows[order].tolist(), strict=True))


def _search(index: pd.DataFrame, asked: pd.DataFrame, same: bool, k: int, keep: int) -> pd.DataFrame:
    out: list[tuple] = []
    if len(index) and len(asked):
        tree = Tree(index.iloc[0], keep)
        vectors = tree.exact_for(np.array(asked["vector"].tolist(), np.int64))
        lows, highs = tree.bounds(vectors)
        for i, (anchor, label, windows) in enumerate(zip(asked["anchor_id"].tolist(), asked["label"].tolist(), asked["windows"], strict=True)):
            spans = [(-math.inf if w["low"] is None else w["low"], math.inf if w["high"] is None else w["high"]) for w in windows]
            for at, best in enumerate(tree.search(anchor, label, same, vectors[i], lows[i], highs[i], spans, k)):
                out += [(anchor, at, -v, max(-_LONG, min(_LONG, s))) for s, v in best]
    return pd.DataFrame(out, columns=["anchor_id", "at", "vec_id", "score"])


def _meet(trees: Table, asked: DataFrame, rows: int, same: bool, k: int, keep: int) -> DataFrame:
    """Each block of the anchors (rows of them) meets each tree that holds its label, or another label, once; the k best of each window over all trees."""
    blocks = max(1, -(-rows // BLOCK_ROWS))
    known = trees.rows.select(F.col("tree").alias("in_tree"), F.col("dim").alias("of_dim"), "labels")
    if same:
        known, of = known.select("in_tree", "of_dim", F.explode("labels").alias("of_label")), F.col("label") == F.col("of_label")
    else:
        known, of = small(trees._replace(rows=known), TOLD), (F.size("labels") > 1) | (F.col("label") != F.get("labels", F.lit(0)))
    keys, tasks = ["tree", "block"], max(1, min(2 * trees.count * blocks, 20_000))
    left = trees.rows.drop("labels").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, *keys)
    right = asked.withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int")).join(known, (F.col("dim") == F.col("of_dim")) & of)
    right = right.select(F.col("in_tree").alias("tree"), "block", "anchor_id", "label", "vector", "windows").repartition(tasks, *keys)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _search(a, b, same, k, keep), "anchor_id long, at int, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "at").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def usable(embedding: Column) -> Column:
    """Neither null nor empty, and without null or non-finite components."""
    return F.coalesce((F.size(embedding) > 0) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def tree_rows(n: int) -> int:
    return min(TREE_MOST, max(TREE_ROWS, TREE_ROOT * math.isqrt(n)))


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, scale: int = 256, low_percent: int = 50, high_percent: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    vectors has vec_id, label and embedding (array of numbers). A component x
    becomes floor(scale * x) with x as double (beyond 64 bits, their ends); a
    score is the integer inner product. An anchor's positives are its best
    other rows of its label; a positive's negatives the best rows of other
    labels whose score is from low_percent to high_percent hundredths of the
    positive's. Equal scores go to the smaller vec_id.

    Rows with a null id, label or vector, an empty vector, or a null or
    non-finite component, take no part; rows meet only those of their
    dimension. Rows repeated whole count once; an id names one row. A row
    with an anchor's own id is never its answer. No anchors, or no answers,
    give no rows. Scores beyond 64 bits are returned as their ends.

    Equal vectors of a label are one entry with its smallest ids, all that
    can be answers besides the anchor's own, so copies cost nothing. Trees
    hold 16,384 to 131,072 entries (see tree_rows). Every block of about 500
    anchors meets each tree with its label once for positives and each tree
    with other labels once for negatives; within a tree, boxes prune.
    """
    keep = max(positives, negatives) + 1
    given = F.col("embedding").cast("array<double>")
    rows = vectors.where(usable(given) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.select("vec_id", F.col("label").cast("long").alias("label"), F.transform(given, lambda x: F.floor(x * scale)).alias("vector"), is_anchor.alias("anchor"))
    rows = rows.withColumns({"dim": F.size("vector"), "h1": F.xxhash64("vector"), "h2": F.hash(F.lit("second"), "vector")})
    # A rank with a bound is cut down in each task before the shuffle, so a vector of any number of copies is small there.
    entry = ["dim", "label", "h1", "h2"]
    few = rows.withColumn("at", F.dense_rank().over(W.partitionBy(*entry).orderBy("vec_id"))).where(F.col("at") <= keep)
    entries = write_table(few.groupBy(*entry).agg(F.array_sort(F.collect_set("vec_id")).alias("members"), F.first("vector").alias("vector")))

    most = tree_rows(entries.count)
    spread = entries.rows.select(F.posexplode("vector").alias("axis", "x")).groupBy("axis").agg(F.var_pop("x").alias("v")).agg(F.max_by("axis", "v").alias("axis"))
    axis = spread.first()["axis"] or 0
    dealt = entries.rows.repartitionByRange(max(1, -(-entries.count // most)), "dim", "label", F.get("vector", F.lit(axis)), "h1")
    trees = write_table(dealt.mapInPandas(lambda parts: _build(parts, keep, most), _TREE))

    asked = write_table(rows.where("anchor").select(F.col("vec_id").alias("anchor_id"), "label", "dim", "vector").distinct())
    span = "array<struct<low:long,high:long>>"
    everything = asked.rows.withColumn("windows", F.array(F.struct(F.lit(None).alias("low"), F.lit(None).alias("high"))).cast(span))
    near = _meet(trees, everything, asked.count, True, positives, keep)
    near = near.select("anchor_id", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    # low_percent * p <= 100 * n <= high_percent * p over integers; positives whose window holds none have no negatives.
    p = F.col("positive_score").cast("decimal(20,0)")
    bounds = {"low": F.ceil(p * low_percent / 100).cast("long"), "high": F.floor(p * high_percent / 100).cast("long")}
    near = write_table(near.withColumns(bounds).where("low <= high")).rows
    spans = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high", "positive_id", "positive_score"))).alias("spans"))
    windows = F.transform("spans", lambda s: F.struct(s["low"].alias("low"), s["high"].alias("high")))
    far = _meet(trees, asked.rows.join(spans.select("anchor_id", windows.alias("windows")), "anchor_id"), asked.count, False, negatives, keep)
    of = spans.select("anchor_id", F.posexplode("spans").alias("at", "s")).select("anchor_id", "at", "s.positive_id", "s.positive_score")
    return far.join(of, ["anchor_id", "at"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
