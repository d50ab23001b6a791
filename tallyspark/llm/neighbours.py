"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, results merged."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyspark.llm._common import cut

#: Links of a node on the upper layers; the ground layer has twice as many.
LINKS = 16
#: Distinct vectors of a shard: at least and at most; in between SHARD_ROOT times the root of their number.
SHARD_ROWS, SHARD_MOST, SHARD_ROOT = 4096, 65_536, 16
#: Queries of a block, on average.
BLOCK_ROWS = 4096
#: Sub-groups in which the ids of one vector are first ranked.
SALT = 32
_INDEX = "dim int, shard int, vectors binary, members binary, held binary, links binary, layers binary, tops binary, entry int"


class Graph:
    """Unit vectors and flat neighbour arrays: links[layer][node] holds node numbers, -1 where free."""

    def __init__(self, unit: np.ndarray, layers: np.ndarray | None = None, links: list[np.ndarray] | None = None, entry: int = -1):
        self.unit, self.entry = unit, entry
        self.seen, self.stamp = np.zeros(len(unit), np.int64), 0
        self.layers, self.links = layers, links

    @classmethod
    def build(cls, unit: np.ndarray, width: int = 80, seed: int = 7) -> Graph:
        n = len(unit)
        levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(LINKS)).astype(np.int32), 8)
        links = [np.full((n, LINKS * (2 if level == 0 else 1)), -1, np.int32) for level in range(int(levels.max(initial=0)) + 1)]
        graph = cls(unit, levels, links)
        for node in range(n):
            graph._insert(node, width)
        return graph

    def _insert(self, node: int, width: int) -> None:
        level, q = int(self.layers[node]), self.unit[node]
        if self.entry < 0:
            self.entry = node
            return
        at, top = self.entry, int(self.layers[self.entry])
        for layer in range(top, level, -1):
            at = self._greedy(q, at, layer)
        near = [at]
        for layer in range(min(top, level), -1, -1):
            found = self._search(q, near, layer, width)
            near = [i for _, i in found]
            row = self.links[layer]
            chosen = self._diverse(found, LINKS)
            row[node, : len(chosen)] = chosen
            for other in chosen:
                mine = row[other]
                free = int((mine >= 0).sum())
                if free < len(mine):
                    mine[free] = node
                else:
                    options = np.append(mine, np.int32(node))
                    scores = self.unit[options] @ self.unit[other]
                    mine[:] = options[np.argpartition(-scores, len(mine) - 1)[: len(mine)]]
        if level > top:
            self.entry = node

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Nearest first, those that are nearer to the node than to any chosen one; then the nearest of the rest."""
        ids = np.array([i for _, i in found])
        between = self.unit[ids] @ self.unit[ids].T
        chosen: list[int] = []
        for k, (score, _) in enumerate(found):
            if not chosen or between[k, chosen].max() < score:
                chosen.append(k)
                if len(chosen) == most:
                    break
        if len(chosen) < most:
            left = set(range(len(found))) - set(chosen)
            chosen += sorted(left)[: most - len(chosen)]
        return ids[chosen].tolist()

    def _greedy(self, q: np.ndarray, at: int, layer: int) -> int:
        best = float(self.unit[at] @ q)
        while True:
            near = self.links[layer][at]
            near = near[near >= 0]
            if not len(near):
                return at
            scores = self.unit[near] @ q
            k = int(scores.argmax())
            if scores[k] <= best:
                return at
            at, best = int(near[k]), float(scores[k])

    def _search(self, q: np.ndarray, starts: list[int], layer: int, width: int) -> list[tuple[float, int]]:
        """The width nearest that a best-first walk finds, nearest first."""
        self.stamp += 1
        seen, links, unit = self.seen, self.links[layer], self.unit
        seen[starts] = self.stamp
        found = [(float(s), int(i)) for s, i in zip(unit[starts] @ q, starts, strict=True)]
        ahead = [(-s, i) for s, i in found]
        heapq.heapify(ahead)
        heapq.heapify(found)
        while len(found) > width:
            heapq.heappop(found)
        while ahead:
            s, at = heapq.heappop(ahead)
            if len(found) >= width and -s < found[0][0]:
                break
            near = links[at]
            near = near[near >= 0]
            near = near[seen[near] != self.stamp]
            if not len(near):
                continue
            seen[near] = self.stamp
            scores = unit[near] @ q
            if len(found) >= width:
                better = scores > found[0][0]
                near, scores = near[better], scores[better]
            for i, score in zip(near.tolist(), scores.tolist(), strict=True):
                if len(found) < width:
                    heapq.heappush(found, (score, i))
                    heapq.heappush(ahead, (-score, i))
                elif score > found[0][0]:
                    heapq.heapreplace(found, (score, i))
                    heapq.heappush(ahead, (-score, i))
        return sorted(found, reverse=True)

    def nearest(self, q: np.ndarray, width: int) -> list[int]:
        if self.entry < 0:
            return []
        at = self.entry
        for layer in range(int(self.layers[at]), 0, -1):
            at = self._greedy(q, at, layer)
        return [i for _, i in self._search(q, [at], 0, width)]


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by their largest component first, so no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _build(rows: pd.DataFrame, keep: int) -> pd.DataFrame:
    rows = rows.sort_values(["h1", "h2"])
    vectors = np.array(rows["embedding"].tolist(), np.float64)
    graph = Graph.build(_unit(vectors).astype(np.float32))
    members, held = np.zeros((len(rows), keep), np.int64), np.zeros(len(rows), np.int64)
    for i, ids in enumerate(rows["members"]):
        members[i, : len(ids)], held[i] = ids, len(ids)
    tops = np.array([x.shape[1] for x in graph.links], np.int32)
    links = b"".join(x.astype(np.int32).tobytes() for x in graph.links)
    flat = (vectors.tobytes(), members.tobytes(), held.tobytes(), links, graph.layers.astype(np.int32).tobytes(), tops.tobytes(), graph.entry)
    return pd.DataFrame([(int(rows["dim"].iloc[0]), int(rows["shard"].iloc[0]), *flat)], columns=[c.split()[0] for c in _INDEX.split(", ")])


def _load(row: pd.Series, keep: int) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    held = np.frombuffer(row["held"], np.int64)
    n = len(held)
    vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
    flat, links, at = np.frombuffer(row["links"], np.int32), [], 0
    for wide in np.frombuffer(row["tops"], np.int32):
        links.append(flat[at : at + n * wide].reshape(n, wide))
        at += n * int(wide)
    graph = Graph(_unit(vectors).astype(np.float32), np.frombuffer(row["layers"], np.int32), links, int(row["entry"]))
    return graph, vectors, np.frombuffer(row["members"], np.int64).reshape(n, keep), held


def _search(index: pd.DataFrame, queries: pd.DataFrame, k: int, width: int) -> pd.DataFrame:
    out: list[tuple[int, int, float]] = []
    if len(index) and len(queries):
        graph, vectors, members, held = _load(index.iloc[0], k + 1)
        units = _unit(vectors)
        for query, q in zip(queries["query_id"], _unit(np.array(queries["embedding"].tolist(), np.float64)), strict=True):
            found = np.array(graph.nearest(q.astype(np.float32), width))
            scores = units[found] @ q
            best = np.lexsort((members[found, 0], -scores))[: 2 * k + 2]
            for i, score in zip(found[best], scores[best], strict=True):
                out += [(query, v, score) for v in members[i, : held[i]].tolist() if v != query]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def shards_for(n: int) -> int:
    """How many shards n distinct vectors make. Every query goes to every shard, so shards grow with n, as far as a task can build them."""
    rows = min(SHARD_MOST, max(SHARD_ROWS, SHARD_ROOT * math.isqrt(n)))
    return max(1, -(-n // rows))


def usable(embedding: Column) -> Column:
    """Not null, not empty, not all zero, and without null or non-finite components."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, width: int = 128) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query row, by cosine in double precision.

    vectors has vec_id and embedding (array of numbers). Rows whose vector is
    null, empty, zero or holds null or non-finite components take no part, nor
    do rows without an id; a query meets only vectors of its dimension. A
    query's own id is never its neighbour; ties go to the smaller vec_id;
    rows that repeat id and vector count once; no rows give no rows.

    Equal vectors are one node that carries its k + 1 smallest ids (all that
    can be among k answers besides the query's own), ranked in salted
    sub-groups first. Nodes are dealt by hash into shards of 4,096 to 65,536
    (see shards_for); each task builds one shard's graph and stores it as flat arrays, which are
    checkpointed. Query blocks of about 4096 then meet every shard, and the
    shards' best are ranked together. Scores are worked out from the original
    vectors; a walk keeps `width` candidates.
    """
    wide = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", wide.alias("embedding"), is_query.alias("is_query")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash(F.lit("second"), "embedding"), "dim": F.size("embedding"), "salt": F.pmod(F.xxhash64("vec_id"), F.lit(SALT))})
    ids = rows.dropDuplicates(["vec_id", "h1", "h2"])
    few = ids.withColumn("at", F.row_number().over(W.partitionBy("h1", "h2", "salt").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    few = few.withColumn("at", F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    nodes = cut(few.groupBy("h1", "h2", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("members"), F.first("embedding").alias("embedding")))
    shards = shards_for(nodes.count())
    dealt = nodes.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).repartition(4 * shards, "dim", "shard")
    index = cut(dealt.groupBy("dim", "shard").applyInPandas(lambda part: _build(part, k + 1), _INDEX))

    asked = cut(ids.where("is_query").select(F.col("vec_id").alias("query_id"), "embedding", "dim"))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    tasks = min(4 * shards * blocks, 20_000)
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(tasks, "dim", "shard", "block")
    right = asked.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(tasks, "dim", "shard", "block")
    keys = ["dim", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: _search(a, b, k, width), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
