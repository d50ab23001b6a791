"""Best-fit decreasing packing of token pieces into sequences."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm._common import cut
from tallyspark.llm.sharding import number, with_parts

_END = 0


@cache
def _encoder(vocabulary: str):
    """The byte-level BPE of a `tokenizers` file as a tiktoken encoding: the same pieces, ranks and ids at a fifth of the time."""
    import json

    import tiktoken

    with open(vocabulary) as f:
        spec = json.load(f)
    points = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in points]
    letters = {chr(b): b for b in points} | {chr(256 + i): b for i, b in enumerate(spare)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def encode(text: str | None, vocabulary: str) -> np.ndarray:
    """Token ids of a text followed by the end id; a null text is empty."""
    return np.array([*_encoder(vocabulary).encode(text or "", allowed_special="all"), _END], "<u4")


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, room: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            ids = encode(text.as_py(), vocabulary)
            for n, (lo, hi) in enumerate(spans(len(ids), room)):
                part = ids[lo:hi]
                for name, value in zip(rows, (doc, n, lo, hi - lo, zlib.crc32(part.tobytes()), part.astype("<i4")), strict=False):
                    rows[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=False)], list(rows))


def spans(n: int, room: int) -> list[tuple[int, int]]:
    """Cuts n tokens into pieces of room, the first of which may be shorter."""
    first = n % room or min(n, room)
    return [(0, first), *((lo, lo + room) for lo in range(first, n, room))] if n else []


class Capacities:
    """A segment tree over remaining capacities: which have open bins, and the tightest that fits."""

    def __init__(self, room: int):
        self.leaves = 1 << room.bit_length()
        self.open = np.zeros(2 * self.leaves, bool)
        self.bins: list[deque[tuple[int, int]]] = [deque() for _ in range(room + 1)]

    def put(self, capacity: int, first: int, last: int) -> None:
        """Opens bins first to last (not included) with this capacity left."""
        self.bins[capacity].append((first, last))
        at = capacity + self.leaves
        while at and not self.open[at]:
            self.open[at] = True
            at //= 2

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """Removes up to most bins of this capacity, of one range."""
        first, last = self.bins[capacity].popleft()
        if last - first > most:
            self.bins[capacity].appendleft((first + most, last))
            last = first + most
        if not self.bins[capacity]:
            at = capacity + self.leaves
            self.open[at] = False
            while at > 1:
                at //= 2
                self.open[at] = self.open[2 * at] or self.open[2 * at + 1]
        return first, last

    def tightest(self, size: int) -> int | None:
        """The smallest capacity of at least size with an open bin."""
        at = size + self.leaves
        if self.open[at]:
            return size
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def plan(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for so many pieces of each length: (length, from, to, bin, per bin, offset).

    Pieces numbered from `from` to `to` of a length fill bins `bin`, `bin` + 1,
    ... with `per bin` of them each, the first at `offset`. Best fit puts equal
    pieces into the tightest bin until no more fit there, so equal bins are
    treated together and the plan's size depends on the lengths, not on how
    many pieces there are.
    """
    tree, out, bins = Capacities(room), [], 0
    for size in sorted(counts, reverse=True):
        done, total = 0, counts[size]
        while done < total:
            capacity = tree.tightest(size)
            if capacity is None:
                capacity, per = room, room // size
                fresh = -(-(total - done) // per)
                tree.put(room, bins, bins + fresh)
                bins += fresh
            per = capacity // size
            left = total - done
            if left < per:
                first, last, per = *tree.take(capacity, 1), left
            else:
                first, last = tree.take(capacity, left // per)
            end = done + (last - first) * per
            out.append((size, done, end, first, per, room - capacity))
            tree.put(capacity - per * size, first, last)
            done = end
    return out


def best_fit_packing(docs: DataFrame, vocabulary: str, room: int = 2048, with_ids: bool = False) -> DataFrame:
    """Packs every document's tokens into sequences of at most room tokens, best fit decreasing over the whole table.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and ids if asked for). Only documents over room
    tokens are cut. Null and empty texts are the end id alone; repeated rows
    are packed each; an empty table gives no rows; other columns are not read.

    Texts are encoded once, in parallel. The only thing that reaches the
    driver is the count of pieces of each length (room rows at most), from
    which a plan of bounded size is made: it names the bins by the pieces'
    numbers within their length, and a broadcast of it places every piece.
    """
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    cut_up = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = cut(cut_up.mapInArrow(partial(_pieces, vocabulary=vocabulary, room=room, with_ids=with_ids), kinds))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    moves = docs.sparkSession.createDataFrame(plan(counts, room), "length long, _from long, _to long, _bin long, _per long, _base long")
    numbered = number(with_parts(pieces, "_part"), "length", "_part", "_number").drop("_part")
    at = F.col("_number") - F.col("_from")
    placed = numbered.join(F.broadcast(moves), (numbered["length"] == moves["length"]) & (F.col("_number") >= F.col("_from")) & (F.col("_number") < F.col("_to"))).drop(moves["length"])
    placed = placed.withColumn("sequence_id", F.col("_bin") + F.floor(at / F.col("_per"))).withColumn("offset", F.col("_base") + at % F.col("_per") * F.col("length"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
