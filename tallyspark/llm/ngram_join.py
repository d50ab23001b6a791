"""Exact set-similarity join of documents on word n-grams, with set-relation skipping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm._common import NON_SPACE, Table, drop_tables, shingle_hashes, small, steps, word_hashes, word_spans, write_table
from tallyspark.llm._graph import linked_components

#: Frequent shingles whose order the workers know; others count as rare. A bound on a broadcast, not on the search: any order gives all links.
FREQUENT = 500_000
#: Most documents asked for that are broadcast (some 60 bytes each); beyond it they are joined.
WANTED = 400_000
#: Shingles of one map task that are counted at a time.
COUNTED = 1 << 21
#: Blocks of sizes that one index list holds.
SPAN = 4
#: Most keys (8 bytes each) that are broadcast when the index is thinned to lists of two sets or more; beyond it they are joined.
SHARED = 2_000_000
#: Sets that are compared with one centre in one group of rows; a larger group is split.
GROUP = 500
#: Bits of a set's narrow parity map, which goes with its entries of the index.
BITS = 256
#: Bytes of sets that a worker hands on at a time, or one set.
HANDED_ON = 1 << 22


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    for lo, hi, data, offsets in steps(texts):
        starts, ends, first = word_spans(data, offsets, NON_SPACE)
        words = word_hashes(data, starts, ends)
        for i in range(hi - lo):
            yield np.unique(shingle_hashes(words[first[i] : first[i + 1]], n))


def parity_map(tokens: np.ndarray, least: int = BITS) -> np.ndarray:
    """Which cells hold an odd number of shingles, one bit a cell: a power of two of them, `least` and as many as shingles at least.

    A cell is a shingle's low bits, so halves of a map laid over each other (xor) are the map of half as many cells.
    """
    cells = max(least, 1 << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def digest_of(shingles: bytes) -> bytes:
    return hashlib.blake2b(shingles, digest_size=16).digest()


def overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The least intersection with which sets of these sizes link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def _count(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def flush():
        tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["token", "held"])

    size = 0
    for batch in batches:
        for tokens in shingle_sets(batch["text"], n):
            held.append(tokens)
            size += len(tokens)
            if size > COUNTED:
                yield flush()
                held, size = [], 0
    yield flush()


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their counts as far as the tasks saw them twice."""
    counted = docs.select("text").mapInArrow(partial(_count, n=n), "token long, held long")
    level = F.floor(F.log2("held") * 8).cast("int").alias("level")
    summed = write_table(counted.groupBy("token").agg(F.sum("held").alias("held")).where("held > 9").withColumn("level", level))
    least, total = 0, 0
    for r in sorted(summed.rows.groupBy("level").count().collect(), reverse=True):
        total += r["count"]
        if total > FREQUENT:
            break
        least = r["level"]
    top = summed.rows.where(F.col("level") >= least).limit(FREQUENT).toArrow()
    drop_tables(summed)
    tokens, held = top["token"].to_numpy().view(np.uint64), top["held"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], held[order]


def _profile(batches: Iterator[pa.RecordBatch], frequent, n: int, percent: int) -> Iterator[pa.RecordBatch]:
    common, held = frequent.value
    for batch in batches:
        sizes, digests, prefixes, bits, maps = [], [], [], [], []
        for tokens in shingle_sets(batch["text"], n):
            size = len(tokens)
            sizes.append(size)
            digests.append(digest_of(tokens.tobytes()) if size else None)
            at = np.minimum(np.searchsorted(common, tokens), max(0, len(common) - 1))
            often = np.where(common[at] == tokens, held[at], 0) if len(common) else np.zeros(size, np.int64)
            # Rarest first; within one count the order of the hash, the same everywhere.
            first = size - int(overlap(size, -(-percent * size // 100), percent)) + 1 if size else 0
            ranked = tokens[np.lexsort((tokens, often))[:first]]
            prefixes.append(ranked.view(np.int64))
            odd = np.bincount((tokens >> np.uint64(56)).astype(np.int64), minlength=BITS) & 1
            bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            maps.append(parity_map(tokens))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["version"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), *(pa.array(x, pa.list_(pa.int64())) for x in (bits, maps))], ["doc_id", "version", "n_shingles", "digest", "prefix", "bits", "map"])


def _asked_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The set of each text once for each comparison that asks for it, in batches of about HANDED_ON bytes."""
    asks: list[pa.Array] = []
    sets: list[bytes] = []
    size = 0

    def flush():
        return pa.RecordBatch.from_arrays([*pa.concat_arrays(asks).flatten(), pa.array(sets, pa.binary())], ["centre", "part", "node", "shingles"])

    for batch in batches:
        for i, tokens in enumerate(shingle_sets(batch["text"], n)):
            asked, held = batch["asks"][i].values, tokens.tobytes()
            few = max(1, HANDED_ON // max(1, len(held)))
            for lo in range(0, len(asked), few):
                part = asked.slice(lo, few)
                asks.append(part)
                sets += [held] * len(part)
                size += len(held) * len(part)
                if size >= HANDED_ON:
                    yield flush()
                    asks, sets, size = [], [], 0
    if asks:
        yield flush()


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of the sets that link with the centre of their group, which comes first in it and has no node."""
    now, b = None, np.zeros(0, np.uint64)
    for batch in batches:
        found = []
        for group, node, held in zip(zip(batch["centre"].to_pylist(), batch["part"].to_pylist(), strict=True), batch["node"].to_pylist(), batch["shingles"], strict=True):
            a = np.frombuffer(held.as_py(), np.uint64)
            if node is None:
                now, b = group, a
            elif group == now and int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) >= overlap(len(a), len(b), percent):
                found.append((node, group[0]))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _screened(pairs: Table, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose whole parity maps leave room for the overlap; only the maps of sets in pairs are shuffled."""
    wanted = pairs.rows.select(F.col("a").alias("node")).union(pairs.rows.select("b")).distinct()
    maps = nodes.join(F.broadcast(wanted) if 2 * pairs.count <= WANTED else wanted, "node", "left_semi")
    side = lambda c: maps.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("map").alias(f"map_{c}"))
    both = pairs.rows.join(side("a"), "a").join(side("b"), "b")
    cells = F.least(F.size("map_a"), F.size("map_b"))
    # The wider map is laid over itself until it has the other's cells.
    folded = lambda m, i: F.aggregate(F.sequence(F.lit(0), F.floor(F.size(m) / cells).cast("int") - 1), F.lit(0).cast("long"), lambda x, k: x.bitwiseXOR(F.get(m, i + k * cells)))
    apart = F.aggregate(F.sequence(F.lit(0), cells - 1), F.lit(0), lambda n, i: n + F.bit_count(folded("map_a", i).bitwiseXOR(folded("map_b", i))))
    return both.where(_room("a", "b", percent) >= apart).select("a", "b")


def _compared(docs: DataFrame, nodes: DataFrame, pairs: Table, n: int, percent: int) -> DataFrame:
    """(a, b) of the pairs whose whole sets link.

    Sets meet in the group of b, in parts of about GROUP, sorted with b's own
    set first; each is read again from its document, so only those compared
    are shuffled.
    """
    parts = pairs.rows.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    members = pairs.rows.join(parts, "b").select(F.col("a").alias("asked"), F.struct(F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.col("a").alias("node")).alias("ask"))
    centres = parts.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.col("b").alias("asked"), F.struct(F.col("b").alias("centre"), "part", F.lit(None).cast("long").alias("node")).alias("ask"))
    asked = members.union(centres).groupBy("asked").agg(F.collect_list("ask").alias("asks"))
    asked = asked.join(nodes.select("node", "rep"), F.col("asked") == F.col("node")).select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.version").alias("version"), "asks")
    if 2 * pairs.count <= WANTED:
        asked = F.broadcast(asked)
    same = docs["doc_id"].eqNullSafe(asked["doc_id"]) & (docs["version"] == asked["version"])
    sets = docs.join(asked, same).select("text", "asks").mapInArrow(partial(_asked_sets, n=n), "centre long, part int, node long, shingles binary")
    groups = sets.repartition("centre", "part").sortWithinPartitions("centre", "part", F.asc_nulls_first("node"))
    return groups.mapInArrow(partial(_linked, percent=percent), "a long, b long")


def similar_sets(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, set_digest) for every row: the components of the exact Jaccard join.

    A text's set is its distinct n-word shingles (the whole sequence if it has
    fewer words; words are runs of non-space, A-Z lower-cased), as 64-bit
    hashes. Two rows link when 100 |x & y| >= percent |x | y|. component_id is
    the smallest doc_id of the component. Null and wordless texts have no set,
    link with nothing and keep their own doc_id; repeated rows and equal texts
    are one set; a null doc_id takes part but is never the smallest; other
    columns are not read; an empty table gives no rows.

    Relations between sets save the work. Equal sets are one node, so copies
    are never paired. The index lists a set under the prefix of its rarest
    shingles, in lists by span of sizes and blocks within them; a block is
    skipped unless its sizes can link, and within it the position of the shared shingle bounds the overlap
    still possible. Then answers are derived: once a set is linked to the
    centre of a list, what that component answers holds for it too, and only
    pairs across components are looked at (see linked_components). Parity
    bitmaps, an upper bound of the overlap, screen pairs before the whole sets
    are compared, with all 64 bits of their hashes. No link is lost by any of
    these, whatever the length of a text.
    """
    session = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))
    frequent = session.sparkContext.broadcast(frequent_shingles(docs, n))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, version long, n_shingles long, digest binary, prefix array<long>, bits array<long>, map array<long>"
    rows = write_table(docs.mapInArrow(lambda it: _profile(it, frequent, n, percent), kinds))
    frequent.unpersist()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("rep")
    nodes = write_table(rows.rows.where("digest is not null").groupBy("digest").agg(first, F.first("n_shingles").alias("size"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"), F.first("map").alias("map")).withColumn("node", F.monotonically_increasing_id()))
    # A block spans a factor of 100 / percent in size, so what links is of one block or of neighbouring ones. The index
    # has a list for each shingle and SPAN blocks; sets of a span's first block stand in the span below too.
    size_block = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    listed = nodes.rows.select(F.posexplode("prefix").alias("position", "shingle"), "node", F.col("size").cast("int").alias("size"), size_block.alias("block"))
    spans = F.array_distinct(F.array(F.floor(F.col("block") / SPAN), F.floor((F.col("block") - 1) / SPAN)))
    listed = listed.withColumn("span", F.explode(spans)).select(F.xxhash64("shingle", "span").alias("key"), "block", "node", "size", "position")
    shared = write_table(listed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("key"))
    entries = write_table(listed.join(small(shared, SHARED), "key"))
    words = [F.get("bits", F.lit(i)).alias(f"bits{i}") for i in range(BITS // 64)]
    traits = nodes.rows.select("node", *words)

    def near(left: DataFrame, right: DataFrame, once: bool) -> DataFrame:
        cols = ["node", "size", "position", "component", "block", *traits.columns[1:]]
        x, y = (df.select("key", *[F.col(c).alias(f"{c}_{s}") for c in cols]) for df, s in ((left, "x"), (right, "y")))
        can = _possible("size_x", "size_y", "position_x", "position_y", percent) & _maps_allow("x", "y", percent) & (F.col("component_x") != F.col("component_y"))
        near_blocks = F.abs(F.col("block_x") - F.col("block_y")) <= 1
        return x.join(y, (x["key"] == y["key"]) & near_blocks & can).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))

    def screen(pairs: DataFrame) -> DataFrame:
        side = lambda c: nodes.rows.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), *[w.alias(f"bits{i}_{c}") for i, w in enumerate(words)])
        return pairs.join(side("a"), "a").join(side("b"), "b").where(_maps_allow("a", "b", percent)).select("a", "b")

    def verify(pairs: Table) -> Table:
        left = write_table(_screened(pairs, nodes.rows, percent))
        links = write_table(_compared(docs, nodes.rows, left, n, percent))
        drop_tables(left)
        return links

    joined = linked_components(entries, traits, screen, near, verify)
    drop_tables(shared, entries)
    placed = nodes.rows.select("node", "digest", F.col("rep.doc_id").alias("rep")).join(joined.rows.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    classes = placed.join(smallest, "component").select("digest", "component_id")
    rows = rows.rows.select("doc_id", "n_shingles", "digest")
    out = rows.where("digest is not null").join(classes, "digest").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.col("digest").alias("set_digest"))
    return out.unionByName(rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("digest").alias("set_digest")))


def _need(x: str, y: str, percent: int) -> Column:
    return F.ceil(percent * (F.col(x) + F.col(y)) / (100.0 + percent) - 1e-6)


def _maps_allow(x: str, y: str, percent: int) -> Column:
    """Whether parity maps leave room for the overlap: a bit that differs is at least one shingle that does."""
    apart = sum((F.bit_count(F.col(f"bits{i}_{x}").bitwiseXOR(F.col(f"bits{i}_{y}"))) for i in range(BITS // 64)), F.lit(0))
    return _room(x, y, percent) >= apart


def _room(x: str, y: str, percent: int) -> Column:
    """How many shingles may be in one of two sets that link and not in the other."""
    return F.col(f"size_{x}") + F.col(f"size_{y}") - 2 * _need(f"size_{x}", f"size_{y}", percent)


def _possible(n_x: str, n_y: str, i: str, j: str, percent: int) -> Column:
    """Whether sets that first meet at these positions can still share enough."""
    return F.least(F.col(n_x) - F.col(i), F.col(n_y) - F.col(j)) >= _need(n_x, n_y, percent)
