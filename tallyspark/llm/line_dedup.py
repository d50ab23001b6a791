"""Fuzzy line deduplication: MinHash keys and a SimHash screen over byte n-grams, edit similarity, one occurrence per connected group."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm._common import NON_SPACE, STEP_BYTES, Table, byte_class, columns_free_of, drop_tables, mix, power_tables, small, word_hashes, word_spans, write_table
from tallyspark.llm._graph import linked_components

#: SimHashes over the byte 8-grams that begin words may differ in so many of their 128 bits.
FLIPS = 42
#: A line has a key for each band, of so many least hashes of its byte 8-grams.
BANDS, LEAST = 12, 3
KEYS = [f"key{i}" for i in range(BANDS)]
#: Most bits of the table of words that is held for a bound; longer lines are compared without it, in memory of their length.
WORD_TABLE = 1 << 26
#: Normal forms of fewer bytes are compared exactly only.
FUZZY_CHARS = 20
#: Lines that are compared with one line in one group of rows; a larger group is split.
GROUP = 100
#: Lines of one key, no more of which are paired as rows; those of a larger one meet in blocks of about so many in a task.
CROWD, BLOCK = 64, 500
#: Fewer lines than MANY are compared with a line one by one, more of them at once in whole numbers of about so many bits.
MANY, BITS = 6, 1 << 18
#: Most rows of a relation of ids, keys or line numbers that is broadcast (8 to 60 bytes each); a larger one is joined.
WANTED = 500_000


def _normal_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = ord("0") if c.isdigit() else ord(c.lower()) if c.isalpha() else 10 if b == 10 else 32
    return out


_NORMAL = _normal_table()


def normal_lines(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The non-empty normal forms of all lines of all texts: text number, line number, bytes, starts, ends.

    A-Z become small, runs of digits one 0, runs of other ASCII one space,
    none at either end; other characters stay.
    """
    data = _NORMAL[np.frombuffer("\n".join(t or "" for t in texts).encode("utf-8", "surrogatepass"), np.uint8)]
    before = np.concatenate([[10], data[:-1]]) if len(data) else data
    data = data[~((data == 32) & ((before == 32) | (before == 10))) & ~((data == 48) & (before == 48))]
    ends = np.append(np.flatnonzero(data == 10), len(data))
    starts = np.append(0, ends[:-1] + 1)
    counts = np.array([(t or "").count("\n") + 1 for t in texts], np.int64)
    rows = np.repeat(np.arange(len(texts)), counts)
    numbers = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    filled = ends > starts
    trail = np.zeros(len(ends), np.int64)
    trail[filled] = data[ends[filled] - 1] == 32
    ends = ends - trail
    keep = ends > starts
    return rows[keep], numbers[keep], data, starts[keep], ends[keep]


def normalise(line: str) -> str:
    """The normal form of one line, empty if it has no letter or digit."""
    _, _, data, starts, ends = normal_lines([line.replace("\n", " ")])
    return data[starts[0] : ends[0]].tobytes().decode("utf-8", "replace") if len(starts) else ""


#: What may end a line without being part of its own form.
_TRAIL = byte_class([*b" .,;:!?", *range(9, 14)])


def own_lines(texts: list[str | None], rows: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The own forms of some lines, given by text and line number in order: bytes, starts, ends. Marks that end a line are blanked; case and runs of white space still stand."""
    data = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-8", "surrogatepass"), np.uint8)
    feeds = np.flatnonzero(data == 10)
    counts = np.array([(t or "").count("\n") + 1 for t in texts], np.int64)
    at = (np.cumsum(counts) - counts)[rows] + numbers
    starts, ends = np.append(0, feeds + 1)[at], np.append(feeds, len(data))[at]
    ends = np.maximum.accumulate(np.where(_TRAIL[data], 0, np.arange(len(data)) + 1))[ends - 1]
    edge = np.zeros(len(data) + 1, np.int8)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.where(np.cumsum(edge[:-1], dtype=np.int8) > 0, data, np.uint8(32)), starts, ends


def own_sizes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The characters of own forms."""
    inside = NON_SPACE[data]
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((inside & (data & 0xC0 != 0x80)).astype(np.int8) + (inside & ~np.append(False, inside[:-1])), out=sums[1:])
    return sums[ends] - sums[starts] - 1


def own_form(data: np.ndarray) -> str:
    """A line's own characters with A-Z small and runs of white space one space."""
    return b" ".join(data.tobytes().lower().split()).decode("utf-8", "replace")


def line_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each line's word sequence."""
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2
    base, last = int(starts[0]), int(ends[-1])
    part = data[base:last]
    offsets = np.append(starts - base, last - base)
    word_starts, word_ends, first = word_spans(part, offsets, NON_SPACE)
    words = word_hashes(part, word_starts, word_ends)
    up, down = power_tables(len(words) + 1)
    hashes = []
    for salt in (0, 0x5851F42D4C957F2D):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum((mix(words ^ np.uint64(salt)) if salt else words) * up[:-1], out=sums[1:])
        hashes.append(mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64)))
    return hashes[0], hashes[1]


def line_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The SimHash of each line's byte 8-grams that begin words, as two halves of 64 bits."""
    if not len(starts):
        return (np.zeros(0, np.uint64),) * 2
    before = np.append(np.uint8(10), data[:-1])
    at = np.flatnonzero(((before == 32) | (before == 10)) & (data != 32) & (data != 10))
    first, last = np.searchsorted(at, starts), np.searchsorted(at, ends)
    held = last - first
    votes = mix(_grams(data, 8)[at[np.repeat(first - (np.cumsum(held) - held), held) + np.arange(held.sum())]])
    more = mix(votes ^ np.uint64(0x5851F42D4C957F2D))
    return tuple(np.packbits(2 * _count_bits(v, held) > held[:, None], axis=1).view(np.uint64).ravel() for v in (votes, more))


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """At each place of the data the number that its next `size` (4 or 8) bytes make."""
    out, width = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64), 1
    while width < size:
        out = out[:-width] | (out[width:] << np.uint64(8 * width))
        width *= 2
    return out[: len(data)]


def _gram_places(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each line's n-grams begin, one at least, and how many each line has."""
    held = np.maximum(1, ends - starts - size + 1)
    return np.repeat(starts - (np.cumsum(held) - held), held) + np.arange(held.sum()), held


_SALTS = mix(np.arange(1, BANDS * LEAST + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)


def line_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of 32-bit keys per line, one for each band. Two lines share one with the chance 1 - (1 - j^LEAST)^BANDS, j being the Jaccard similarity of their byte 8-grams."""
    if not len(starts):
        return np.zeros((0, BANDS), np.int32)
    at, held = _gram_places(starts, ends, 8)
    hashes, first = (mix(_grams(data, 8)[at]) >> np.uint64(32)).astype(np.uint32), np.cumsum(held) - held
    out = np.zeros((len(starts), BANDS), np.uint64)
    for i, salt in enumerate(_SALTS):
        out[:, i // LEAST] = mix(out[:, i // LEAST] + np.minimum.reduceat(hashes ^ salt, first))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


#: A byte as eight byte-wide counters.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def _count_bits(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For consecutive groups of `held` values, how often each of the 64 bits is set. Eight counters of a byte are added at once, over 255 values at most."""
    starts = np.cumsum(held) - held
    pieces = -(-held // 255)
    first = np.cumsum(pieces) - pieces
    within = np.arange(pieces.sum()) - np.repeat(first, pieces)
    bounds = np.repeat(starts, pieces) + 255 * within
    parts = np.add.reduceat(_SPREAD[values.view(np.uint8).reshape(-1, 8)], bounds, axis=0)
    return np.add.reduceat(parts.view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int32)


def _few(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a step's bytes."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > STEP_BYTES:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].to_pylist()
        for lo, hi in _few(texts):
            rows, numbers, data, starts, ends = normal_lines(texts[lo:hi])
            if not len(rows):
                continue
            short = ends - starts < FUZZY_CHARS
            whole, _ = line_hashes(data, starts, ends)
            # Short lines are compared only within one normal form, whose hash then stands for fingerprint and keys.
            prints = [np.where(short, whole, p).view(np.int64) for p in line_prints(data, starts, ends)]
            keys = np.where(short[:, None], whole.astype(np.uint32).view(np.int32)[:, None], line_keys(data, starts, ends))
            own, own_starts, own_ends = own_lines(texts[lo:hi], rows, numbers)
            h1, h2 = (h.view(np.int64) for h in line_hashes(own, own_starts, own_ends))
            size = (own_sizes(own, own_starts, own_ends) * np.where(short, -1, 1)).astype(np.int32)
            at = pa.array(rows + lo)
            arrays = [batch["doc_id"].take(at), batch["version"].take(at), *map(pa.array, (numbers.astype(np.int32), h1, h2, *prints, size, *np.ascontiguousarray(keys.T)))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "version", "line", "h1", "h2", "print1", "print2", "size", *KEYS])


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, forms = [], []
        for text, wanted in zip(batch["text"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
            rows, numbers, *_ = normal_lines([text])
            data, starts, ends = own_lines([text], rows, numbers)
            h1, h2 = (h.view(np.int64).tolist() for h in line_hashes(data, starts, ends))
            place = {h: i for i, h in enumerate(zip(h1, h2, strict=True))}
            for w in wanted:
                i = place.get((w["h1"], w["h2"]))
                if i is not None:
                    nodes.append(w["node"])
                    forms.append(own_form(data[starts[i] : ends[i]]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(forms, pa.string())], ["node", "form"])


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is more; a column of the table at a time, as bits of whole numbers that say where it goes up or down."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    same = len(os.path.commonprefix([a, b]))
    a, b = a[same:][::-1], b[same:][::-1]
    same = len(os.path.commonprefix([a, b]))
    a, b = a[same:], b[same:]
    if not a or not b:
        return max(len(a), len(b))
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, left = whole, 0, len(a), len(b)
    for c in b:
        here = places.get(c, 0)
        flat = (((here & up) + up) ^ up) | here | down
        rise, fall = down | (whole & ~(flat | up)), up & flat
        score += bool(rise & top) - bool(fall & top)
        left -= 1
        if score - left > most:
            return most + 1
        rise = (rise << 1) | 1
        up, down = (fall << 1 | ~(here | down | rise)) & whole, rise & (here | down) & whole
    return min(score, most + 1)


def shared_trigrams(a: str, b: str) -> int:
    """How many trigrams two strings have in common, each as often as both have it; an edit takes three of them at most."""
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for s in (a, b))
    x, y = (np.sort((s[:-2] << np.uint64(42)) | (s[1:-1] << np.uint64(21)) | s[2:]) for s in (x, y))
    # The n-th trigram of a kind meets the n-th of the other side: their ranks within the kind are no more than those there.
    lo, hi = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
    rank = np.arange(len(x)) - np.searchsorted(x, x, "left")
    return int((rank < hi - lo).sum())


def most_by_words(a: list[str], b: list[str]) -> int:
    """A distance that is enough: words of a longest common subsequence stay, what stands between is replaced."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    whole = row = (1 << len(a)) - 1
    rows = [row]
    for word in b:
        met = row & places.get(word, 0)
        row = ((row + met) | (row - met)) & whole
        rows.append(row)
    # A bit of a row is unset where the subsequence grows with that word of a; from the end, words that meet stay.
    i, j, cost, gap_a, gap_b = len(a), len(b), 0, 0, 0
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
            gap_a += len(a[i]) + 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
            gap_b += len(b[j]) + 1
        else:
            i, j, cost, gap_a, gap_b = i - 1, j - 1, cost + max(gap_a, gap_b), 0, 0
    return cost + max(gap_a + sum(map(len, a[:i])) + i, gap_b + sum(map(len, b[:j])) + j)


def near_enough(a: str, b: str, percent: int) -> bool:
    """Whether 1 - distance / longer length is percent / 100 or more."""
    longer = max(len(a), len(b))
    most = (100 - percent) * longer // 100
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    if len(x) * len(y) <= WORD_TABLE and most_by_words(x, y) <= most:
        return True
    if min(len(a), len(b)) > 2 and shared_trigrams(a, b) < longer - 2 - 3 * most:
        return False
    return edit_distance(a, b, most) <= most


def edit_distances(a: str, others: list[str]) -> np.ndarray:
    """Levenshtein distances from one string to others, as in edit_distance: each has its own bits of the same whole numbers, with free ones between that stop carries."""
    points = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, *others)]
    lengths = np.array([len(p) for p in points[1:]], np.int64)
    widths = (lengths // 8 + 1) * 8
    starts = np.cumsum(widths) - widths
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    laid = np.full(widths.sum(), 1 << 31, np.uint32)
    laid[at] = np.concatenate(points[1:])
    number = lambda bits: int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    first = np.zeros(len(laid), bool)
    first[starts[lengths > 0]] = True
    whole, low = number(laid != 1 << 31), number(first)
    places = {c: number(laid == c) for c in np.unique(points[0]).tolist()}
    up, down = whole, 0
    for c in points[0].tolist():
        here = places[c]
        flat = ((((here & up) + up) ^ up) | here | down) & whole
        rise = ((down | (whole ^ (flat | up))) << 1 | low) & whole
        up, down = ((up & flat) << 1 & whole) | (whole ^ (flat | rise)), rise & flat
    counts = [np.add.reduceat(np.bitwise_count(np.frombuffer(n.to_bytes(len(laid) // 8, "little"), np.uint8)), starts // 8, dtype=np.int64) for n in (up, down)]
    return len(points[0]) + counts[0] - counts[1]


def all_near_enough(a: str, others: list[str], percent: int) -> np.ndarray:
    """near_enough of one string and each of the others."""
    lengths = np.array([len(s) for s in others], np.int64)
    most = (100 - percent) * np.maximum(lengths, len(a)) // 100
    out = np.abs(lengths - len(a)) <= most
    may = np.flatnonzero(out)
    if len(may) < MANY:
        out[may] = [near_enough(a, others[i], percent) for i in may]
        return out
    lo, ends = 0, np.cumsum(lengths[may])
    while lo < len(may):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BITS, "right")))
        part = may[lo:hi]
        out[part] = edit_distances(a, [others[i] for i in part]) <= most[part]
        lo = hi
    return out


def _block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) that join the components of the lines of each (key, lo, hi): those of block lo with those of block hi."""

    def links(key: int, lo: int, hi: int, rows: list[dict]) -> Iterator[tuple[int, int]]:
        band = (key + (1 << 31)) >> 32
        forms = [r["form"] for r in rows]
        column = lambda c, kind=np.int64: np.array([r[c] for r in rows], kind)
        nodes, component, size, block = (column(c) for c in ("node", "component", "size", "block"))
        prints = [column(f"print{i}") for i in (1, 2)]
        earlier = [column(k) for k in KEYS[:band]]
        for i in np.flatnonzero(block == lo):
            may = component != component[i]
            may &= (block == hi) & ((np.arange(len(rows)) > i) | (lo != hi))
            most = np.maximum(size, size[i]) * (100 - percent)
            may &= (np.abs(size - size[i]) * 100 <= most) & (most >= 100)
            at = np.flatnonzero(may)
            at = at[sum(np.bitwise_count((p[at] ^ p[i]).view(np.uint64)).astype(np.int64) for p in prints) <= FLIPS]
            for k in earlier:
                at = at[k[at] != k[i]]
            if not len(at):
                continue
            # One after the other, so that what is joined by the way needs no comparison.
            for part in np.array_split(at, -(-len(at) // GROUP)):
                part = part[component[part] != component[i]]
                for j in part[all_near_enough(forms[i], [forms[j] for j in part], percent)]:
                    if component[j] != component[i]:
                        component[component == component[j]] = component[i]
                        yield int(nodes[j]), int(nodes[i])

    now, held = None, []
    for batch in batches:
        found = []
        for row in batch.to_pylist():
            if (group := (row["key"], row["lo"], row["hi"])) != now:
                if held:
                    found += links(*now, held)
                now, held = group, []
            held.append(row)
        yield _pairs(found)
    if held:
        yield _pairs(list(links(*now, held)))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _close(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of the lines that are near enough to the centre of their group, which comes first in it and has no node."""
    now, centre, held = None, "", []

    def near() -> list[tuple[int, int]]:
        same = all_near_enough(centre, [form for _, form in held], percent)
        return [(node, now[0]) for (node, _), is_near in zip(held, same, strict=True) if is_near]

    for batch in batches:
        found = []
        for group, part, node, form in zip(*(batch[c].to_pylist() for c in ("centre", "part", "node", "form")), strict=True):
            if node is None:
                found += near()
                now, centre, held = (group, part), form, []
            elif (group, part) == now:
                held.append((node, form))
        yield _pairs(found)
    yield _pairs(near())


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether lines of these fingerprints and sizes (below 0: short) can be near enough."""
    n, m = F.col(f"size_{a}"), F.col(f"size_{b}")
    most = F.greatest(F.abs(n), F.abs(m)) * (100 - percent)
    flips = sum((F.bit_count(F.col(f"print{i}_{a}").bitwiseXOR(F.col(f"print{i}_{b}"))) for i in (1, 2)), F.lit(0))
    same = ((n > 0) & (m > 0) & (flips <= FLIPS)) | ((n < 0) & (m < 0) & (flips == 0))
    return (F.abs(F.abs(n) - F.abs(m)) * 100 <= most) & (most >= 100) & same


def _forms(docs: DataFrame, nodes: DataFrame, asked: DataFrame, few: bool) -> DataFrame:
    """(node, form) of the nodes asked for, read again from a document that has them."""
    wanted = asked.distinct().join(nodes, "node")
    by_doc = wanted.groupBy(F.col("rep").alias("doc_id"), F.col("rep_version").alias("version")).agg(F.collect_list(F.struct("node", "h1", "h2")).alias("wanted"))
    if few:
        by_doc = F.broadcast(by_doc)
    texts = docs.join(by_doc, docs["doc_id"].eqNullSafe(by_doc["doc_id"]) & (docs["version"] == by_doc["version"])).select("text", "wanted")
    return texts.mapInArrow(_lines, "node long, form string").groupBy("node").agg(F.first("form").alias("form"))


def _first_shared(key: Column, a: str, b: str) -> Column:
    """Whether two lines that have this key in common share none of an earlier band."""
    band = F.shiftright(key + F.lit(1 << 31), 32)
    return reduce(lambda x, y: x & y, [(band <= i) | (F.col(f"{k}_{a}") != F.col(f"{k}_{b}")) for i, k in enumerate(KEYS[:-1])])


def _grouped(pairs: Table, forms: DataFrame) -> DataFrame:
    """(centre, part, node, form): the forms of all a of one b, in parts of about GROUP, each after b's own form, which has no node."""
    parts = pairs.rows.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    members = pairs.rows.join(parts, "b").select(F.col("a").alias("asked"), F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.col("a").alias("node"))
    centres = parts.select(F.col("b").alias("asked"), F.col("b").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("node"))
    rows = members.union(centres).join(forms.select(F.col("node").alias("asked"), "form"), "asked").drop("asked")
    # Each row is a long comparison of a short line, so they are dealt to many tasks.
    dealt = rows.repartition(min(10_000, pairs.count // 500 + 1), "centre", "part")
    return dealt.select("centre", "part", "node", "form").sortWithinPartitions("centre", "part", F.asc_nulls_first("node"))


def _in_blocks(entries: DataFrame, forms: DataFrame) -> DataFrame:
    """The entries of each key in blocks of about BLOCK, with their forms, once for each two blocks (lo, hi) that one of them is."""
    blocks = entries.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = entries.join(F.broadcast(blocks), "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    return spread.join(forms, "node").select("key", "lo", "hi", "block", "node", "component", "size", "print1", "print2", *KEYS, "form")


def line_groups(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, version, line) of every line that isn't its group's first occurrence. docs: (doc_id, version, text)."""
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, version long, line int, h1 long, h2 long, print1 long, print2 long, size int, {', '.join(f'{k} int' for k in KEYS)}"
    seen = write_table(docs.mapInArrow(_occurrences, kinds))
    # All occurrences of an own form have one fingerprint, size and keys.
    traits = ["print1", "print2", "size"]
    rep = [F.min("doc_id").alias("rep"), F.coalesce(F.min_by("version", "doc_id"), F.min("version")).alias("rep_version")]
    nodes = write_table(seen.rows.groupBy("h1", "h2").agg(*rep, *[F.max(c).alias(c) for c in (*traits, *KEYS)], F.count(F.lit(1)).alias("held")).withColumn("node", F.monotonically_increasing_id()))
    pair = lambda i: F.struct(F.lit(i).cast("long").alias("band"), F.col(KEYS[i]).alias("key"))
    bands = F.when(F.col("size") > 0, F.array(*map(pair, range(BANDS)))).otherwise(F.array(pair(0)))
    listed = nodes.rows.select("node", F.explode(bands).alias("at")).select((F.shiftleft("at.band", 32) + F.col("at.key")).alias("key"), "node")
    shared = write_table(listed.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"))
    entries = write_table(listed.join(small(shared, WANTED), "key").select("key", F.lit(0).alias("block"), "node"))
    drop_tables(shared)

    def near(left: DataFrame, right: DataFrame, once: bool) -> DataFrame:
        x, y = (df.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "component", *traits, *(KEYS if once else []))]) for df, s in ((left, "x"), (right, "y")))
        can = (F.col("component_x") != F.col("component_y")) & _possible("x", "y", percent)
        if once:
            can &= _first_shared(x["key"], "x", "y")
        return x.join(y, (x["key"] == y["key"]) & can).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))

    def screen(pairs: DataFrame) -> DataFrame:
        side = lambda c: nodes.rows.select(F.col("node").alias(c), *[F.col(t).alias(f"{t}_{c}") for t in traits])
        return pairs.join(side("a"), "a").join(side("b"), "b").where(_possible("a", "b", percent)).select("a", "b")

    places = nodes.rows.select("node", "rep", "rep_version", "h1", "h2")

    def verify(pairs: Table) -> Table:
        asked = pairs.rows.select(F.col("a").alias("node")).union(pairs.rows.select("b"))
        forms = write_table(_forms(docs, places, asked, 2 * pairs.count <= WANTED))
        found = write_table(_grouped(pairs, forms.rows).mapInArrow(partial(_close, percent=percent), "a long, b long"))
        drop_tables(forms)
        return found

    def crowd_links(crowded: DataFrame) -> DataFrame:
        asked = write_table(crowded.select("node").distinct())
        forms = write_table(_forms(docs, places, asked.rows, asked.count <= WANTED))
        rows = write_table(_in_blocks(crowded, forms.rows))
        drop_tables(asked, forms)
        # Two blocks are long work on few rows, so they are dealt to many tasks.
        dealt = rows.rows.repartition(min(10_000, rows.count // BLOCK + 1), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "block", "node")
        return dealt.mapInArrow(partial(_block_links, percent=percent), "a long, b long")

    is_crowded = (F.col("entries") > CROWD) & (F.col("size") > 0)
    joined = linked_components(entries, nodes.rows.select("node", *traits, *KEYS), screen, near, verify, is_crowded, crowd_links)
    drop_tables(entries)
    # A form that stands once and links with nothing needs no more thought.
    placed = nodes.rows.select("node", "h1", "h2", "rep", "held").join(joined.rows.toDF("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    groups = placed.groupBy("component").agg(F.min("rep").alias("first"), F.sum("held").alias("all")).where("all > 1")
    named = placed.drop("rep").join(groups, "component").select("h1", "h2", "component", "first")
    repeated = write_table(seen.rows.select("doc_id", "version", "line", "h1", "h2").join(named, ["h1", "h2"]).drop("h1", "h2"))
    drop_tables(seen, nodes, joined)
    in_first = F.col("doc_id").eqNullSafe(F.col("first"))
    kept = repeated.rows.where(in_first).groupBy("component").agg(F.min(F.struct("version", "line")).alias("kept"))
    is_kept = in_first & (F.col("kept.version") == F.col("version")) & (F.col("kept.line") == F.col("line"))
    return repeated.rows.join(kept, "component").where(~is_kept).select("doc_id", "version", "line")


def dedup_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Removes repeated lines from text, keeping one occurrence of each group; adds n_lines and n_removed (long).

    A line's own form has A-Z small, runs of white space as one space and no
    marks .,;:!? at its end; equal own forms are one node. Two nodes link if
    the edit similarity of their own forms, 1 - distance / longer length, is
    percent / 100 or more, and their normal forms (see normalise) are equal or
    both have 20 bytes or more. Groups are connected components of that. The
    occurrence that stays is the one of the smallest doc_id, then text hash,
    then line number. Lines without a letter or digit always stay. Null texts
    stay null with no lines, rows with one doc_id and one text are one
    document and lose the same lines, a null doc_id comes last, an empty table
    gives no rows, other columns stay, and a column named like a new one is
    kept beside it.

    Pairs are sought among distinct own forms only, so a line repeated in a
    third of all documents is one node. Normal forms only give candidates:
    those that share one of BANDS MinHash keys of byte 8-grams (a short line
    has the hash of the whole as its one key) and whose SimHashes over byte
    8-grams differ in at most FLIPS of 128 bits. This search is not exact: a pair is
    missed where edits leave hardly any run of 8 bytes as it was; README.md
    gives the measured recall. Lists of lines are never split, whatever their
    length; within a key only pairs of different components are tried. The line numbers to remove are broadcast while they are few
    (WANTED), else joined with the texts.
    """
    version, lines, removed, gone, own_id, own_version = columns_free_of(docs, "_version", "n_lines", "n_removed", "_gone", "_d", "_v")
    keyed = docs.withColumn(version, F.xxhash64(F.coalesce("text", F.lit(""))))
    again = line_groups(keyed.select("doc_id", F.col(version).alias("version"), F.col("text").cast("string").alias("text")), percent)
    gone_by_doc = write_table(again.groupBy("doc_id", "version").agg(F.collect_set("line").alias("gone")), lines=F.sum(F.size("gone")))
    named = gone_by_doc.rows.toDF(own_id, own_version, gone)
    if gone_by_doc.count <= WANTED and (gone_by_doc.also["lines"] or 0) <= 4 * WANTED:
        named = F.broadcast(named)
    merged = keyed.join(named, keyed["doc_id"].eqNullSafe(F.col(own_id)) & (keyed[version] == F.col(own_version)), "left").drop(own_id, own_version)
    parts = F.split("text", "\n")
    left = F.filter(parts, lambda x, i: ~F.array_contains(F.col(gone), i))
    feeds = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    count = F.when(F.col("text").isNull(), 0).otherwise(feeds + 1).cast("long")
    out = merged.withColumns({lines: count, removed: F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")})
    return out.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).drop(version, gone)
