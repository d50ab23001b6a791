"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm._common import columns_free_of, cut

#: Bytes of item texts that one broadcast of search tables covers; larger benchmarks are searched in blocks.
BLOCK_BYTES = 16 << 20
#: A-Z lower-cased; ASCII that is neither letter nor digit becomes a space; other bytes stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass
class Patterns:
    """Wu-Manber tables for windows of one length; a block is two neighbouring words (one, if the length is one).

    shift: how far the search may move on after a block, 0 if some window ends
    with it. buckets: for each last block, windows by their first block.
    """

    length: int
    shift: dict = field(default_factory=dict)
    buckets: dict = field(default_factory=lambda: defaultdict(lambda: defaultdict(dict)))

    @property
    def block(self) -> int:
        return min(2, self.length)

    def add(self, window: tuple[bytes, ...], item: str) -> None:
        b = self.block
        for end in range(b, self.length + 1):
            key = window[end - b : end]
            self.shift[key] = min(self.shift.get(key, self.length - end), self.length - end)
        self.buckets[window[-b:]][window[:b]].setdefault(window, set()).add(item)

    def search(self, text: list[bytes]) -> Iterator[tuple[int, set]]:
        """(first word, items) of every occurrence, in order."""
        n, b, far, shift, buckets = self.length, self.block, self.length - self.block + 1, self.shift, self.buckets
        at = n
        blocks = list(zip(text, text[1:], strict=False)) if b == 2 else [(w,) for w in text]
        while at <= len(text):
            last = blocks[at - b]
            move = shift.get(last, far)
            if move:
                at += move
                continue
            same = buckets[last].get(blocks[at - n])
            if same and (items := same.get(tuple(text[at - n : at]))):
                yield at - n, items
            at += 1


def compile_items(items: list[tuple[str, str | None]], window: int) -> list[Patterns]:
    """Search tables for the windows of (item_id, text) items, one per window length that occurs."""
    out: dict[int, Patterns] = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for lo in range(len(w) - n + 1 if n else 0):
            out.setdefault(n, Patterns(n)).add(tuple(w[lo : lo + n]), item)
    plain = []
    for p in out.values():
        p.buckets = {k: dict(v) for k, v in p.buckets.items()}
        plain.append(p)
    return plain


def _find(batches: Iterator[pa.RecordBatch], tables, text: str, spans: str, items: str, n_words: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, held, counts = [], [], []
        for value, known, before in zip(batch[text], batch[spans].to_pylist(), batch[items].to_pylist(), strict=True):
            w = words(value.as_py())
            runs, names = [(s["first"], s["last"]) for s in known], set(before)
            for p in tables.value:
                for first, who in p.search(w):
                    names |= who
                    runs.append((first, first + p.length))
            found.append([{"first": a, "last": b} for a, b in merged(runs)])
            held.append(sorted(names))
            counts.append(len(w))
        new = {spans: pa.array(found, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), items: pa.array(held, pa.list_(pa.string())), n_words: pa.array(counts, pa.int64())}
        yield pa.RecordBatch.from_arrays([new.get(c, batch[c]) for c in batch.schema.names], batch.schema.names)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open runs as disjoint ones, in order; runs that touch are joined."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [(a, b) for a, b in out]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds to every row hit_spans (half-open runs of word numbers), hit_items (sorted item_ids as strings), n_words.

    A window is `window` consecutive words of an item, or a shorter item as a
    whole; every occurrence in a whole text is found and compared word by
    word. Null and wordless texts have no hits, as have null and wordless
    items; items with one id count once. Repeated rows are searched each; an
    empty benchmark gives no hits; columns with these names are kept, the new
    ones then end in underscores.

    Documents are never shuffled. The benchmark goes out in blocks of about
    block_bytes of text, dealt by a hash of the item, so a broadcast has a
    fixed bound; each further block is another pass over the texts.
    """
    spans, items, n_words = columns_free_of(docs, "hit_spans", "hit_items", "n_words")
    session = docs.sparkSession
    found = docs.withColumns({spans: F.array().cast("array<struct<first:long,last:long>>"), items: F.array().cast("array<string>"), n_words: F.lit(0).cast("long")})
    wanted = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("text is not null and item is not null")
    size = wanted.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    for block in range(blocks):
        mine = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        tables = session.sparkContext.broadcast(compile_items([tuple(r) for r in mine.collect()], window))
        if block:
            found = cut(found)
        found = found.mapInArrow(_bound(tables, "text", spans, items, n_words), found.schema)
    return found


def _bound(*args):
    return lambda batches: _find(batches, *args)


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
