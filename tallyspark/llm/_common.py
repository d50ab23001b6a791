"""What the operators share: tables, lineage cuts, hashing of words in Arrow buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources.lineage import cut, shared_folder
from tallyspark.sources.tables import table

__all__ = ["cut", "shared_folder", "table"]

#: Bytes of text that one numpy step handles; a longer single text is a step of its own.
STEP_BYTES = 1 << 18


#: Spark's own settings while a table is written: shuffle files go as soon as the execution has ended, and Python workers get few whole texts at a time.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


class Table(NamedTuple):
    """Rows written to the shared folder, how many they are, and what else was asked of them."""

    rows: DataFrame
    count: int
    path: str
    also: dict


def write_table(df: DataFrame, **also: Column) -> Table:
    """Cuts a lineage by a Parquet table in the shared folder; counts the rows (and `also`, aggregates) on the way.

    The files outlive executors, and the shuffle files of the plan that made
    them are no longer needed, so they go at once.
    """
    spark = df.sparkSession
    path, seen = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}", Observation()
    before = {key: spark.conf.get(key) for key in _WRITING}
    for key, value in _WRITING.items():
        spark.conf.set(key, value)
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(name) for name, c in also.items()]).write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return Table(spark.read.schema(df.schema).parquet(path), seen.get["rows"], path, seen.get)


def drop_tables(*tables: Table) -> None:
    """Deletes tables that no plan reads any more."""
    for t in tables:
        path = t.rows.sparkSession._jvm.org.apache.hadoop.fs.Path(t.path)
        path.getFileSystem(t.rows.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(t: Table, most: int) -> DataFrame:
    """Marks a table for a broadcast while it has at most so many rows; beyond that it is joined by a shuffle."""
    return F.broadcast(t.rows) if t.count <= most else t.rows


def columns_free_of(df: DataFrame, *names: str) -> list[str]:
    """For each name, it or it with underscores appended, so that it clashes with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def byte_class(pattern_bytes) -> np.ndarray:
    """A table over the 256 byte values, True for those given."""
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


#: Letters, digits and every byte of a non-ASCII character.
ALNUM = byte_class([b for b in range(256) if b >= 128 or chr(b).isalnum()])
#: Everything but space and the ASCII controls from tab to carriage return.
NON_SPACE = byte_class([b for b in range(256) if b != 32 and not 9 <= b <= 13])

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER += 1
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, STEP_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def steps(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most limit bytes (or one row): first row, last row + 1, their bytes, row offsets into these."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that stay within a row, and for each row the index of its first."""
    inside = word_bytes[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = offsets[:-1] < offsets[1:]
    before[offsets[:-1][filled]] = False
    after[offsets[1:][filled] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word with A-Z lower-cased: prefix sums of a polynomial, moved to power 0, then mixed."""
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of n words, or of the whole sequence if it has fewer; none without words."""
    if not len(words):
        return words
    if len(words) < n:
        return mix(np.array([_fold(words)], np.uint64))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out + words[i : len(words) - n + 1 + i] + np.uint64(i + 1))
    return out


def _fold(words: np.ndarray) -> int:
    x = np.array([0xA5A5A5A5 + len(words)], np.uint64)
    for i, w in enumerate(words):
        x = mix(x + w + np.uint64(i + 1))
    return int(x[0])
