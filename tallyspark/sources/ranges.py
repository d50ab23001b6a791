"""Fixed-width binary files read by byte ranges: one large file is many tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of one task's range, and of one step within it.
RANGE_BYTES, STEP_BYTES = 64 << 20, 4 << 20
#: What a range counts besides its bytes, so that a task gets about a thousand tiny ones; up to how many ranges of one size are a task each; values that are handed on together.
OPEN_BYTES, LEAST_TASKS, TOGETHER = 64 << 10, 64, 1 << 16
_SCHEMA = pa.schema([("path", pa.string()), ("i", pa.int64()), ("v", pa.int64())])


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it; file: with one slash counts as local."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


@dataclass
class Ranges(InputPartition):
    """Ranges that one task reads: (path, name, begin, end) of each."""

    pieces: list[tuple[str, str, int, int]]


class FixedWidthSource(DataSource):
    """(path, i, v): the little-endian integers of `width` bytes (1, 2, 4 or 8) of a file, or of all files of a folder, by their number from 0.

    Options: path, width, signed (true), expected (values a file must have, if given), range_bytes. A file whose length
    fits no whole number of values, or not the expected one, fails the read
    before any task starts. Hidden files (. or _) are left out. Many small
    ranges share a task, so there are as many tasks as the bytes need, not as
    there are files.
    """

    @classmethod
    def name(cls) -> str:
        return "fixed_width"

    def schema(self) -> str:
        return "path string, i long, v long"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.width = options["path"], int(options.get("width", 1))
        if self.width not in (1, 2, 4, 8):
            raise ValueError(f"width {self.width} is not 1, 2, 4 or 8")
        self.kind = f"<{'i' if options.get('signed', 'true').lower() == 'true' else 'u'}{self.width}"
        if self.kind == "<u8":
            raise ValueError("unsigned values of 8 bytes don't fit a long")
        self.expected = int(options["expected"]) if "expected" in options else None
        step = int(options.get("range_bytes", RANGE_BYTES))
        self.range = max(self.width, step - step % self.width)

    def partitions(self) -> list[Ranges]:
        system, root = file_system(self.path)
        info = system.get_file_info(root)
        if info.type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == arrow_fs.FileType.File else sorted(system.get_file_info(arrow_fs.FileSelector(root, recursive=True)), key=lambda x: x.path)
        out = []
        for f in files:
            if f.type != arrow_fs.FileType.File or f.base_name.startswith((".", "_")):
                continue
            if f.size % self.width or self.expected not in (None, f.size // self.width):
                wanted = f"values of {self.width} bytes" if self.expected is None else f"{self.expected} values of {self.width} bytes"
                fault = "an odd number of bytes" if self.expected is None else "another size"
                raise ValueError(f"{f.path} has {fault}: {f.size} are not {wanted}")
            name = f.path[len(root) :].lstrip("/") if f.path != root else f.base_name
            out += [(f.path, name, at, min(at + self.range, f.size)) for at in range(0, f.size, self.range)]
        return _packed(out)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        step = STEP_BYTES - STEP_BYTES % self.width
        held, n = [], 0
        for path, pieces in groupby(partition.pieces, key=lambda p: p[0]):
            with system.open_input_file(path) as f:
                for _, name, begin, end in pieces:
                    for at in range(begin, end, step):
                        values = np.frombuffer(f.read_at(min(step, end - at), at), self.kind).astype(np.int64)
                        held.append((name, at // self.width, values))
                        n += len(values)
                        if n >= TOGETHER:
                            yield _batch(held)
                            held, n = [], 0
        if held:
            yield _batch(held)


def _packed(pieces: list[tuple[str, str, int, int]]) -> list[Ranges]:
    """Ranges in their order, as many in a task as stay below RANGE_BYTES and leave LEAST_TASKS tasks; a larger one is a task of its own."""
    cost = lambda p: p[3] - p[2] + OPEN_BYTES
    most = min(RANGE_BYTES, sum(map(cost, pieces)) // LEAST_TASKS)
    out, now = [], 0
    for piece in pieces:
        if not out or now + cost(piece) > most:
            out.append(Ranges([]))
            now = 0
        out[-1].pieces.append(piece)
        now += cost(piece)
    return out


def _batch(held: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
    """Values read, each run with its file's name and the number of its first."""
    sizes = [len(values) for _, _, values in held]
    names = pa.array([name for name, _, _ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), sizes)))
    numbers = np.concatenate([np.arange(first, first + n) for (_, first, _), n in zip(held, sizes, strict=True)])
    return pa.RecordBatch.from_arrays([names, pa.array(numbers), pa.array(np.concatenate([values for _, _, values in held]))], schema=_SCHEMA)


def read_fixed_width(spark: SparkSession, path: str, width: int, **options) -> DataFrame:
    """See FixedWidthSource."""
    spark.dataSource.register(FixedWidthSource)
    return spark.read.format("fixed_width").options(path=path, width=width, **options).load()


def read_grid(spark: SparkSession, path: str, rows: int, cols: int, **options) -> DataFrame:
    """(row, col, value) of a file of signed bytes; a length other than rows x cols fails."""
    cells = read_fixed_width(spark, path, 1, expected=rows * cols, **options)
    return cells.select(F.floor(F.col("i") / cols).cast("int").alias("row"), (F.col("i") % cols).cast("int").alias("col"), F.col("v").cast("int").alias("value"))


def read_pcm(spark: SparkSession, path: str, **options) -> DataFrame:
    """(i, v) of little-endian signed 16-bit samples; an odd length fails."""
    return read_fixed_width(spark, path, 2, **options).select("i", F.col("v").cast("int").alias("v"))
