"""Grids, polygons, sequence decoding, redaction and small meshes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def inside(x: Column, y: Column, polygon: list[tuple[int, int]], scale: int = 2) -> Column:
    """Whether an odd number of edges lies to the right of a point, whose whole coordinates are `scale` times those of the vertices.

    An edge counts for points at or above its lower end and below its upper
    one, so a vertex counts once. It lies to the right where the cross product
    of the edge, taken upwards, and the point is positive. No vertices hold
    nothing.
    """
    corners = [(scale * a, scale * b) for a, b in polygon]
    rising = [(*low, *high) if low[1] < high[1] else (*high, *low) for low, high in zip(corners, corners[1:] + corners[:1], strict=True) if low[1] != high[1]]
    if not rising:
        return F.lit(False)
    edges = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), e, strict=True)]) for e in rising])
    right = lambda e: (e["x1"] - e["x0"]) * (y - e["y0"]) > (x - e["x0"]) * (e["y1"] - e["y0"])
    return F.size(F.filter(edges, lambda e: (y >= e["y0"]) & (y < e["y1"]) & right(e))) % 2 == 1


def cells_inside(cells: DataFrame, polygon: list[tuple[int, int]]) -> DataFrame:
    """Cells (row, col) whose centre lies in the polygon."""
    return cells.where(inside(2 * F.col("col") + 1, 2 * F.col("row") + 1, polygon))


OUTSIDE = 32
_LETTERS = "BIES"


def _bioes(categories: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which steps between states are valid, which states may begin and which may end. State 4 c + letter; the last is O."""
    n = 4 * categories + 1
    letters = np.array([*(_LETTERS * categories), "O"])
    cats = np.array([*np.repeat(np.arange(categories), 4), -1])
    closed = np.isin(letters, ["O", "E", "S"])
    opens = np.isin(letters, ["O", "B", "S"])
    within = np.isin(letters, ["I", "E"])
    valid = (closed[:, None] & opens[None, :]) | (~closed[:, None] & within[None, :] & (cats[:, None] == cats[None, :]))
    assert valid.shape == (n, n)
    return valid, opens, closed


def _biases(bias: list[float], categories: int = 8) -> np.ndarray:
    """Additive weight of each step: O to O, into a span from O, on, out, span to span, and to another category."""
    letters = np.array([*(_LETTERS * categories), "O"])
    cats = np.array([*np.repeat(np.arange(categories), 4), -1])
    out = np.zeros((len(letters), len(letters)))
    begin, o = np.isin(letters, ["B", "S"]), letters == "O"
    ended = np.isin(letters, ["E", "S"])
    out[np.ix_(o, o)] = bias[0]
    out[np.ix_(o, begin)] = bias[1]
    out[np.ix_(ended, begin)] = bias[4] + bias[5] * (cats[ended][:, None] != cats[begin][None, :])
    out[:, letters == "E"] = bias[3]
    out[np.ix_(np.isin(letters, ["B", "I"]), letters == "I")] = bias[2]
    return out


def decode(logits: np.ndarray, bias: list[float]) -> list[tuple[int, int, int]]:
    """(first, last, category) spans of the best valid tag sequence; ties go to the first state."""
    valid, begin, end = _bioes()
    step = np.where(valid, _biases(bias), -np.inf)
    score = np.where(begin, logits[0], -np.inf)
    back = np.zeros((len(logits), len(step)), int)
    for t in range(1, len(logits)):
        options = score[:, None] + step
        back[t] = options.argmax(0)
        score = options.max(0) + logits[t]
    state = int(np.where(end, score, -np.inf).argmax())
    path = [state]
    for t in range(len(logits) - 1, 0, -1):
        state = int(back[t][state])
        path.append(state)
    spans, start = [], 0
    for i, s in enumerate(reversed(path)):
        letter = "O" if s == OUTSIDE else _LETTERS[s % 4]
        if letter in "BS":
            start = i
        if letter in "ES":
            spans.append((start, i + 1, s // 4))
    return spans


def decode_spans(df: DataFrame, key: str, position: str, logits: str, bias: list[float], categories: list[str]) -> DataFrame:
    """(key, token_start, token_end, category) of each token sequence, one group per sequence."""
    names = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(position)
        found = decode(np.array(part[logits].tolist(), float), bias)
        return pd.DataFrame([(part[key].iloc[0], a, b, categories[c]) for a, b, c in found], columns=[key, "token_start", "token_end", "category"])

    return df.groupBy(key).applyInPandas(one, f"{key} {names[key]}, token_start long, token_end long, category string")


def redact(df: DataFrame, text: str, patterns: dict[str, str], names: list[str]) -> DataFrame:
    """Adds redacted and n_spans: what patterns and names find, overlaps joined under the earlier kind, is replaced by [REDACTED:kind]."""
    finders = [(kind, re.compile(p)) for kind, p in patterns.items()] + [("PERSON", re.compile(re.escape(n))) for n in names]

    def one(value: str | None) -> tuple[str | None, int]:
        if value is None:
            return None, 0
        found = sorted(((m.start(), m.end(), kind) for kind, p in finders for m in p.finditer(value) if m.end() > m.start()), key=lambda s: (s[0], -s[1]))
        kept: list[list] = []
        for first, last, kind in found:
            if kept and first < kept[-1][1]:
                kept[-1][1] = max(kept[-1][1], last)
            else:
                kept.append([first, last, kind])
        out, at = [], 0
        for first, last, kind in kept:
            out += [value[at:first], f"[REDACTED:{kind}]"]
            at = last
        return "".join([*out, value[at:]]), len(kept)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [one(v) for v in batch[text]]
            yield batch.assign(redacted=[d[0] for d in done], n_spans=[d[1] for d in done])

    return df.mapInPandas(run, df.selectExpr("*", "cast(null as string) as redacted", "0L as n_spans").schema)


#: Bytes of the stiffness matrices that are solved at once.
_SOLVED_BYTES = 32 << 20


def max_von_mises(df: DataFrame, key: str) -> DataFrame:
    """(key, max_stress) of plane-stress meshes given as one row each: nodes, elements, fixed and loads arrays, e, nu, thickness.

    Meshes of a batch that have the same elements and the same degrees of
    freedom held and loaded are solved together.
    """
    kind = next(f.dataType for f in df.schema.fields if f.name == key)
    schema = StructType().add(key, kind).add("max_stress", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(_stresses(batch))], [key, "max_stress"])

    return df.mapInArrow(run, schema)


def _whole(column: pa.Array) -> pa.Array:
    if column.null_count:
        raise ValueError("a mesh holds a null")
    return column


def _tuples(column: pa.Array, rows: int, width: int) -> np.ndarray:
    """Lists of equal length, a row each, of lists of so many values."""
    inner = _whole(column).flatten()
    if len(inner) and pc.min_max(pc.list_value_length(_whole(inner))).as_py() != {"min": width, "max": width}:
        raise ValueError(f"a mesh needs {width} numbers to a node or element")
    return _whole(inner.flatten()).to_numpy(zero_copy_only=False).reshape(rows, len(inner) // rows, width)


def _dofs(column: pa.Array, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of freedom and values of lists of equal length, a row each."""
    structs = _whole(_whole(column).flatten())
    return tuple(_whole(structs.field(name)).to_numpy(zero_copy_only=False).reshape(rows, len(structs) // rows) for name in ("dof", "value"))


def _stresses(batch: pa.RecordBatch) -> np.ndarray:
    out = np.full(batch.num_rows, np.nan)
    lengths = [pc.fill_null(pc.list_value_length(batch.column(c)), -1).to_numpy() for c in ("nodes", "elements", "fixed", "loads")]
    for of_size in _alike(np.stack(lengths, 1)):
        part = batch.take(pa.array(of_size))
        n = len(of_size)
        xy = _tuples(part.column("nodes"), n, 2).astype(float)
        elements = _tuples(part.column("elements"), n, 3).astype(int)
        (fixed, held), (loaded, force) = (_dofs(part.column(c), n) for c in ("fixed", "loads"))
        e, nu, thickness = (part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("e", "nu", "thickness"))
        most = max(1, _SOLVED_BYTES // (8 * (2 * xy.shape[1]) ** 2 or 1))
        for group in _alike(np.concatenate([elements.reshape(n, -1), fixed, loaded], 1).astype(int)):
            for at in range(0, len(group), most):
                g = group[at : at + most]
                out[of_size[g]] = _stress(xy[g], elements[g[0]], fixed[g[0]], held[g], loaded[g[0]], force[g], e[g], nu[g], thickness[g])
    return out


def _alike(keys: np.ndarray) -> list[np.ndarray]:
    """The numbers of equal rows, an array for each of the different ones."""
    if not len(keys) or (keys == keys[0]).all():
        return [np.arange(len(keys))] if len(keys) else []
    which = np.unique(keys, axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(which, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(which[order])) + 1)


def _stress(xy, elements, fixed, held, loaded, force, e, nu, thickness) -> np.ndarray:
    """Linear triangles of many meshes; elements and the degrees of freedom fixed and loaded are those of all, the rest has a row for each."""
    n, size = len(xy), 2 * xy.shape[1]
    stiff, parts = np.zeros((n, size, size)), []
    d = np.zeros((n, 3, 3))
    d[:, 0, 0] = d[:, 1, 1] = 1
    d[:, 0, 1] = d[:, 1, 0] = nu
    d[:, 2, 2] = (1 - nu) / 2
    d *= (e / (1 - nu * nu))[:, None, None]
    for ids in elements:
        p = xy[:, ids]
        area2 = np.abs(np.linalg.det(np.concatenate([np.ones((n, 3, 1)), p], 2)))
        if (area2 == 0).any():
            raise ValueError("degenerate triangle")
        b, c = np.roll(p[:, :, 1], -1, 1) - np.roll(p[:, :, 1], 1, 1), np.roll(p[:, :, 0], 1, 1) - np.roll(p[:, :, 0], -1, 1)
        strain = np.zeros((n, 3, 6))
        strain[:, 0, ::2], strain[:, 1, 1::2], strain[:, 2, ::2], strain[:, 2, 1::2] = b, c, c, b
        strain /= area2[:, None, None]
        dofs = np.stack([2 * ids, 2 * ids + 1], 1).ravel()
        stiff[:, dofs[:, None], dofs] += (area2 / 2 * thickness)[:, None, None] * (strain.transpose(0, 2, 1) @ d @ strain)
        parts.append((dofs, strain))
    forces, moved = np.zeros((n, size)), np.zeros((n, size))
    for i, dof in enumerate(loaded):
        forces[:, int(dof)] += force[:, i]
    for i, dof in enumerate(fixed):
        moved[:, int(dof)] = held[:, i]
    free = np.array([i for i in range(size) if i not in {int(x) for x in fixed}], int)
    moved[:, free] = np.linalg.solve(stiff[:, free[:, None], free], forces[:, free, None])[:, :, 0]
    x, y, s = np.moveaxis(np.stack([(d @ strain @ moved[:, dofs, None])[:, :, 0] for dofs, strain in parts], 1), 2, 0)
    return np.sqrt(x * x - x * y + y * y + 3 * s * s).max(1)
