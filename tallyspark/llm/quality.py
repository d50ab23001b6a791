"""Quality classifier: Bradley-Terry scores from preference pairs, cut at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm._common import NON_SPACE, byte_class, columns_free_of, steps, word_hashes, word_spans
from tallyspark.llm._labels import fit_logistic, held_out, sigmoid, teaching_sample

#: Labelled rows that teach, at most; and preference pairs drawn from them.
TEACHING, PAIRS = 20_000, 60_000
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]
_IN_LINE = byte_class([b for b in range(256) if b != 10])
#: How many features a text has.
WIDTH = len(_MARKS) + 17


def text_features(texts: pa.Array) -> np.ndarray:
    """A row of WIDTH shape features for every whole text; an empty or null one has zeros."""
    out = np.zeros((len(texts), WIDTH))
    for lo, hi, data, offsets in steps(texts):
        out[lo:hi] = _step_features(hi - lo, data, offsets)
    return out


def _step_features(n: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sizes = np.diff(offsets)
    row_of = np.repeat(np.arange(n), sizes)
    counts = np.bincount(row_of * 256 + data, minlength=256 * n).reshape(n, 256).astype(float)
    total = np.maximum(sizes, 1)[:, None].astype(float)
    share = counts / total
    upper, lower, digit = share[:, 65:91].sum(1), share[:, 97:123].sum(1), share[:, 48:58].sum(1)
    entropy = -(share * np.log2(np.maximum(share, 1e-12))).sum(1)
    starts, ends, first = word_spans(data, offsets, NON_SPACE)
    hashes = word_hashes(data, starts, ends)
    words = np.diff(first)
    some = np.maximum(words, 1)
    owner = np.repeat(np.arange(n), words)
    per_row = lambda values: np.bincount(owner, values, minlength=n) / some
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    marks = np.zeros(256, bool)
    marks[_MARKS] = True
    last, second = data[ends - 1], data[np.minimum(starts + 1, ends - 1)]
    line_starts, line_ends, line_first = word_spans(data, offsets, _IN_LINE)
    lines = word_hashes(data, line_starts, line_ends)
    distinct = np.array([(len(np.unique(hashes[first[i] : first[i + 1]])), len(np.unique(lines[line_first[i] : line_first[i + 1]]))) for i in range(n)]).reshape(n, 2)
    n_lines = np.maximum(np.diff(line_first), 1)
    extra = [
        upper, lower, digit, share[:, 128:].sum(1), share[:, 10], share[:, 32], share[:, _MARKS].sum(1), entropy / 8,
        np.log1p(sizes) / 12, np.log1p(words) / 10, per_row((ends - starts).astype(float)) / 20, per_row(again),
        per_row(marks[last].astype(float)), per_row(((second >= 65) & (second <= 90)).astype(float)),
        1 - distinct[:, 0] / some, np.sqrt(distinct[:, 0]) / some, 1 - distinct[:, 1] / n_lines,
    ]
    out = np.concatenate([np.sqrt(share[:, _MARKS]), np.stack(extra, 1)], 1)
    out[sizes == 0] = 0
    return out


@dataclass
class Ranking:
    """score = sigmoid(slope (weights . standardised features - threshold))."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    slope: float = 1.0

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (self.strength(x) - self.threshold))


def fit_ranking(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, penalty: float = 5.0, seed: int = 11) -> Ranking:
    """Bradley-Terry on (better, worse) pairs of rows: logistic loss on differences of features.

    The threshold is the strength at the quantile that the share of worse rows
    names, moved to the middle between the classes around it. With one class
    or none every strength is 0 and every score 0.5.
    """
    width = x.shape[1] if x.ndim == 2 else WIDTH
    plain = Ranking(np.zeros(width), np.ones(width), np.zeros(width))
    if len(np.unique(y)) < 2:
        return plain
    rng = np.random.default_rng(seed)
    centre, scale = x.mean(0), x.std(0)
    model = Ranking(centre, np.where(scale > 1e-9, scale, 1.0), np.zeros(width))
    z = np.clip((x - model.centre) / model.scale, -8, 8)
    better, worse = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    difference = z[rng.choice(better, pairs)] - z[rng.choice(worse, pairs)]
    # Each pair both ways round, by symmetry: half as losses of the worse.
    flip = np.where(rng.random(pairs) < 0.5, 1.0, -1.0)
    model.weights = fit_logistic(difference * flip[:, None], (flip > 0).astype(float), penalty)
    strength = z @ model.weights
    cut = np.quantile(strength, (y == 0).mean())
    low, high = strength[(y == 0) & (strength <= cut)], strength[(y == 1) & (strength >= cut)]
    if len(low) and len(high):
        cut = (np.quantile(low, 0.95) + np.quantile(high, 0.05)) / 2
    model.threshold = float(cut)
    spread = np.stack([strength - cut], 1)
    model.slope = float(np.clip(fit_logistic(spread, y.astype(float), 1.0)[0], 0.05, 20))
    return model


def learn_quality(docs: DataFrame, labels: DataFrame, teaching: int = TEACHING) -> Ranking:
    """A ranking from a bounded sample of labelled rows; their features, not their texts, reach the driver."""
    sample = teaching_sample(docs, labels, "quality", teaching)
    rows = sample.mapInArrow(_sample_features, "label int, features array<double>").toArrow()
    x = np.array(rows["features"].to_pylist(), float).reshape(-1, WIDTH)
    y = rows["label"].to_numpy()
    order = np.lexsort((*x.T, y))
    return fit_ranking(x[order], y[order])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["label"], pa.array(list(text_features(batch["text"])), pa.list_(pa.float64()))], ["label", "features"])


def score_quality(docs: DataFrame, model: Ranking) -> DataFrame:
    """Adds score (double, 0 to 1) and predicted (int, 1 from 0.5 up) to every row, by its whole text alone.

    Null and empty texts are scored by their zero features. Rows are neither
    shuffled nor dropped; columns named score or predicted stay, the new ones
    then end in underscores.
    """
    score, predicted = columns_free_of(docs, "score", "predicted")
    schema = docs.withColumns({score: F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array(model.score(text_features(batch["text"])), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, values], [*batch.schema.names, score])

    return docs.mapInArrow(run, schema).withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """score_quality by what labels teach, with held_out."""
    (held,) = columns_free_of(docs, "held_out")
    return score_quality(docs, learn_quality(docs, labels)).withColumn(held, held_out())
