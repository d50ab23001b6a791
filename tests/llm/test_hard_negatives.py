import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, positives=5, negatives=3):
    good = {(v, lab, tuple(math.floor(256 * x) for x in e)) for v, e, lab in rows if v is not None and lab is not None and e and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for a, lab, q in good:
        if a % 50:
            continue
        seen = sorted((-sum(x * y for x, y in zip(q, e, strict=True)), v, other) for v, other, e in good if v != a and len(e) == len(q))
        for p, pid, _ in [s for s in seen if s[2] == lab][:positives]:
            fits = [(s, v) for s, v, other in seen if other != lab and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(a, pid, i + 1, v, -p, -s) for i, (s, v) in enumerate(fits)]
    return sorted(out)


def got(spark, rows, **kw):
    return sorted(tuple(r) for r in H.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, **kw).collect())


@pytest.mark.parametrize("most", [7, 60, 4096])
def test_against_all_pairs(spark, monkeypatch, most):
    """Coarse vectors give many ties; trees of a few rows make every level of the queue work."""
    monkeypatch.setattr(H, "tree_rows", lambda n: most)
    monkeypatch.setattr(H, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(most)
    rows = [(i, (rng.integers(-3, 4, 5) / 4 + (0.5 if i % 3 else 0)).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    want = plain(rows)
    assert want and got(spark, rows) == want


def test_copies_nulls_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 0.5], 1) for i in range(1, 300)] + [(i, [0.7, 0.5], 2) for i in range(300, 500)]
    rows += [(i, rng.normal(size=2).tolist(), int(i % 3)) for i in range(500, 700)] + [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (850, [1.0, 0.0], 1)]
    rows += [(700, None, 1), (701, [1.0, 1.0], None), (702, [None, 1.0], 2), (703, [float("nan"), 1.0], 2), (704, [float("inf"), 1.0], 2), (None, [1.0, 1.0], 2), (705, [], 1), (750, [1.0, 1.0, 1.0], 1), (751, [1.0, 0.9, 1.0], 1), (752, [0.5, 0.9, 1.0], 3)]
    want = plain(rows)
    assert want and got(spark, rows) == want


def test_products_beyond_doubles_stay_exact(spark):
    """Sums over 2^53 differ in their last bits only; sums over 64 bits come back as the end of the range."""
    rows = [(0, [2.0**21, 1.0], 1), (1, [2.0**21, 0.75], 1), (2, [2.0**21 * 0.9, 1.0], 2), (3, [2.0**21 * 0.9, 1.0 + 1 / 256], 2)]
    assert got(spark, rows) == plain(rows) and plain(rows)[0][3] == 3
    huge = [(0, [2.0**40], 1), (1, [2.0**40], 1), (2, [2.0**39], 2)]
    assert {r[4] for r in got(spark, huge)} <= {2**63 - 1}


def test_empty_tables_and_clashing_columns(spark):
    assert got(spark, []) == [] and got(spark, [(1, [1.0], 1)]) == []
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.6, 0.9], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("tree", "dim", "h1", "anchor", "members", "rank", "block")})
    assert sorted(tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()) == plain(rows)


def test_boxes_hold_what_is_below_them():
    rng = np.random.default_rng(4)
    vectors, labels = rng.integers(-50, 50, (500, 6)), rng.integers(0, 4, 500)
    order, (lows, highs, first, last), leaves = H.pack(vectors, labels, leaf=8, fanout=3)
    assert sorted(order.tolist()) == list(range(500)) and first[-1] >= 0
    packed = np.column_stack([vectors, labels])[order]
    for node in range(len(first)):
        below = packed[first[node] : last[node]] if node < leaves else np.concatenate([[lows[c], highs[c]] for c in range(first[node], last[node])])
        assert (lows[node] == below.min(0)).all() and (highs[node] == below.max(0)).all()


def test_pruned_search_against_all_rows():
    """Trees of many small leaves: every window's best, and boxes left unopened."""
    rng = np.random.default_rng(5)
    centres = rng.integers(-200, 200, (12, 4))
    vectors = np.repeat(centres, 40, 0) + rng.integers(-6, 7, (480, 4))
    labels = np.repeat(np.arange(12) % 3, 40)
    order, nodes, leaves = H.pack(vectors, labels, leaf=8, fanout=3)
    flat = [x.astype(np.int64).tobytes() for x in (labels[order], order[:, None], np.ones(480), *nodes)]
    tree = H.Tree({"dim": 4, "wide": True, "vectors": vectors[order].astype(np.int64).tobytes(), **dict(zip(("label", "members", "held", "lows", "highs", "first", "last"), flat, strict=True)), "leaves": leaves}, 1)
    asked = tree.exact_for(vectors[::40])
    lows, highs = tree.bounds(asked)
    for i in range(12):
        scores = vectors @ vectors[40 * i]
        top = int(np.sort(scores)[-20])
        for same, windows in ((True, [(-math.inf, math.inf)]), (False, [(top // 2, top), (0, top // 3), (10**9, 10**9)])):
            got = tree.search(40 * i, int(labels[40 * i]), same, asked[i], lows[i], highs[i], windows, 4)
            for (low, high), best in zip(windows, got, strict=True):
                fit = [(int(s), -v) for v, s in enumerate(scores) if low <= s <= high and (labels[v] == labels[40 * i]) == same and v != 40 * i]
                assert best == sorted(fit, reverse=True)[:4]
